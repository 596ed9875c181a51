"""Named pointers to records: bound once, read by name, recovered after a crash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bind(requests: DataFrame, key: list[str], order: list[str], content_hash: str = "content_hash") -> DataFrame:
    """Requests to bind a name to a record, each with `bound` (what the name points to) and `outcome`: bound (the first), same, or conflict.

    The first request of a name, by `order`, binds it. Names are found by aggregation and joined back, so a name with very many
    requests is no one task's.
    """
    first = requests.groupBy(*key).agg(F.min(F.struct(*order, content_hash)).alias("_f"))
    j = requests.join(first, key)
    own = F.struct(*order, content_hash) == F.col("_f")
    outcome = F.when(own, "bound").when(F.col(content_hash) == F.col(f"_f.{content_hash}"), "same").otherwise("conflict")
    return j.withColumn("bound", F.col(f"_f.{content_hash}")).withColumn("outcome", outcome).drop("_f")


def load_launch(bindings: DataFrame, records: DataFrame) -> DataFrame:
    """(run_id, run, payload, problem): what a run's launch is made of, from bindings (run_id, part: run or payload, content_hash) and
    records (content_hash, schema, content)."""
    held = bindings.join(records, "content_hash", "left")
    by = held.groupBy("run_id").agg(*(F.max(F.when(F.col("part") == p, F.col("content"))).alias(p) for p in ("run", "payload")), *(F.max(F.when(F.col("part") == p, F.col("schema"))).alias(f"_{p}") for p in ("run", "payload")))
    problem = F.when(F.col("run").isNull(), "run not bound").when(F.col("_run") != "run", "run of another schema").when(F.col("payload").isNull(), "payload not bound").when(F.col("_payload") != "payload", "payload of another schema")
    return by.select("run_id", "run", "payload", problem.alias("problem"))


def deferred_intents(log: DataFrame) -> DataFrame:
    """(run_id, step_index, pos, intent) that are buffered now: log (run_id, step_index, at, op: persist or evict, intents).

    The last event of a step counts: an eviction empties its buffer, a persist replaces it.
    """
    last = log.groupBy("run_id", "step_index").agg(F.max(F.struct("at", "op", "intents")).alias("l")).filter("l.op = 'persist'")
    return last.select("run_id", "step_index", F.posexplode("l.intents").alias("pos", "intent")).withColumn("pos", F.col("pos").cast("long"))


def crash_window(heads: DataFrame, results: DataFrame, buffered: DataFrame) -> DataFrame:
    """(run_id, step_index) to resume: of each head (run_id, step_index), its own step or else the one before it, if that is bound to a
    result (run_id, step_index, status, n_resolved) that continues, has resolved no intent, and still has intents buffered."""
    tried = heads.select("run_id", F.explode(F.array("step_index", F.col("step_index") - 1)).alias("step_index")).filter("step_index >= 0")
    open_ = results.filter((F.col("status") == "CONTINUE") & (F.col("n_resolved") == 0)).select("run_id", "step_index").distinct()
    found = tried.join(open_, ["run_id", "step_index"]).join(buffered.select("run_id", "step_index").distinct(), ["run_id", "step_index"], "left_semi")
    return found.groupBy("run_id").agg(F.max("step_index").alias("step_index"))


def typed_documents(refs: DataFrame, stored: DataFrame) -> DataFrame:
    """refs (id, content_hash, wanted) with what they point to and `problem`: absent, or of another schema than wanted."""
    j = refs.join(stored.select("content_hash", F.col("schema").alias("found")), "content_hash", "left")
    return j.select("id", "wanted", "found", F.when(F.col("found").isNull(), "absent").when(F.col("found") != F.col("wanted"), "other schema").alias("problem"))


def superseded(failures: DataFrame, key: str) -> DataFrame:
    """(key, code, superseded): the one failure that a step carries. One failure, or equal ones, are adopted; different ones are
    superseded by the step's own code, which names theirs, sorted, repeats kept (a step's calls are few)."""
    by = failures.groupBy(key).agg(F.array_sort(F.collect_list("code")).alias("codes"), F.count_distinct("code").alias("n"))
    return by.select(key, F.when(F.col("n") == 1, F.get("codes", F.lit(0))).otherwise("superseded").alias("code"), F.when(F.col("n") > 1, F.array_join("codes", ",")).alias("superseded"))


def free_candidate_ids(drafts: DataFrame, reserved: DataFrame, suffix: str = ":generated") -> DataFrame:
    """drafts (id, ...) with `candidate_id`: the id with as many suffixes as it takes to meet no reserved one (id).

    Reserved ids are split into a stem and a number of suffixes; the least number that isn't taken is found by counting those that
    stand at their own place.
    Drafts have ids of their own (a run and an ordinal).
    """
    stem = F.regexp_replace("id", f"({suffix})*$", "")
    held = reserved.select(stem.alias("stem"), ((F.length("id") - F.length(stem)) / len(suffix)).cast("long").alias("k")).distinct()
    place = F.row_number().over(Window.partitionBy("stem").orderBy("k")) - 1
    taken = held.withColumn("place", place).filter("k = place").groupBy("stem").agg(F.count(F.lit(1)).alias("n"))
    j = drafts.join(taken.withColumnRenamed("stem", "id"), "id", "left")
    return j.withColumn("candidate_id", F.concat("id", F.repeat(F.lit(suffix), F.coalesce("n", F.lit(0)).cast("int")))).drop("n")
