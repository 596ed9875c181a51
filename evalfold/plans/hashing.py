"""Queries over identities, configurations and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalfold.plans.registry import query
from evalfold.sources.staging import staged
from evalfold.sources.tables import ctes, read, traces, trials


@query("""SELECT l_orderkey, l_linenumber, sha256('{"payload":{"part":' || l_partkey || ',"supplier":' || l_suppkey || '},"schema":"row","schema_version":1}') AS identity, 'row:' || substr(sha256('{"payload":{"part":' || l_partkey || ',"supplier":' || l_suppkey || '},"schema":"row","schema_version":1}'), 1, 16) AS work_key FROM lineitem""")
def identity_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities: SHA-256 of schema, version and payload as compact JSON with sorted keys."""
    payload = F.struct(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"))
    h = F.sha2(F.to_json(F.struct(payload.alias("payload"), F.lit("row").alias("schema"), F.lit(1).alias("schema_version"))).cast("binary"), 256)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", h.alias("identity"), F.concat(F.lit("row:"), F.substring(h, 1, 16)).alias("work_key"))


_INSTRUCTIONS, _DEMOS = 12, 9


@query(f"""WITH t AS (SELECT p_partkey AS trial, p_size % 14 AS i0, p_partkey % 10 AS d0, CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE p_size % 5 END AS i1, p_partkey % 7 AS d1 FROM part),
r AS (SELECT *, i1 IS NULL AS lacks, i0 >= {_INSTRUCTIONS} OR d0 >= {_DEMOS} AS outside FROM t)
SELECT trial, CASE WHEN lacks THEN 'other parameters than the space' WHEN outside THEN 'outside its search space' END AS problem,
CASE WHEN NOT lacks AND NOT outside THEN ((i0 * {_DEMOS} + d0) * {_INSTRUCTIONS} + i1) * {_DEMOS} + d1 END AS combination,
CASE WHEN NOT lacks AND NOT outside THEN sha256('[{{"predictor_index":0,"instruction_index":' || i0 || ',"instruction_identity_hash":"' || md5('i0|' || i0) || '","demo_index":' || d0 || ',"demo_identity_hash":"' || md5('d0|' || d0) || '"}},{{"predictor_index":1,"instruction_index":' || i1 || ',"instruction_identity_hash":"' || md5('i1|' || i1) || '","demo_index":' || d1 || ',"demo_identity_hash":"' || md5('d1|' || d1) || '"}}]') END AS combination_hash FROM r""")
def param_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials' parameters in the space's order (instruction, then demos, of each predictor), checked, numbered and hashed."""
    k = F.col("p_partkey")
    given = F.map_from_entries(F.filter(F.array(
        F.struct(F.lit("1_predictor_demos").alias("key"), (k % 7).cast("long").alias("value")), F.struct(F.lit("0_predictor_demos").alias("key"), (k % 10).cast("long").alias("value")),
        F.struct(F.lit("0_predictor_instruction").alias("key"), (F.col("p_size") % 14).cast("long").alias("value")), F.struct(F.lit("1_predictor_instruction").alias("key"), F.when(k % 23 != 0, F.col("p_size") % 5).cast("long").alias("value")),
    ), lambda e: e["value"].isNotNull()))
    names = [f"{p}_predictor_{kind}" for p in (0, 1) for kind in ("instruction", "demos")]
    sizes = [_INSTRUCTIONS, _DEMOS] * 2
    t = read(spark, sf_dir, "part").select(k.alias("trial"), given.alias("given"))
    values = [F.col("given")[n] for n in names]
    lacks = F.array_sort(F.map_keys("given")) != F.lit(sorted(names))
    outside = F.greatest(*((~v.between(0, n - 1)).cast("int") for v, n in zip(values, sizes))) == 1
    number = values[0]
    for v, n in zip(values[1:], sizes[1:]):
        number = number * n + v
    one = lambda p: F.struct(
        F.lit(p).alias("predictor_index"), *(c for kind, mark, v in (("instruction", "i", values[2 * p]), ("demo", "d", values[2 * p + 1])) for c in (
            v.alias(f"{kind}_index"), F.md5(F.concat(F.lit(f"{mark}{p}|"), v.cast("string")).cast("binary")).alias(f"{kind}_identity_hash"))))
    problem = F.when(lacks, "other parameters than the space").when(outside, "outside its search space")
    return t.select("trial", problem.alias("problem"), F.when(problem.isNull(), number).alias("combination"), F.when(problem.isNull(), F.sha2(F.to_json(F.array(one(0), one(1))).cast("binary"), 256)).alias("combination_hash"))


@query("SELECT c_custkey AS config_id, count(DISTINCT o_orderpriority || o_orderstatus) AS n_layers, count(DISTINCT o_orderpriority || o_orderstatus) = 6 AS complete, sha256(string_agg(DISTINCT o_orderpriority || o_orderstatus, '|' ORDER BY o_orderpriority || o_orderstatus)) AS config_hash FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def config_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations of layers: complete with exactly six, hashed in order."""
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    layers = F.array_sort(F.collect_set(F.concat("o_orderpriority", "o_orderstatus")))
    by = o.groupBy(F.col("c_custkey").alias("config_id")).agg(layers.alias("l"))
    return by.select("config_id", F.size("l").cast("long").alias("n_layers"), (F.size("l") == 6).alias("complete"), F.sha2(F.array_join("l", "|").cast("binary"), 256).alias("config_hash"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 13 <> 0 OR c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'default' END END AS segment, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey::BIGINT ELSE 3 END AS repeats,
CASE WHEN c_custkey % 11 = 0 THEN 'unknown: colour' WHEN c_custkey % 13 = 0 AND c_custkey % 3 <> 0 THEN 'unassigned: segment' WHEN c_custkey % 2 = 0 AND c_nationkey > 20 THEN 'not allowed: repeats' END AS problem FROM customer""")
def resolve_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables resolved from defaults and each row's assignment; unknown, unassigned and disallowed ones are reported.

    Every thirteenth specification has no default for the segment; repeats of more than 20 aren't allowed.
    """
    k = F.col("c_custkey")
    entry = lambda name, value, holds: F.when(holds, F.struct(F.lit(name).alias("key"), value.cast("string").alias("value")))
    as_map = lambda *entries: F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))
    defaults = as_map(entry("segment", F.lit("default"), k % 13 != 0), entry("repeats", F.lit(3), F.lit(True)))
    given = as_map(entry("segment", F.col("c_mktsegment"), k % 3 == 0), entry("repeats", F.col("c_nationkey"), k % 2 == 0), entry("colour", F.lit("red"), k % 11 == 0))
    spec = F.array(F.lit("segment"), F.lit("repeats"))
    r = read(spark, sf_dir, "customer").select(k.alias("id"), defaults.alias("defaults"), given.alias("given"))
    r = r.withColumn("all", F.map_concat(F.map_filter("defaults", lambda n, _: ~F.array_contains(F.map_keys(F.col("given")), n)), F.col("given")))
    unknown, missing = F.array_except(F.map_keys("given"), spec), F.array_except(spec, F.map_keys("all"))
    problem = F.when(F.size(unknown) > 0, F.concat(F.lit("unknown: "), F.array_join(unknown, ","))).when(F.size(missing) > 0, F.concat(F.lit("unassigned: "), F.array_join(missing, ","))).when(F.col("all")["repeats"].cast("long") > 20, "not allowed: repeats")
    return r.select("id", F.col("all")["segment"].alias("segment"), F.col("all")["repeats"].cast("long").alias("repeats"), problem.alias("problem"))


@query("""WITH f AS (SELECT event_id, event_type AS kind, value, CASE WHEN event_id % 23 = 0 THEN '' ELSE 'usd' END AS unit, CASE WHEN event_id % 3 = 0 THEN 'step' END AS step, CASE WHEN event_id % 3 = 0 AND event_id % 31 <> 0 OR event_id % 37 = 0 THEN '1' END AS step_version, (event_id % 5)::INT AS n_sources FROM events),
p AS (SELECT kind, value, CASE WHEN unit = '' THEN 'no unit' WHEN (step IS NULL) <> (step_version IS NULL) THEN 'half a lineage' WHEN n_sources = 0 THEN 'no source' WHEN NOT isfinite(value) THEN 'not finite' END AS problem FROM f)
SELECT kind, coalesce(problem, 'ok') AS problem, count(*) AS n, count(*) FILTER (WHERE value < 0) AS n_negative FROM p GROUP BY ALL""")
def check_metric_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric facts and scores of each kind by what is wrong with them: no unit, half a lineage, no source, no finite value."""
    i, v = F.col("event_id"), F.col("value")
    f = read(spark, sf_dir, "events").select(
        F.col("event_type").alias("kind"), v, F.when(i % 23 == 0, "").otherwise("usd").alias("unit"), F.when(i % 3 == 0, "step").alias("step"),
        F.when(((i % 3 == 0) & (i % 31 != 0)) | (i % 37 == 0), "1").alias("step_version"), F.slice(F.array(*map(F.lit, "abcd")), F.lit(1), (i % 5).cast("int")).alias("derived_from"),
    )
    finite = ~F.isnan(v) & (F.abs(v) < float("inf"))
    problem = F.when(F.col("unit") == "", "no unit").when(F.col("step").isNull() != F.col("step_version").isNull(), "half a lineage").when(F.size("derived_from") == 0, "no source").when(~finite, "not finite").otherwise("ok")
    return f.groupBy("kind", problem.alias("problem")).agg(F.count(F.lit(1)).alias("n"), F.count_if(v < 0).alias("n_negative"))


_STAMP = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE event_id % 5 WHEN 0 THEN '+00:00' WHEN 1 THEN '' WHEN 2 THEN 'Z' WHEN 3 THEN '-05:30' ELSE '+0100' END"


@query(f"""WITH t AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '2024-13' || substr({_STAMP}, 8) ELSE {_STAMP} END AS stamp FROM events)
SELECT event_id, stamp FROM t WHERE event_id % 5 IN (1, 4) OR event_id % 7 = 0""")
def check_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps that aren't ISO 8601 with an offset of hours and minutes."""
    p = F.col("event_id") % 5
    offset = F.when(p == 0, "+00:00").when(p == 1, "").when(p == 2, "Z").when(p == 3, "-05:30").otherwise("+0100")
    at = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), offset)
    rows = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("2024-13"), F.substring(at, 8, 100))).otherwise(at).alias("stamp"))
    return rows.filter(~F.col("stamp").rlike(r"(Z|[+-]\d\d:\d\d)$") | F.try_to_timestamp(F.col("stamp")).isNull())


@query(ctes("trials", "traces") + """, tr AS (SELECT trace_id AS task_id, trace_index % 3 AS seed_index, count(*) AS n_steps, bool_or(text IS NULL) AS malformed FROM traces GROUP BY ALL)
SELECT candidate_id, task_id, seed_index, coalesce(n_steps, 0) AS n_steps, coalesce(malformed, false) AS malformed FROM trials LEFT JOIN tr USING (task_id, seed_index)""")
def outputs_with_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output rows with the trace of their task and seed: none means no steps; a step without text makes the trace malformed."""
    steps = traces(spark, sf_dir).groupBy(F.col("trace_id").alias("task_id"), (F.col("trace_index") % 3).alias("seed_index")).agg(F.count(F.lit(1)).alias("n_steps"), F.max(F.col("text").isNull()).alias("malformed"))
    j = trials(spark, sf_dir).join(steps, ["task_id", "seed_index"], "left")
    return j.select("candidate_id", "task_id", "seed_index", F.coalesce("n_steps", F.lit(0)).alias("n_steps"), F.coalesce("malformed", F.lit(False)).alias("malformed"))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored evidence records: evidence_ref, outputs (array of rows with score), values (of each row number), aggregate; every
    fiftieth aggregate was changed after it was stored."""
    row = F.struct(F.col("l_linenumber").alias("row_ordinal"), F.col("l_partkey").alias("part"), F.col("l_extendedprice").alias("score"))
    total = F.round(F.sum("l_extendedprice"), 2) + F.when(F.col("l_orderkey") % 50 == 0, 1.0).otherwise(0.0)
    by = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("outputs"), total.alias("aggregate"))
    return staged(by.withColumnRenamed("l_orderkey", "evidence_ref"), "evidence")


@query("SELECT l_orderkey AS evidence_ref, l_linenumber AS row_ordinal, l_extendedprice AS score FROM lineitem")
def evidence_outputs_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored evidence records' output rows, out of their nested arrays."""
    return _evidence(spark, sf_dir).select("evidence_ref", F.inline("outputs")).drop("part")


@query("SELECT l_orderkey AS evidence_ref, round(sum(l_extendedprice), 2) AS derived, round(round(sum(l_extendedprice), 2) + CASE WHEN l_orderkey % 50 = 0 THEN 1.0::DOUBLE ELSE 0 END, 2) AS stored, count(*) AS n_rows, l_orderkey % 50 <> 0 AS equal FROM lineitem GROUP BY l_orderkey")
def check_rederive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored aggregates against those derived again from the stored rows."""
    e = _evidence(spark, sf_dir)
    again = e.select("evidence_ref", F.explode("outputs.score").alias("score")).groupBy("evidence_ref").agg(F.round(F.sum("score"), 2).alias("derived"), F.count(F.lit(1)).alias("n_rows"))
    j = e.select("evidence_ref", F.round("aggregate", 2).alias("stored")).join(again, "evidence_ref")
    return j.select("evidence_ref", "derived", "stored", "n_rows", (F.col("derived") == F.col("stored")).alias("equal"))
