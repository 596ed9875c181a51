"""Reading tables, and the evaluation tables that the driver's star schema is projected to.

Every projection covers its whole table; states and flags are derived from keys, no row is left out. `CTES` holds the same
projections as DuckDB common table expressions, for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalfold.operators.claims import claim_events
from evalfold.operators.logs import numbered


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` under `sf_dir`; timestamps as they are stored."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def when_in_order(*cases: tuple, otherwise=None):
    """A CASE over (condition, value) pairs, the first that holds."""
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise)


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed rows: candidate_id, task_id, seed_index, state (scored, missing, failed, invalid), score, value, event_id."""
    e = read(spark, sf_dir, "events")
    seed = F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy("event_id")) - 1
    state = when_in_order((F.col("event_id") % 13 == 0, F.lit("missing")), (F.col("event_id") % 17 == 0, F.lit("failed")), (F.col("event_id") % 19 == 0, F.lit("invalid")), otherwise=F.lit("scored"))
    rows = e.select(F.col("event_type").alias("candidate_id"), F.col("user_id").alias("task_id"), seed.cast("long").alias("seed_index"), state.alias("state"), "value", "event_id")
    return rows.withColumn("score", F.when(F.col("state") == "scored", F.when(F.col("value") >= 35, 1.0).otherwise(0.0)))


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output rows with flags: missing, failed, invalid, failure_code, score (null where any flag holds)."""
    t = trials(spark, sf_dir)
    code = F.when(F.col("event_id") % 3 == 0, "provider-rejection").when(F.col("event_id") % 3 == 1, "blank-provider-generation").otherwise("transport-error")
    return t.select(
        "candidate_id", "task_id", "seed_index", "event_id", "value", "score", (F.col("state") == "missing").alias("missing"), (F.col("state") == "failed").alias("failed"),
        (F.col("state") == "invalid").alias("invalid"), F.when(F.col("state") == "failed", code).otherwise("").alias("failure_code"),
    )


def cost_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Billed rows: run_id, evidence_ref, tokens and cost with nulls for what is unknown, and status flags."""
    li = read(spark, sf_dir, "lineitem")
    missing = F.col("l_suppkey") % 13 == 0
    return li.select(
        F.col("l_returnflag").alias("run_id"), F.col("l_orderkey").alias("evidence_ref"), F.col("l_linenumber").cast("long").alias("row_ordinal"),
        F.when(F.col("l_linenumber") < 5, F.col("l_quantity").cast("long")).alias("prompt_tokens"),
        F.when(F.col("l_linenumber") < 4, F.round(F.col("l_tax") * 100).cast("long")).alias("completion_tokens"),
        F.when(F.col("l_discount") >= 0.02, F.col("l_extendedprice")).alias("provider_cost"),
        (F.col("l_partkey") % 11 == 0).alias("cache_hit"), missing.alias("missing"), ((F.col("l_suppkey") % 7 == 0) & ~missing).alias("failed"), (F.col("l_partkey") % 3 == 0).alias("response_rejected"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call attempts: logical_call_id, attempt_number from 1, outcome, tokens, cost, started_at, ended_at."""
    li = read(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return li.select(
        F.col("l_orderkey").alias("logical_call_id"), F.row_number().over(w).cast("long").alias("attempt_number"),
        when_in_order((F.col("l_partkey") % 4 == 0, F.lit("accepted")), (F.col("l_partkey") % 4 == 1, F.lit("rejected")), (F.col("l_partkey") % 4 == 2, F.lit("rate-limit")), otherwise=F.lit("timeout")).alias("outcome"),
        F.when(F.col("l_suppkey") % 9 != 0, F.col("l_quantity").cast("long")).alias("prompt_tokens"),
        F.when(F.col("l_suppkey") % 8 != 0, F.round(F.col("l_tax") * 100).cast("long")).alias("completion_tokens"),
        F.when(F.col("l_discount") >= 0.01, F.col("l_extendedprice")).alias("cost"),
        F.col("l_linenumber").cast("double").alias("started_at"), (F.col("l_linenumber") + F.col("l_discount") * 10 - 0.2).alias("ended_at"),
    )


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured proposals: ordinal, round of ten, instruction, reward."""
    p = read(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("ordinal"), F.col("p_brand").alias("instruction"), F.col("p_size").cast("double").alias("reward"))
    return rows.withColumn("round_index", F.floor(F.col("ordinal") / 10).cast("long"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim events in order for each intent: owner, generation (one more at each change of owner), heartbeat within it."""
    e = read(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("intent"), F.col("event_type").alias("owner"), "value", "event_id", "ts")
    return claim_events(rows, "intent", ["ts", "event_id"], "owner").drop("ts")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls in order of arrival for each scope."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("scope"), F.col("o_orderkey").alias("call_id"), F.col("o_totalprice").alias("debit"), "o_orderstatus", F.col("o_orderdate").alias("at"))
    return numbered(o, ["scope"], F.to_date("at"), ["at", "call_id"], "arrival").drop("at")


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tasks of three split roles; equal texts have equal hashes, so copies in two roles are leaks."""
    d = read(spark, sf_dir, "documents")
    role = F.when(F.col("doc_id") % 10 < 6, "internal_eval").when(F.col("doc_id") % 10 < 8, "official").otherwise("held_out")
    return d.select("doc_id", role.alias("role"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("task_hash"), "source", "lang")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pool members: pool_key, role, pos, task_id."""
    d = read(spark, sf_dir, "documents")
    role = F.when(F.col("doc_id") % 3 == 0, "train").when(F.col("doc_id") % 3 == 1, "val").otherwise("test")
    rows = d.select(F.col("lang").alias("pool_key"), role.alias("role"), F.col("doc_id").alias("task_id"), "source")
    return numbered(rows, ["pool_key", "role"], F.floor(F.col("task_id") / 10_000), ["task_id"], "pos").withColumn("pos", F.col("pos") - 1)


def pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task_id, rate): the share of good labels in the task's source."""
    d = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels")
    rates = d.join(labels, "doc_id").groupBy("source").agg(F.round(F.avg(F.col("quality").cast("double")), 9).alias("rate"))
    return d.join(rates, "source").select(F.col("doc_id").alias("task_id"), "rate")


def documents_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) of all documents; a null text is empty."""
    return read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored trials of a study: trial_number, combination, score, is_full (every sixth)."""
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("trial_number"), (F.col("o_custkey") % 60).alias("combination"), (F.floor(F.col("o_totalprice") / 10 + 0.5) / 100).alias("score"), ((F.col("o_orderkey") % 6) == 5).alias("is_full"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace steps: trace_id, trace_index, component_id, text."""
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("trace_id"), F.col("turn").cast("long").alias("trace_index"), F.col("role").alias("component_id"), "text")


_CTE = {
    "trials": """trials AS (SELECT *, CASE WHEN state = 'scored' THEN CASE WHEN value >= 35 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS score FROM (
  SELECT event_type AS candidate_id, user_id AS task_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) - 1 AS seed_index,
         CASE WHEN event_id % 13 = 0 THEN 'missing' WHEN event_id % 17 = 0 THEN 'failed' WHEN event_id % 19 = 0 THEN 'invalid' ELSE 'scored' END AS state, value, event_id FROM events))""",
    "outputs": """outputs AS (SELECT candidate_id, task_id, seed_index, event_id, value, score, state = 'missing' AS missing, state = 'failed' AS failed, state = 'invalid' AS invalid,
  CASE WHEN state = 'failed' THEN CASE event_id % 3 WHEN 0 THEN 'provider-rejection' WHEN 1 THEN 'blank-provider-generation' ELSE 'transport-error' END ELSE '' END AS failure_code FROM trials)""",
    "cost_rows": """cost_rows AS (SELECT l_returnflag AS run_id, l_orderkey AS evidence_ref, l_linenumber AS row_ordinal, CASE WHEN l_linenumber < 5 THEN l_quantity::BIGINT END AS prompt_tokens,
  CASE WHEN l_linenumber < 4 THEN round(l_tax * 100)::BIGINT END AS completion_tokens, CASE WHEN l_discount >= 0.02 THEN l_extendedprice END AS provider_cost, l_partkey % 11 = 0 AS cache_hit,
  l_suppkey % 13 = 0 AS missing, l_suppkey % 7 = 0 AND NOT l_suppkey % 13 = 0 AS failed, l_partkey % 3 = 0 AS response_rejected FROM lineitem)""",
    "attempts": """attempts AS (SELECT l_orderkey AS logical_call_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS attempt_number,
  CASE l_partkey % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' WHEN 2 THEN 'rate-limit' ELSE 'timeout' END AS outcome, CASE WHEN l_suppkey % 9 <> 0 THEN l_quantity::BIGINT END AS prompt_tokens,
  CASE WHEN l_suppkey % 8 <> 0 THEN round(l_tax * 100)::BIGINT END AS completion_tokens, CASE WHEN l_discount >= 0.01 THEN l_extendedprice END AS cost,
  l_linenumber::DOUBLE AS started_at, l_linenumber + l_discount * 10 - 0.2 AS ended_at FROM lineitem)""",
    "proposals": "proposals AS (SELECT p_partkey AS ordinal, p_brand AS instruction, p_size::DOUBLE AS reward, p_partkey // 10 AS round_index FROM part)",
    "claims": """claims AS (SELECT *, row_number() OVER (PARTITION BY intent, generation ORDER BY event_ordinal) - 1 AS heartbeat FROM (
  SELECT intent, event_ordinal, owner, value, event_id, sum(_new) OVER (PARTITION BY intent ORDER BY event_ordinal)::BIGINT AS generation FROM (
    SELECT user_id AS intent, row_number() OVER w AS event_ordinal, event_type AS owner, value, event_id, CASE WHEN event_type <> lag(event_type) OVER w THEN 1 ELSE 0 END AS _new
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))))""",
    "ledger": """ledger AS (SELECT o_orderpriority AS scope, o_orderkey AS call_id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS arrival, o_totalprice AS debit, o_orderstatus FROM orders)""",
    "splits": """splits AS (SELECT doc_id, CASE WHEN doc_id % 10 < 6 THEN 'internal_eval' WHEN doc_id % 10 < 8 THEN 'official' ELSE 'held_out' END AS role, md5(coalesce(text, '')) AS task_hash, source, lang FROM documents)""",
    "manifest": """manifest AS (SELECT lang AS pool_key, role, doc_id AS task_id, source, row_number() OVER (PARTITION BY lang, role ORDER BY doc_id) - 1 AS pos
  FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS role FROM documents))""",
    "pass_rates": """pass_rates AS (SELECT d.doc_id AS task_id, rate FROM documents d JOIN (SELECT source, round(avg(quality::DOUBLE), 9) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY source) USING (source))""",
    "study": "study AS (SELECT o_orderkey AS trial_number, o_custkey % 60 AS combination, floor(o_totalprice / 10 + 0.5) / 100 AS score, o_orderkey % 6 = 5 AS is_full FROM orders)",
    "traces": "traces AS (SELECT conv_id AS trace_id, turn::BIGINT AS trace_index, role AS component_id, text FROM conversations)",
}
_NEEDS = {"outputs": ["trials"]}


def ctes(*names: str) -> str:
    """WITH and the projections of these names (and what they build on), ready for a SELECT or, after a comma, more of them."""
    every: dict[str, None] = {}
    for n in names:
        every |= dict.fromkeys([*_NEEDS.get(n, []), n])
    return "WITH " + ",\n".join(_CTE[n] for n in every)
