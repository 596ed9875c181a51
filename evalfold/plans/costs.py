"""Queries over cost rows, call attempts and result caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalfold.operators import costs as C
from evalfold.operators import spend as P
from evalfold.operators.logs import numbered
from evalfold.plans.registry import query
from evalfold.sources.staging import staged
from evalfold.sources.tables import attempts, cost_rows, ctes, outputs, read, trials

_USED = ctes("cost_rows") + """,
used AS (SELECT *, CASE WHEN cache_hit THEN 'cached' WHEN bare AND missing THEN 'dropped' WHEN bare AND failed AND NOT response_rejected THEN 'dropped' ELSE 'billable' END AS use
         FROM (SELECT *, prompt_tokens IS NULL AND completion_tokens IS NULL AND provider_cost IS NULL AS bare FROM cost_rows))"""


def _role(source: str, key: str) -> str:
    return f"""SELECT {key}, calls, cached, priced, missing_breakdown, prompt_tokens, completion_tokens, calls - priced AS unpriced, CASE WHEN calls = priced AND calls > 0 THEN usd END AS usd FROM (
SELECT {key}, count(*) FILTER (WHERE b) AS calls, count(*) FILTER (WHERE use = 'cached') AS cached, count(provider_cost) FILTER (WHERE b) AS priced, count(*) FILTER (WHERE b AND NOT t) AS missing_breakdown,
       (sum(prompt_tokens) FILTER (WHERE b AND t))::BIGINT AS prompt_tokens, (sum(completion_tokens) FILTER (WHERE b AND t))::BIGINT AS completion_tokens, round(sum(provider_cost) FILTER (WHERE b), 2) AS usd
FROM (SELECT *, use = 'billable' AS b, prompt_tokens IS NOT NULL AND completion_tokens IS NOT NULL AS t FROM {source}) GROUP BY {key})"""


@query(_USED + _role("used", "run_id"))
def role_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend of each run."""
    return C.role_cost(C.classified(cost_rows(spark, sf_dir)), ["run_id"])


@query(_USED + _role("used", "evidence_ref"))
def evidence_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend of each evidence record."""
    return C.role_cost(C.classified(cost_rows(spark, sf_dir)), ["evidence_ref"])


_REFS = """, st AS (SELECT o_orderpriority AS run_id, o_orderkey, o_custkey, CASE WHEN o_custkey % 5 = 0 THEN CASE WHEN o_custkey % 35 = 0 THEN 'no json' ELSE '{"evidence_ref":{"schema":"' || CASE WHEN o_custkey % 11 = 0 THEN 'other' ELSE 'eval_failure' END || '","content_hash":"' || (o_orderkey + 2) || '"}}' END END AS details FROM orders),
rf AS (SELECT run_id, 'eval_evidence' AS schema, o_orderkey AS k FROM st UNION ALL SELECT run_id, CASE WHEN o_orderkey % 9 = 0 THEN 'note' ELSE 'eval_evidence' END, o_orderkey - 1 FROM st WHERE o_custkey % 3 = 0 UNION ALL SELECT run_id, 'eval_evidence', o_orderkey FROM st WHERE o_custkey % 4 = 0
  UNION ALL SELECT run_id, 'eval_failure', o_orderkey + 2 FROM st WHERE o_custkey % 5 = 0 AND o_custkey % 35 <> 0 AND o_custkey % 11 <> 0),
di AS (SELECT DISTINCT run_id, schema, k FROM rf WHERE schema <> 'note'),
us AS (SELECT di.run_id, u.* EXCLUDE (run_id) FROM di JOIN used u ON u.evidence_ref = di.k WHERE di.k % 13 <> 0),
pc AS (SELECT o_orderpriority AS run_id, CASE WHEN o_custkey % 4 = 0 THEN CASE WHEN o_custkey % 8 = 0 THEN '' END ELSE o_custkey::VARCHAR END AS call_id, (o_custkey % 100)::BIGINT AS prompt_tokens, CASE WHEN o_custkey % 6 <> 1 THEN (o_custkey % 9)::BIGINT END AS completion_tokens, o_custkey % 17 * 0.25::DOUBLE AS provider_cost, 'billable' AS use FROM orders),
pd AS (SELECT * FROM pc WHERE coalesce(call_id, '') = '' UNION ALL SELECT DISTINCT * FROM pc WHERE call_id <> '')"""


@query(_USED + _REFS + " SELECT 'task_model' AS role, * FROM (" + _role("us", "run_id") + ") UNION ALL SELECT 'proposer', * FROM (" + _role("pd", "run_id") + ")")
def run_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend of each run by role: evidence that its steps cite, in whatever channel and however often, and its proposal calls."""
    ref = lambda schema, k: F.array(F.struct(F.lit(schema).alias("schema") if isinstance(schema, str) else schema.alias("schema"), k.cast("string").alias("content_hash")))
    key, c = F.col("o_orderkey"), F.col("o_custkey")
    o = read(spark, sf_dir, "orders")
    schema = F.when(c % 11 == 0, "other").otherwise(P.FAILURE)
    details = F.when(c % 5 == 0, F.when(c % 35 == 0, "no json").otherwise(F.to_json(F.struct(F.struct(schema.alias("schema"), (key + 2).cast("string").alias("content_hash")).alias("evidence_ref")))))
    steps = o.select(
        F.col("o_orderpriority").alias("run_id"), ref(P.EVIDENCE, key).alias("intent_refs"), F.when(c % 3 == 0, ref(F.when(key % 9 == 0, "note").otherwise(P.EVIDENCE), key - 1)).alias("search_refs"),
        F.when(c % 4 == 0, ref(P.EVIDENCE, key)).alias("tool_refs"), details.alias("tool_details"),
    )
    rows = cost_rows(spark, sf_dir)
    error = F.when(F.col("response_rejected"), '{"rejected_response":{"text":"no"}}').otherwise("{}")
    row = F.struct("row_ordinal", "prompt_tokens", "completion_tokens", "provider_cost", "cache_hit", "missing", "failed", error.alias("provider_error"))
    records = staged(rows.groupBy(F.col("evidence_ref").cast("string").alias("k")).agg(F.collect_list(row).alias("outputs")), "outputs")
    evidence = records.select(F.explode(F.array(F.lit(P.EVIDENCE), F.lit(P.FAILURE))).alias("schema"), F.col("k").alias("content_hash"), F.when(F.col("k").cast("long") % 13 != 0, F.concat(F.lit("outputs:"), "k")).alias("outputs_hash"))
    call = F.when(c % 4 == 0, F.when(c % 8 == 0, "")).otherwise(c.cast("string"))
    proposer = o.select(F.col("o_orderpriority").alias("run_id"), call.alias("call_id"), (c % 100).alias("prompt_tokens"), F.when(c % 6 != 1, c % 9).alias("completion_tokens"), ((c % 17) * 0.25).alias("provider_cost"))
    return P.run_cost(steps, evidence, records.select(F.concat(F.lit("outputs:"), "k").alias("content_hash"), "outputs"), proposer)


@query(_USED + "SELECT use, run_id, count(*) AS n FROM used GROUP BY ALL")
def billable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each run that are billable, cached or dropped."""
    return C.classified(cost_rows(spark, sf_dir)).groupBy("use", "run_id").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT o_custkey AS call_id, o_orderstatus AS role, greatest(floor(o_totalprice)::BIGINT - 50000, 0) AS prompt_tokens, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS cost FROM orders)
SELECT role, count(*) AS calls, sum(prompt_tokens)::BIGINT AS prompt_tokens, count(cost) AS priced, CASE WHEN count(cost) = count(*) THEN round(sum(cost), 2) END AS usd FROM p GROUP BY role""")
def proposer_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend of proposal calls by role; token counts are clamped at 0."""
    p = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("role"), F.greatest(F.floor("o_totalprice").cast("long") - 50000, F.lit(0)).cast("long").alias("prompt_tokens"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("cost"))
    return p.groupBy("role").agg(F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.count("cost").alias("priced"), C.strict_sum(F.col("cost"), 2).alias("usd"))


@query(ctes("attempts") + """,
b AS (SELECT logical_call_id, CASE WHEN count(prompt_tokens) = count(*) THEN sum(prompt_tokens)::BIGINT END AS prompt_tokens, CASE WHEN count(completion_tokens) = count(*) THEN sum(completion_tokens)::BIGINT END AS completion_tokens,
  CASE WHEN count(cost) = count(*) THEN round(sum(cost), 2) END AS cost FROM attempts WHERE outcome IN ('accepted', 'rejected') GROUP BY ALL),
l AS (SELECT logical_call_id, count(*) AS n_attempts, round(greatest(0, coalesce(arg_min(ended_at - started_at, attempt_number) FILTER (WHERE outcome = 'accepted'), arg_max(ended_at - started_at, attempt_number))), 9) AS latency FROM attempts GROUP BY ALL)
SELECT * FROM l LEFT JOIN b USING (logical_call_id)""")
def call_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Billed tokens, cost and latency of every call."""
    return C.call_telemetry(attempts(spark, sf_dir))


@query(ctes("attempts") + """,
c AS (SELECT *, coalesce(sum((outcome NOT IN ('rate-limit', 'timeout') OR attempt_number >= 3)::INT) OVER (PARTITION BY logical_call_id ORDER BY attempt_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM attempts)
SELECT logical_call_id, count(*) AS n_used, arg_max(outcome, attempt_number) AS final_outcome, bool_or(outcome = 'rate-limit') AS rate_limited FROM c WHERE before_ = 0 GROUP BY ALL""")
def retry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls after retrying rate limits and timeouts up to three times."""
    return C.retry_summary(attempts(spark, sf_dir), ["rate-limit", "timeout"], 3)


@query(ctes("attempts") + "SELECT outcome, count(*) AS n, outcome IN ('rate-limit', 'timeout') AS retryable, CASE outcome WHEN 'accepted' THEN 'success' WHEN 'rejected' THEN 'rejection' WHEN 'timeout' THEN 'timeout' ELSE 'rate-limit' END AS class FROM attempts GROUP BY outcome")
def retry_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts by class and whether the class is retried."""
    kind = F.when(F.col("outcome") == "accepted", "success").when(F.col("outcome") == "rejected", "rejection").when(F.col("outcome") == "timeout", "timeout").otherwise("rate-limit")
    return attempts(spark, sf_dir).groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).withColumn("retryable", F.col("outcome").isin("rate-limit", "timeout")).withColumn("class", kind)


@query("""WITH s AS (SELECT CASE WHEN l_linenumber = 1 THEN 408 WHEN l_partkey % 10 = 0 THEN 429 WHEN l_partkey % 10 < 3 THEN 500 WHEN l_partkey % 10 < 5 THEN 400 WHEN l_partkey % 10 < 6 THEN NULL ELSE 200 END AS status, l_suppkey % 17 = 0 AS exhausted FROM lineitem),
c AS (SELECT CASE WHEN status = 200 THEN 'success' WHEN status = 408 THEN 'timeout' WHEN status = 429 OR exhausted THEN 'rate-limit' WHEN status >= 500 THEN 'transport-error' WHEN status >= 400 THEN 'rejection' ELSE 'malformed' END AS class FROM s)
SELECT class, count(*) AS n FROM c GROUP BY class""")
def classify_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by transport class: timeouts first, then rate limits, transient, permanent, malformed."""
    p = F.col("l_partkey") % 10
    s = read(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") == 1, 408).when(p == 0, 429).when(p < 3, 500).when(p < 5, 400).when(p < 6, F.lit(None)).otherwise(200).alias("status"), (F.col("l_suppkey") % 17 == 0).alias("exhausted"))
    kind = F.when(F.col("status") == 200, "success").when(F.col("status") == 408, "timeout").when((F.col("status") == 429) | F.col("exhausted"), "rate-limit").when(F.col("status") >= 500, "transport-error").when(F.col("status") >= 400, "rejection").otherwise("malformed")
    return s.select(kind.alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT n AS attempt, CASE WHEN n = 1 THEN 0.0::DOUBLE ELSE least(1.0 * pow(2.0, n - 2), 60.0)::DOUBLE END AS delay, (sum(CASE WHEN n = 1 THEN 0 ELSE least(pow(2.0, n - 2), 60.0) END) OVER (ORDER BY n) + n * 30.0 + 15.0)::DOUBLE AS guard_seconds FROM range(1, 13) AS r(n)""")
def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delay before each attempt (doubling from 1 s to 60 s) and the seconds that guard all attempts so far."""
    n = spark.range(1, 13).withColumnRenamed("id", "attempt")
    delay = F.when(F.col("attempt") == 1, 0.0).otherwise(F.least(F.pow(F.lit(2.0), F.col("attempt") - 2), F.lit(60.0)))
    delays = F.transform(F.sequence(F.lit(1).cast("long"), "attempt"), lambda a: F.when(a == 1, 0.0).otherwise(F.least(F.pow(F.lit(2.0), a - 2), F.lit(60.0))))
    return n.withColumn("delay", delay).withColumn("guard_seconds", F.aggregate(delays, F.lit(0.0), lambda a, x: a + x) + F.col("attempt") * 30.0 + 15.0)


_KEYED = "k AS (SELECT *, sha256(concat_ws('|', l_partkey::VARCHAR, l_returnflag, (l_linenumber % 3)::VARCHAR)) AS cache_key, row_number() OVER (PARTITION BY l_partkey, l_returnflag, l_linenumber % 3 ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS nth FROM lineitem)"


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    drive = (F.col("l_linenumber") % 3).cast("string")
    key = F.sha2(F.concat_ws("|", F.col("l_partkey").cast("string"), "l_returnflag", drive), 256)
    w = Window.partitionBy("cache_key").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    return read(spark, sf_dir, "lineitem").withColumn("cache_key", key).withColumn("nth", F.row_number().over(w))


@query("WITH " + _KEYED + "SELECT l_returnflag AS run_id, count(*) FILTER (WHERE nth = 1) AS misses, count(*) FILTER (WHERE nth > 1) AS hits, count(*) FILTER (WHERE nth = 1) AS stores FROM k GROUP BY ALL")
def cache_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, misses and stores of a result cache: the first call of a key misses and stores."""
    first = F.col("nth") == 1
    return _keyed(spark, sf_dir).groupBy(F.col("l_returnflag").alias("run_id")).agg(C.count_if(first).alias("misses"), C.count_if(~first).alias("hits"), C.count_if(first).alias("stores"))


@query("WITH " + _KEYED + "SELECT cache_key, l_orderkey AS writer, l_extendedprice AS result FROM k WHERE nth = 1")
def cache_first_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cache key's entry: what its first writer stored."""
    best = F.min(F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")).alias("b")
    return _keyed(spark, sf_dir).drop("nth").groupBy("cache_key").agg(best).select("cache_key", F.col("b.l_orderkey").alias("writer"), F.col("b.l_extendedprice").alias("result"))


@query("SELECT DISTINCT sha256(concat_ws('|', l_partkey::VARCHAR, l_returnflag, (l_linenumber % 3)::VARCHAR)) AS cache_key FROM lineitem")
def cache_key_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct cache keys."""
    return _keyed(spark, sf_dir).select("cache_key").distinct()


_CACHE = """, lg AS (SELECT candidate_id AS unit, CASE WHEN event_id % 5 = 0 THEN 'official' ELSE 'internal_eval' END AS phase, task_id AS request, event_id AS arrival, event_id % 4 = 0 AS cache_hit, CASE WHEN event_id % 12 <> 0 THEN 'call-' || event_id END AS source, state = 'failed' AS deadline FROM trials),
pl AS (SELECT DISTINCT candidate_id AS unit, task_id AS request FROM trials WHERE task_id % 3 <> 0),
ow AS (SELECT lg.* FROM lg SEMI JOIN pl USING (unit, request) WHERE phase = 'internal_eval')"""


@query(ctes("trials") + _CACHE + " SELECT unit, count(*) AS partial_rows, count(*) FILTER (WHERE cache_hit) AS cache_hits, count(source) FILTER (WHERE cache_hit) AS n_sources, bool_or(deadline) AS deadline_reached FROM ow GROUP BY unit")
def cache_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each candidate, the logged rows of one phase and its own requests: rows, cache hits, cited sources, and any deadline."""
    own = _cached(spark, sf_dir)
    return own.groupBy("unit").agg(F.count(F.lit(1)).alias("partial_rows"), C.count_if(F.col("cache_hit")).alias("cache_hits"), F.count(F.when(F.col("cache_hit"), F.col("source"))).alias("n_sources"), F.max("deadline").alias("deadline_reached"))


@query(ctes("trials") + _CACHE + " SELECT unit, row_number() OVER (PARTITION BY unit ORDER BY arrival) AS nth, source FROM ow WHERE cache_hit AND source IS NOT NULL")
def cache_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls that those cache hits came from, in order of the log, one row each."""
    hits = _cached(spark, sf_dir).filter(F.col("cache_hit") & F.col("source").isNotNull())
    return numbered(hits, ["unit"], F.floor(F.col("at") / 100_000), ["at"], "nth").select("unit", "nth", "source")


def _cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trials(spark, sf_dir)
    log = t.select(
        F.col("candidate_id").alias("unit"), F.when(F.col("event_id") % 5 == 0, "official").otherwise("internal_eval").alias("phase"), F.col("task_id").alias("request"), F.col("event_id").alias("at"),
        (F.col("event_id") % 4 == 0).alias("cache_hit"), F.when(F.col("event_id") % 12 != 0, F.concat(F.lit("call-"), F.col("event_id").cast("string"))).alias("source"), (F.col("state") == "failed").alias("deadline"),
    )
    planned = t.filter("task_id % 3 <> 0").select(F.col("candidate_id").alias("unit"), F.col("task_id").alias("request")).distinct()
    return log.filter("phase = 'internal_eval'").join(planned, ["unit", "request"], "left_semi")


@query(ctes("attempts") + "SELECT logical_call_id, attempt_number, outcome, cost FROM attempts QUALIFY row_number() OVER (PARTITION BY logical_call_id ORDER BY attempt_number DESC) = 1")
def partial_log_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest record of every key of an append log."""
    last = F.max_by(F.struct("attempt_number", "outcome", "cost"), "attempt_number").alias("l")
    return attempts(spark, sf_dir).groupBy("logical_call_id").agg(last).select("logical_call_id", "l.*")


@query(ctes("attempts") + "SELECT DISTINCT logical_call_id, outcome FROM attempts")
def partial_log_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct keys of an append log."""
    return attempts(spark, sf_dir).select("logical_call_id", "outcome").distinct()


@query("""SELECT event_type AS kind, count(*) AS n, count(*) FILTER (WHERE trim(coalesce(props, '')) = '') AS blank FROM events GROUP BY event_type""")
def blank_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of each kind and how many are blank."""
    blank = F.length(F.regexp_replace(F.coalesce("props", F.lit("")), r"(?U)\s", "")) == 0
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), C.count_if(blank).alias("blank"))
