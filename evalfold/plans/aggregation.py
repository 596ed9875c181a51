"""Queries over planned and observed trials: attribution, means, accounting, rewards and matrix checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalfold.functions import attribution
from evalfold.operators import aggregates as A
from evalfold.operators import checks
from evalfold.plans.registry import query
from evalfold.sources.tables import ctes, outputs, traces, trials

#: Share of rows that aren't scored beyond which a candidate has missing data under the skip policy.
MAX_SKIP = 0.18


def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole matrix (as many repeats as the fullest cell has) with what was observed in it."""
    t = trials(spark, sf_dir)
    last = t.agg(F.max("seed_index")).first()[0]
    if last is None:
        return t.select("candidate_id", "task_id", "seed_index", "state", "score")
    return A.fill_missing(A.plan_expand(t.select("candidate_id").distinct(), t.select("task_id").distinct(), last + 1), t)


PLAN = ctes("trials") + """,
k AS (SELECT max(seed_index) + 1 AS k FROM trials),
plan AS (SELECT candidate_id, task_id, seed_index FROM (SELECT DISTINCT candidate_id FROM trials), (SELECT DISTINCT task_id FROM trials), k, unnest(range(0, k)) AS s(seed_index)),
rows_ AS (SELECT candidate_id, task_id, seed_index, coalesce(state, 'missing') AS state, score FROM plan LEFT JOIN trials USING (candidate_id, task_id, seed_index))
"""


def _means(propagate: bool, per: str = "candidate_id", source: str = "rows_") -> str:
    missing = "WHEN p < a THEN 'missing_data' " if propagate else ""
    status = f"CASE WHEN a = 0 THEN 'not_applicable' {missing}WHEN p = 0 THEN 'zero_denominator' ELSE 'ok' END"
    return f"""
t AS (SELECT *, {status} AS st FROM (SELECT {per}, task_id, count(*) FILTER (WHERE state <> 'invalid') AS a, count(score) FILTER (WHERE state <> 'invalid') AS p, sum(score) FILTER (WHERE state <> 'invalid') AS s FROM {source} GROUP BY ALL)),
v AS (SELECT {per}, task_id, st, CASE WHEN st = 'ok' THEN s / p END AS value FROM t),
o AS (SELECT *, {status} AS st FROM (SELECT {per}, count(*) FILTER (WHERE st <> 'not_applicable') AS a, count(value) FILTER (WHERE st <> 'not_applicable') AS p, sum(value) FILTER (WHERE st <> 'not_applicable') AS s FROM v GROUP BY ALL)),
n AS (SELECT {per}, count(*) AS n_planned, count(*) FILTER (WHERE state = 'scored') AS n_scored, count(*) FILTER (WHERE state = 'missing') AS n_missing, count(*) FILTER (WHERE state = 'failed') AS n_failed, count(*) FILTER (WHERE state = 'invalid') AS n_invalid FROM {source} GROUP BY ALL)
"""


@query(PLAN + "," + _means(True) + "SELECT candidate_id, CASE WHEN st = 'ok' THEN round(s / p, 9) END AS value, st AS status, n_planned, n_scored, n_missing, n_failed, n_invalid FROM o JOIN n USING (candidate_id)")
def task_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates' task means where any missing trial makes its task, and so the candidate, incomplete."""
    return A.task_mean(planned(spark, sf_dir))


@query(PLAN.replace("LEFT JOIN", "JOIN") + "," + _means(False) + f"""
SELECT candidate_id, CASE WHEN st = 'ok' AND NOT skipped THEN round(s / p, 9) END AS value, CASE WHEN skipped THEN 'missing_data' ELSE st END AS status, n_planned, n_scored, n_missing, n_failed, n_invalid
FROM (SELECT *, (n_missing + n_failed + n_invalid) / n_planned > {MAX_SKIP} AS skipped FROM o JOIN n USING (candidate_id))""")
def task_mean_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates' task means over the observed trials, skipping those without score up to a tolerated share."""
    return A.task_mean(trials(spark, sf_dir), propagate=False, max_skip=MAX_SKIP)


@query(PLAN + "SELECT candidate_id, count(*) AS planned, count(*) FILTER (WHERE state = 'scored') AS scored, count(*) FILTER (WHERE state = 'missing') AS missing, count(*) FILTER (WHERE state = 'failed') AS failed, count(*) FILTER (WHERE state = 'invalid') AS invalid FROM rows_ GROUP BY candidate_id")
def row_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned trials of each candidate by state."""
    return A.row_accounting(planned(spark, sf_dir), ["candidate_id"])


@query(ctes("trials") + "SELECT candidate_id, task_id, count(*) AS n_total, count(*) FILTER (WHERE state <> 'invalid') AS n_applicable, count(score) FILTER (WHERE state <> 'invalid') AS n_present, CASE WHEN n_applicable = 0 THEN 'not_applicable' WHEN n_present < n_applicable THEN 'missing_data' WHEN n_present = 0 THEN 'zero_denominator' ELSE 'ok' END AS status, CASE WHEN status = 'ok' THEN round(sum(score) / n_present, 9) END AS value FROM trials GROUP BY candidate_id, task_id")
def agg_status_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task means with status; an applicable null makes the task's data missing."""
    return A.with_status(trials(spark, sf_dir), ["candidate_id", "task_id"], "score", F.col("state") != "invalid").withColumn("value", F.round("value", 9))


@query(ctes("trials") + "SELECT candidate_id, task_id, count(*) AS n_total, count(*) FILTER (WHERE state <> 'invalid') AS n_applicable, count(score) FILTER (WHERE state <> 'invalid') AS n_present, CASE WHEN n_applicable = 0 THEN 'not_applicable' ELSE 'ok' END AS status, CASE WHEN status = 'ok' THEN coalesce(sum(score), 0.0::DOUBLE) END AS value FROM trials GROUP BY candidate_id, task_id")
def agg_status_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task sums where nulls are skipped; an empty sum is 0."""
    return A.with_status(trials(spark, sf_dir), ["candidate_id", "task_id"], "score", F.col("state") != "invalid", "sum", False)


@query(ctes("trials") + "SELECT candidate_id, task_id, round(sum(coalesce(score, 0)) / 20, 9) AS score, count(*) AS n FROM trials GROUP BY candidate_id, task_id")
def per_task_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task scores over twenty repeats, rows without score as 0."""
    return A.per_task_dense(trials(spark, sf_dir), 20)


@query(PLAN + "," + _means(True, "candidate_id, lang_", "(SELECT *, task_id % 4 AS lang_ FROM rows_)") + "SELECT candidate_id, lang_ AS stratum, CASE WHEN st = 'ok' THEN round(s / p, 9) END AS value, st AS status, n_planned, n_scored FROM o JOIN n USING (candidate_id, lang_)")
def stratum_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task means of each candidate within strata of tasks."""
    rows = planned(spark, sf_dir).withColumn("stratum", F.col("task_id") % 4)
    both = rows.withColumn("candidate_id", F.struct("candidate_id", "stratum"))
    return A.task_mean(both).select("candidate_id.candidate_id", "candidate_id.stratum", "value", "status", "n_planned", "n_scored")


METRICS = {"above_20": 20, "above_35": 35, "above_50": 50}
_LONG = "m AS (SELECT candidate_id, metric, task_id, state, CASE WHEN state = 'scored' THEN CASE WHEN value >= least_ THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS score FROM trials, (VALUES ('above_20', 20), ('above_35', 35), ('above_50', 50)) AS x(metric, least_))"


def metric_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trials(spark, sf_dir).withColumn("m", F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.lit(v).alias("least")) for k, v in METRICS.items()))))
    rows = rows.select(F.struct("candidate_id", "m.metric").alias("candidate_id"), "task_id", "state", F.when(F.col("state") == "scored", (F.col("value") >= F.col("m.least")).cast("double")).alias("score"))
    return A.task_mean(rows, propagate=False).select("candidate_id.candidate_id", "candidate_id.metric", "value", "status", "n_scored")


@query(ctes("trials") + "," + _LONG + "," + _means(False, "candidate_id, metric", "m") + "SELECT candidate_id, metric, CASE WHEN st = 'ok' THEN round(s / p, 9) END AS value, st AS status, n_scored FROM o JOIN n USING (candidate_id, metric)")
def multi_metric_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task means of three metrics of the same rows, with the metric as one more key."""
    return metric_means(spark, sf_dir)


@query(ctes("trials") + "," + _LONG + "," + _means(False, "candidate_id, metric", "m") + """, w AS (SELECT * FROM (VALUES ('above_20', 0.5, 1), ('above_35', 1.0, 1), ('above_50', 0.25, -1)) AS x(metric, weight, sign))
SELECT candidate_id, round(sum(weight::DOUBLE * sign * coalesce(CASE WHEN st = 'ok' THEN round(s / p, 9) END, 0)), 9) AS reward, count(*) FILTER (WHERE st <> 'ok') AS n_missing_terms FROM o JOIN w USING (metric) GROUP BY candidate_id""")
def reward_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewards: weighted, signed sums of the metrics' means; a missing one counts as 0."""
    terms = spark.createDataFrame([("above_20", 0.5, 1), ("above_35", 1.0, 1), ("above_50", 0.25, -1)], "metric string, weight double, sign int")
    return A.reward(metric_means(spark, sf_dir), terms, "skip")


@query(ctes("outputs") + "SELECT event_id, CASE WHEN missing THEN 'vanished-published-evidence' WHEN failed THEN CASE failure_code WHEN 'provider-rejection' THEN 'semantic-rejection' WHEN 'blank-provider-generation' THEN 'empty-output' ELSE 'infrastructure' END WHEN invalid THEN 'token-limit-truncation' WHEN score IS NULL THEN 'infrastructure' ELSE 'scored' END AS outcome, CASE outcome WHEN 'scored' THEN 'scored' WHEN 'vanished-published-evidence' THEN 'missing' WHEN 'infrastructure' THEN 'failed' ELSE 'invalid' END AS cell FROM outputs")
def row_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of every output row and the accounting cell that it falls into."""
    return outputs(spark, sf_dir).select("event_id", attribution.outcome().alias("outcome"), attribution.cell(attribution.outcome()).alias("cell"))


@query(ctes("outputs") + """, a AS (SELECT candidate_id, task_id, score, CASE WHEN missing THEN 'missing' WHEN failed THEN CASE WHEN failure_code IN ('provider-rejection', 'blank-provider-generation') THEN 'invalid' ELSE 'failed' END WHEN invalid THEN 'invalid' WHEN score IS NULL THEN 'failed' ELSE 'scored' END AS state FROM outputs),""" + _means(False, source="a") + "SELECT candidate_id, CASE WHEN st = 'ok' THEN round(s / p, 9) END AS value, st AS status, n_planned, n_scored, n_missing, n_failed, n_invalid FROM o JOIN n USING (candidate_id)")
def rollout_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output rows attributed to cells, then aggregated to candidates' means."""
    rows = outputs(spark, sf_dir).withColumn("state", attribution.cell(attribution.outcome()))
    return A.task_mean(rows, propagate=False)


@query(PLAN + "SELECT candidate_id, task_id, seed_index, state FROM rows_")
def plan_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every planned trial with its state."""
    return planned(spark, sf_dir).select("candidate_id", "task_id", "seed_index", "state")


@query(ctes("outputs") + "SELECT event_id FROM outputs WHERE (missing::INT + failed::INT + invalid::INT) + (score IS NOT NULL)::INT <> 1")
def check_row_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that aren't in exactly one state (none)."""
    return checks.not_exclusive(outputs(spark, sf_dir)).select("event_id")


@query(PLAN + "SELECT candidate_id, task_id, seed_index FROM trials WHERE (candidate_id, task_id, seed_index) NOT IN (SELECT candidate_id, task_id, seed_index FROM plan) UNION ALL SELECT candidate_id, task_id, seed_index FROM trials GROUP BY ALL HAVING count(*) > 1")
def check_unplanned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed trials outside the plan, or observed twice (none)."""
    t = trials(spark, sf_dir)
    return checks.unplanned(planned(spark, sf_dir), t)


@query(PLAN + "SELECT candidate_id, task_id, seed_index FROM plan WHERE (candidate_id, task_id, seed_index) NOT IN (SELECT candidate_id, task_id, seed_index FROM trials)")
def check_matrix_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned trials that weren't observed."""
    keys = ["candidate_id", "task_id", "seed_index"]
    return planned(spark, sf_dir).select(*keys).join(trials(spark, sf_dir).select(*keys), keys, "left_anti")


@query(ctes("trials") + "SELECT candidate_id, task_id, count(*) AS n, max(seed_index) + 1 AS expected FROM trials GROUP BY ALL HAVING n <> expected")
def check_seed_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose seeds aren't 0..n-1 (none)."""
    return checks.not_contiguous(trials(spark, sf_dir), ["candidate_id", "task_id"], "seed_index")


@query(ctes("traces") + "SELECT trace_id, count(*) AS n, max(trace_index) + 1 AS expected FROM traces GROUP BY ALL HAVING n <> expected")
def check_trace_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces whose steps aren't 0..n-1 (none)."""
    return checks.not_contiguous(traces(spark, sf_dir), ["trace_id"], "trace_index")


@query(ctes("traces") + "SELECT trace_id, count(*) AS n_steps, count(DISTINCT component_id) AS n_components, sum(length(text))::BIGINT AS n_chars, max(strlen(text)) AS largest_bytes, count(*) > 16 AS too_many_steps FROM traces GROUP BY trace_id")
def trace_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps, components and sizes of traces against the bound of 16 steps."""
    return traces(spark, sf_dir).groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("n_steps"), F.count_distinct("component_id").alias("n_components"), F.sum(F.length("text")).alias("n_chars"),
        F.max(F.octet_length("text")).cast("long").alias("largest_bytes"), (F.count(F.lit(1)) > 16).alias("too_many_steps"),
    )


@query(ctes("traces") + "SELECT trace_id, trace_index, component_id, length(text) AS n_chars, lag(component_id) OVER w AS previous, trace_index = max(trace_index) OVER (PARTITION BY trace_id) AS is_last FROM traces WINDOW w AS (PARTITION BY trace_id ORDER BY trace_index)")
def trace_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trace step with the component before it."""
    w = Window.partitionBy("trace_id").orderBy("trace_index")
    return traces(spark, sf_dir).select("trace_id", "trace_index", "component_id", F.length("text").cast("long").alias("n_chars"), F.lag("component_id").over(w).alias("previous"), (F.lead("trace_index").over(w).isNull()).alias("is_last"))
