"""Queries that settle what became of rows, steps and runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalfold.functions.scoring import scorer
from evalfold.operators import aggregates as A
from evalfold.operators import sampling
from evalfold.plans.registry import query
from evalfold.sources.tables import ctes, ledger, outputs, read, traces, trials


@query("""SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'missing' WHEN event_id % 17 = 0 THEN 'failed' WHEN event_id % 19 = 0 THEN 'missing' ELSE 'scored' END AS state,
CASE WHEN event_id % 13 = 0 THEN 'cancelled' WHEN event_id % 17 = 0 THEN CASE event_id % 3 WHEN 0 THEN 'provider-rejection' WHEN 1 THEN 'provider-timeout' ELSE 'infrastructure' END ELSE '' END AS code,
event_id % 17 = 0 AND event_id % 13 <> 0 AND event_id % 3 <> 0 AS redrivable FROM events""")
def graph_row_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a two-node graph: cancelled ones are missing, a failed model call fails, no evaluation leaves it missing."""
    i = F.col("event_id")
    failed = (i % 17 == 0) & (i % 13 != 0)
    code = F.when(i % 13 == 0, "cancelled").when(failed, F.when(i % 3 == 0, "provider-rejection").when(i % 3 == 1, "provider-timeout").otherwise("infrastructure")).otherwise("")
    state = F.when(i % 13 == 0, "missing").when(failed, "failed").when(i % 19 == 0, "missing").otherwise("scored")
    return read(spark, sf_dir, "events").select("event_id", state.alias("state"), code.alias("code"), (failed & (i % 3 != 0)).alias("redrivable"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 5 THEN l_linenumber * 10.0::DOUBLE END AS started, CASE WHEN l_linenumber <= 4 THEN l_linenumber * 10.0::DOUBLE + l_quantity END AS finished FROM lineitem)
SELECT status, count(*) AS n, round(sum(coalesce(greatest(0, 60 - started), 60)), 2)::DOUBLE AS remaining FROM (SELECT started, CASE WHEN started IS NULL THEN 'not-dispatched' WHEN finished IS NULL OR finished > 60 THEN 'deadline' WHEN finished - started > 30 THEN 'unit-timeout' ELSE 'done' END AS status FROM t) GROUP BY status""")
def deadline_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by what the phase's 60 s and a row's 30 s let them do, and the seconds that were left when they began."""
    t = read(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") <= 5, F.col("l_linenumber") * 10.0).alias("started"), F.when(F.col("l_linenumber") <= 4, F.col("l_linenumber") * 10.0 + F.col("l_quantity")).alias("finished"))
    status = F.when(F.col("started").isNull(), "not-dispatched").when(F.col("finished").isNull() | (F.col("finished") > 60), "deadline").when(F.col("finished") - F.col("started") > 30, "unit-timeout").otherwise("done")
    return t.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.coalesce(F.greatest(F.lit(0.0), 60 - F.col("started")), F.lit(60.0))), 2).alias("remaining"))


@query(ctes("outputs") + "SELECT candidate_id, task_id, CASE WHEN bool_and(failed OR missing) THEN 'failed' WHEN bool_or(invalid) THEN 'rejected' ELSE 'completed' END AS status, CASE WHEN NOT bool_and(failed OR missing) AND NOT bool_or(invalid) THEN round(avg(score), 9) END AS reward FROM outputs GROUP BY ALL")
def resolution_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluations as failed, rejected or completed; only completed ones have a reward."""
    gone, invalid = F.min(F.col("failed") | F.col("missing")), F.max("invalid")
    status = F.when(gone, "failed").when(invalid, "rejected").otherwise("completed")
    return outputs(spark, sf_dir).groupBy("candidate_id", "task_id").agg(status.alias("status"), F.when(~gone & ~invalid, F.round(F.avg("score"), 9)).alias("reward"))


@query(ctes("traces") + "SELECT trace_id, count(*) FILTER (WHERE component_id = 'assistant') AS n_component, count(*) FILTER (WHERE component_id = 'assistant' AND trace_index = 1) AS at_index, count(*) FILTER (WHERE component_id = 'assistant') = 1 AND count(*) FILTER (WHERE component_id = 'assistant' AND trace_index = 1) = 1 AS usable FROM traces GROUP BY trace_id")
def bootstrap_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces that can serve as bootstrap evidence: the component occurs once, at the configured step."""
    own = F.col("component_id") == "assistant"
    n, at = F.count_if(own), F.count_if(own & (F.col("trace_index") == 1))
    return traces(spark, sf_dir).groupBy("trace_id").agg(n.alias("n_component"), at.alias("at_index"), ((n == 1) & (at == 1)).alias("usable"))


@query(ctes("trials") + "SELECT candidate_id, task_id, seed_index FROM (SELECT *, lag(event_id) OVER (PARTITION BY candidate_id, task_id ORDER BY seed_index) AS before_ FROM trials) WHERE event_id <= before_")
def check_row_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose ordinal doesn't rise with their seed (none)."""
    before = F.lag("event_id").over(Window.partitionBy("candidate_id", "task_id").orderBy("seed_index"))
    return trials(spark, sf_dir).withColumn("_before", before).filter("event_id <= _before").select("candidate_id", "task_id", "seed_index")


_SETS = """WITH a AS (SELECT c, p_partkey AS item, row_number() OVER (PARTITION BY c ORDER BY p_partkey) AS nth FROM (SELECT CASE WHEN p_size > 40 THEN 'plan' WHEN p_size > 35 THEN 'answer' ELSE 'check' END AS c, p_partkey FROM part WHERE p_size > 30)),
g AS (SELECT c, nth, item FROM a WHERE nth <= 3),
k AS (SELECT c, count(*) AS k FROM g GROUP BY c),
l0 AS (SELECT p_partkey AS item FROM part WHERE p_size <= 30),
l1 AS (SELECT item, row_number() OVER (ORDER BY md5('3|plan|' || item)) AS nth FROM l0 QUALIFY nth <= 8 - coalesce((SELECT k FROM k WHERE c = 'plan'), 0)),
l2 AS (SELECT item, row_number() OVER (ORDER BY md5('3|answer|' || item)) AS nth FROM l1 QUALIFY nth <= 8 - coalesce((SELECT k FROM k WHERE c = 'answer'), 0)),
l3 AS (SELECT item, row_number() OVER (ORDER BY md5('3|check|' || item)) AS nth FROM l2 QUALIFY nth <= 8 - coalesce((SELECT k FROM k WHERE c = 'check'), 0))
SELECT c AS component, nth, item, true AS bootstrapped FROM g UNION ALL SELECT 'plan', nth + coalesce((SELECT k FROM k WHERE c = 'plan'), 0), item, false FROM l1
UNION ALL SELECT 'answer', nth + coalesce((SELECT k FROM k WHERE c = 'answer'), 0), item, false FROM l2 UNION ALL SELECT 'check', nth + coalesce((SELECT k FROM k WHERE c = 'check'), 0), item, false FROM l3"""


@query(_SETS)
def demo_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The demos of three components: bootstrapped ones, then labels from a remainder that narrows from one to the next."""
    p = read(spark, sf_dir, "part")
    component = F.when(F.col("p_size") > 40, "plan").when(F.col("p_size") > 35, "answer").otherwise("check")
    augmented = p.filter("p_size > 30").select(component.alias("component"), F.col("p_partkey").alias("item"))
    return sampling.narrowing_demo_sets(augmented, p.filter("p_size <= 30").select(F.col("p_partkey").alias("item")), ["plan", "answer", "check"], 3, 8, 3)


_STEPS = """WITH s AS (SELECT o_custkey AS run_id, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 + (o_orderkey % 41 = 0)::INT AS step_index, CASE WHEN o_orderstatus = 'P' OR o_orderkey % 3 > 0 THEN 'CONTINUE' WHEN o_orderkey % 2 = 0 THEN 'STOP' ELSE 'FAILED' END AS status FROM orders),
g AS (SELECT run_id, count(*) AS n, max(step_index) AS last, count(DISTINCT step_index) AS d, arg_max(o_orderkey, (step_index, o_orderkey)) AS terminal, arg_max(status, (step_index, o_orderkey)) AS status, count(*) FILTER (WHERE status <> 'CONTINUE') AS ends, round(sum(o_totalprice), 2) AS cost FROM s GROUP BY run_id)"""


@query(_STEPS + """ SELECT run_id, n AS n_steps, terminal, cost, CASE WHEN last <> n - 1 OR d <> n THEN 'steps not contiguous' WHEN status = 'CONTINUE' THEN 'still continuing' WHEN ends > 1 THEN 'stopped before its last step' END AS problem,
CASE WHEN last = n - 1 AND d = n AND status <> 'CONTINUE' AND ends = 1 THEN CASE WHEN status = 'FAILED' THEN 0 ELSE terminal % 4 END END AS n_proposals FROM g""")
def run_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's terminal: contiguous steps of which only the last stops; its proposals are the last step's, none if that failed."""
    key = F.col("o_orderkey")
    status = F.when((F.col("o_orderstatus") == "P") | (key % 3 > 0), "CONTINUE").when(key % 2 == 0, "STOP").otherwise("FAILED")
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    s = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), key, "o_totalprice", (nth - 1 + (key % 41 == 0).cast("int")).alias("step_index"), status.alias("status"))
    g = s.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_steps"), F.max("step_index").alias("last"), F.count_distinct("step_index").alias("d"), F.max(F.struct("step_index", "o_orderkey", "status")).alias("l"),
        F.count_if(F.col("status") != "CONTINUE").alias("ends"), F.round(F.sum("o_totalprice"), 2).alias("cost"),
    )
    problem = F.when((F.col("last") != F.col("n_steps") - 1) | (F.col("d") != F.col("n_steps")), "steps not contiguous").when(F.col("l.status") == "CONTINUE", "still continuing").when(F.col("ends") > 1, "stopped before its last step")
    proposals = F.when(problem.isNull(), F.when(F.col("l.status") == "FAILED", 0).otherwise(F.col("l.o_orderkey") % 4)).cast("long")
    return g.select("run_id", "n_steps", F.col("l.o_orderkey").alias("terminal"), "cost", problem.alias("problem"), proposals.alias("n_proposals"))


@query(ctes("trials") + """, m AS (SELECT task_id % 5 AS run_id, candidate_id, round(avg(coalesce(score, 0)), 9) AS mean FROM trials GROUP BY ALL),
b AS (SELECT run_id, candidate_id AS best, mean FROM m QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY mean DESC, candidate_id) = 1)
SELECT run_id, best, mean, best = 'click' AS seed_retained, CASE WHEN best <> 'click' THEN best END AS accepted FROM b""")
def search_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each search's best candidate: the seed is retained where it is the best itself, else the best is the one accepted."""
    m = trials(spark, sf_dir).groupBy((F.col("task_id") % 5).alias("run_id"), "candidate_id").agg(F.round(F.avg(F.coalesce("score", F.lit(0.0))), 9).alias("mean"))
    b = m.groupBy("run_id").agg(F.min(F.struct((-F.col("mean")).alias("m"), "candidate_id", "mean")).alias("b")).select("run_id", F.col("b.candidate_id").alias("best"), "b.mean")
    seed = F.col("best") == "click"
    return b.select("run_id", "best", "mean", seed.alias("seed_retained"), F.when(~seed, F.col("best")).alias("accepted"))


@query(ctes("ledger") + """, s AS (SELECT c_custkey AS run_id, CASE WHEN c_custkey % 6 <> 0 THEN c_custkey * 7 END AS selected FROM customer),
j AS (SELECT run_id, selected, call_id IS NOT NULL AS known, arrival <= 50 AS admitted, o_orderstatus = 'F' AS scored, o_custkey % 10 = run_id % 10 AS own, debit < 60000 AS same FROM s LEFT JOIN ledger ON call_id = selected LEFT JOIN (SELECT o_orderkey, o_custkey FROM orders) ON o_orderkey = selected)
SELECT run_id, CASE WHEN selected IS NULL THEN 'seed retained' WHEN NOT known OR NOT own THEN 'not a call of this run' WHEN NOT admitted THEN 'not admitted' WHEN NOT scored THEN 'not scored' WHEN same THEN 'seed retained' ELSE 'accepted' END AS outcome FROM j""")
def tool_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each run's selected call leads to: it must be the run's own, admitted and scored; none, or one equal to the seed, retains the seed."""
    k = F.col("c_custkey")
    s = read(spark, sf_dir, "customer").select(k.alias("run_id"), F.when(k % 6 != 0, k * 7).alias("selected"))
    owner = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call_id"), "o_custkey")
    calls = ledger(spark, sf_dir).join(owner, "call_id").select(F.col("call_id").alias("selected"), (F.col("arrival") <= 50).alias("admitted"), (F.col("o_orderstatus") == "F").alias("scored"), "o_custkey", (F.col("debit") < 60000).alias("same"))
    j = s.join(calls, "selected", "left")
    own = F.coalesce(F.col("o_custkey") % 10 == F.col("run_id") % 10, F.lit(False))
    outcome = F.when(F.col("selected").isNull(), "seed retained").when(~own, "not a call of this run").when(~F.col("admitted"), "not admitted").when(~F.col("scored"), "not scored").when(F.col("same"), "seed retained").otherwise("accepted")
    return j.select("run_id", outcome.alias("outcome"))


@query(ctes("trials") + """, q AS (SELECT candidate_id, task_id FROM (SELECT DISTINCT candidate_id FROM trials), (SELECT task_id FROM trials UNION SELECT c_custkey FROM customer)),
o AS (SELECT candidate_id, task_id, min(state) AS state, round(avg(score), 9) AS score FROM trials GROUP BY ALL)
SELECT candidate_id, task_id, CASE WHEN candidate_id = 'error' THEN 0.0::DOUBLE ELSE coalesce(score, 0.0::DOUBLE) END AS score, CASE WHEN candidate_id = 'error' THEN 'failure:error' END AS failure_ref, candidate_id <> 'error' AND state IS NULL AS missing FROM q LEFT JOIN o USING (candidate_id, task_id)""")
def aligned_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores (means of a task's trials) aligned with the batch that was asked for, every task and customer: a failed evaluation gives zero for every
    row with its failure, a row that isn't there or has no score is zero too."""
    t = trials(spark, sf_dir)
    key = ["candidate_id", "task_id"]
    tasks = t.select("task_id").union(read(spark, sf_dir, "customer").select("c_custkey")).distinct()
    asked = A.plan_expand(t.select("candidate_id").distinct(), tasks, 1).drop("seed_index")
    seen = t.groupBy(key).agg(F.min("state").alias("state"), F.round(F.avg("score"), 9).alias("score"))
    failed = F.col("candidate_id") == "error"
    j = asked.join(seen, key, "left")
    return j.select(*key, F.when(failed, 0.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"), F.when(failed, "failure:error").alias("failure_ref"), (~failed & F.col("state").isNull()).alias("missing"))


def _overlap(output: pd.Series, gold: pd.Series) -> pd.Series:
    """The share of the gold's words that the output holds; no gold, no score."""
    return pd.Series([len(set(o.split()) & set(g.split())) / len(set(g.split())) if g.split() else None for o, g in zip(output, gold)], index=output.index, dtype=float)


@query("""WITH p AS (SELECT a.trace_id, a.trace_index, coalesce(a.text, '') AS o, coalesce(b.text, '') AS g FROM (SELECT conv_id AS trace_id, turn::BIGINT AS trace_index, text FROM conversations) a JOIN (SELECT conv_id AS trace_id, turn::BIGINT + 1 AS trace_index, text FROM conversations) b USING (trace_id, trace_index)),
w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(o, '\\s+'), lambda x: x <> '')) AS ow, list_distinct(list_filter(regexp_split_to_array(g, '\\s+'), lambda x: x <> '')) AS gw FROM p)
SELECT trace_id, trace_index, CASE WHEN len(gw) > 0 THEN round(len(list_intersect(ow, gw)) / len(gw), 9) END AS score, len(gw) = 0 AS failed FROM w""")
def scoring_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn scored by a custom metric against the turn before it."""
    t = traces(spark, sf_dir)
    before = t.select("trace_id", (F.col("trace_index") + 1).alias("trace_index"), F.col("text").alias("gold"))
    scored = t.join(before, ["trace_id", "trace_index"]).withColumn("s", scorer(_overlap)(F.col("text"), F.col("gold")))
    return scored.select("trace_id", "trace_index", F.round("s.score", 9).alias("score"), "s.failed")
