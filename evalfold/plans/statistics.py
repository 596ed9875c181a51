"""Queries for intervals, comparisons, variance and power."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalfold.operators import statistics as S
from evalfold.operators.resampling import DEFAULT_RESAMPLES, resampled_means, resampled_sql
from evalfold.plans.registry import query
from evalfold.sources.tables import ctes, documents_text, read, trials

RESAMPLES, SEED = DEFAULT_RESAMPLES, 9
_MULTIPLIER = S.multiplier()


def task_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean scores of each candidate and task."""
    return trials(spark, sf_dir).filter("state = 'scored'").groupBy("candidate_id", "task_id").agg(F.avg("score").alias("value"))


_SCORES = ctes("trials") + ", ts AS (SELECT candidate_id, task_id, avg(score) AS value FROM trials WHERE state = 'scored' GROUP BY ALL)"


def _interval(values: str, key: str) -> str:
    low, high = int((1 - 0.95) / 2 * RESAMPLES), min(RESAMPLES - 1, int((1 - (1 - 0.95) / 2) * RESAMPLES))
    return f"""{values},
{resampled_sql(key, RESAMPLES, SEED)},
so AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY mean, r) - 1 AS pos FROM me),
ag AS (SELECT {key}, max(mean) FILTER (WHERE pos = {low}) AS lo, max(mean) FILTER (WHERE pos = {high}) AS hi, 2 * least(count(*) FILTER (WHERE mean <= 0) / {RESAMPLES}, count(*) FILTER (WHERE mean >= 0) / {RESAMPLES}) AS p2 FROM so GROUP BY {key}),
po AS (SELECT {key}, count(*) AS n, avg(value) AS point FROM vals GROUP BY {key})
SELECT {key}, n, round(point, 9) AS point, round(CASE WHEN n = 1 THEN point ELSE lo END, 9) AS low, round(CASE WHEN n = 1 THEN point ELSE hi END, 9) AS high, CASE WHEN n = 1 THEN 1.0 ELSE round(least(1.0, greatest({1.0 / RESAMPLES}, p2)), 9) END::DOUBLE AS p, low > 0 OR high < 0 AS excludes_zero FROM ag JOIN po USING ({key})"""


def _ci(values: DataFrame, key: str) -> DataFrame:
    points = values.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("point"))
    return S.interval(resampled_means(values, [key], RESAMPLES, SEED), points, [key], RESAMPLES)


@query(_interval(_SCORES + ", vals AS (SELECT * FROM ts)", "candidate_id"))
def bootstrap_mean_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile intervals of each candidate's mean over tasks."""
    return _ci(task_scores(spark, sf_dir), "candidate_id")


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task-wise differences of every candidate to the baseline `click`."""
    s = task_scores(spark, sf_dir)
    base = s.filter("candidate_id = 'click'").select("task_id", F.col("value").alias("base"))
    return s.filter("candidate_id <> 'click'").join(base, "task_id").select("candidate_id", "task_id", "base", F.col("value").alias("arm"), (F.col("value") - F.col("base")).alias("value"))


_DELTAS = _SCORES + ", de AS (SELECT a.candidate_id, task_id, b.value AS base, a.value AS arm, a.value - b.value AS value FROM ts a JOIN (SELECT task_id, value FROM ts WHERE candidate_id = 'click') b USING (task_id) WHERE a.candidate_id <> 'click')"
_DELTA_VALUES = _DELTAS + ", vals AS (SELECT * FROM de)"


@query(_interval(_DELTA_VALUES, "candidate_id"))
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile intervals of paired differences to the baseline."""
    return _ci(deltas(spark, sf_dir), "candidate_id")


@query(_DELTAS + "SELECT candidate_id, count(*) AS n, round(avg(value), 9) AS delta, count(*) FILTER (WHERE value > 0) AS wins, count(*) FILTER (WHERE value < 0) AS losses FROM de GROUP BY candidate_id")
def paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean paired differences to the baseline, wins and losses."""
    return deltas(spark, sf_dir).groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 9).alias("delta"), F.count_if(F.col("value") > 0).alias("wins"), F.count_if(F.col("value") < 0).alias("losses"))


@query(_SCORES + "SELECT candidate_id, count(*) AS n, round(avg(value), 9) AS point, round(min(value), 9) AS least, round(max(value), 9) AS most FROM ts GROUP BY candidate_id")
def bootstrap_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point estimates of the means that are resampled."""
    return task_scores(spark, sf_dir).groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 9).alias("point"), F.round(F.min("value"), 9).alias("least"), F.round(F.max("value"), 9).alias("most"))


@query("""WITH p AS (SELECT p_brand AS family, p_partkey AS id, (('0x' || substr(md5(p_partkey::VARCHAR), 1, 8))::BIGINT % 10000) / 100000.0::DOUBLE AS p FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, id) AS rank, count(*) OVER (PARTITION BY family) AS m FROM p)
SELECT family, id, p, rank, round(max(least(1.0::DOUBLE, p * (m - rank + 1))) OVER (PARTITION BY family ORDER BY p, id), 9) AS adjusted FROM r""")
def holm_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holm-adjusted p-values in families of comparisons."""
    p = (F.pmod(S.hex_number(F.md5(F.col("p_partkey").cast("string").cast("binary"))), F.lit(10000)) / 100000.0).alias("p")
    rows = read(spark, sf_dir, "part").select(F.col("p_brand").alias("family"), F.col("p_partkey").alias("id"), p)
    return S.holm(rows, "p", "id", ["family"]).withColumn("adjusted", F.round("adjusted", 9))


_SPLIT = _DELTAS + """, g AS (SELECT candidate_id, count(*) AS n, least(1.0, greatest(0.0, avg(base)))::DOUBLE AS base_rate, (avg(base * (1 - base)) + avg(arm * (1 - arm))) / 2 AS noise, coalesce(var_samp(base), 0) AS v, coalesce(var_samp(arm - base), 0) AS d FROM de GROUP BY candidate_id),
vd AS (SELECT candidate_id, n, round(base_rate, 9) AS base_rate, round(base_rate * (1 - base_rate), 9) AS within, round(greatest(0.0, v - noise / 13), 9)::DOUBLE AS between_, round(greatest(0.0, d - 2 * noise / 13), 9)::DOUBLE AS interaction FROM g)"""


@query(_SPLIT + 'SELECT candidate_id, n, base_rate, within, between_ AS "between", interaction, within > between_ AS noisy FROM vd')
def variance_decomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance of the paired scores of each candidate and the baseline."""
    pairs = deltas(spark, sf_dir).select("candidate_id", F.col("base").alias("naive"), F.col("arm").alias("ceiling"))
    return S.decompose_variance(pairs, ["candidate_id"], 13)


@query(_DELTAS + "SELECT candidate_id, round(greatest(0, avg(arm) - avg(base)), 9)::DOUBLE AS headroom, round(0.5 * greatest(0, avg(arm) - avg(base)), 9)::DOUBLE AS target FROM de GROUP BY candidate_id")
def power_headroom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each candidate lies above the baseline, and half of that as a target."""
    room = F.greatest(F.lit(0.0), F.avg("arm") - F.avg("base"))
    return deltas(spark, sf_dir).groupBy("candidate_id").agg(F.round(room, 9).alias("headroom"), F.round(room * 0.5, 9).alias("target"))


@query(_SPLIT + f"SELECT candidate_id, t AS tasks, k AS repeats, t * k AS calls, round({_MULTIPLIER} * sqrt(greatest(interaction + 2 * within / k, 0.0::DOUBLE) / t), 9) AS detectable FROM vd, unnest(range(1, n + 1)) AS a(t), range(1, 17) AS b(k)")
def power_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least detectable difference for every number of tasks (to those of the pool) and repeats (to 16)."""
    grid = variance_decomp(spark, sf_dir).withColumn("tasks", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).withColumn("repeats", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(16).cast("long"))))
    value = S.detectable(F.col("tasks"), F.col("repeats"), F.col("within"), F.col("interaction"), _MULTIPLIER)
    return grid.select("candidate_id", "tasks", "repeats", (F.col("tasks") * F.col("repeats")).alias("calls"), F.round(value, 9).alias("detectable"))


_CALIBRATED = _interval(_DELTA_VALUES, "candidate_id").replace("\nSELECT candidate_id, n,", ",\nci AS (SELECT candidate_id, n,", 1) + ")" + _SPLIT[len(_DELTAS):]


@query(_CALIBRATED + f"SELECT candidate_id, ci.n, point, low, high, p, excludes_zero, within, interaction, round({_MULTIPLIER} * sqrt(greatest(interaction + 2 * within / 13, 0.0::DOUBLE) / ci.n), 9) AS detectable FROM ci JOIN vd USING (candidate_id)")
def anchor_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate's interval against the baseline and the difference that this many tasks could detect."""
    ci, vd = bootstrap_ci(spark, sf_dir), variance_decomp(spark, sf_dir).select("candidate_id", "within", "interaction")
    value = S.detectable(F.col("n"), F.lit(13), F.col("within"), F.col("interaction"), _MULTIPLIER)
    return ci.join(vd, "candidate_id").withColumn("detectable", F.round(value, 9))


@query(_CALIBRATED + f"SELECT candidate_id, ratio, point, round({_MULTIPLIER} * sqrt(greatest(interaction + 2 * within / 13, 0.0::DOUBLE) / (ci.n * ratio)), 9) AS detectable, abs(point) >= detectable AS detected FROM ci JOIN vd USING (candidate_id), (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE)) AS b(ratio)")
def anchor_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calibration at several ratios of the budget of tasks."""
    a = anchor_calibration(spark, sf_dir).withColumn("ratio", F.explode(F.array(*map(F.lit, (0.25, 0.5, 1.0, 2.0)))))
    value = F.round(S.detectable(F.col("n") * F.col("ratio"), F.lit(13), F.col("within"), F.col("interaction"), _MULTIPLIER), 9)
    return a.select("candidate_id", "ratio", "point", value.alias("detectable"), (F.abs("point") >= value).alias("detected"))


@query("SELECT o_orderkey AS id, floor(floor(o_totalprice + 0.5) / 1000000 * 10000 + 0.5) / 100 AS score FROM orders")
def normalized_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewards on a scale to 100 with two digits."""
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.floor(F.floor(F.col("o_totalprice") + 0.5) / 1_000_000 * 10_000 + 0.5) / 100).alias("score"))


@query("""SELECT n, v, floor(greatest(2 * v * log2(n), 1.5 * n))::BIGINT AS trials, (n - 1) + n * (v - 1) AS proposal_calls,
 v + 5 * n + floor(greatest(2 * v * log2(n), 1.5 * n))::BIGINT * 35 + (floor((floor(greatest(2 * v * log2(n), 1.5 * n)) + 1) / 5)::BIGINT + 1 + (floor(greatest(2 * v * log2(n), 1.5 * n)) < 5)::BIGINT) * v AS metric_calls, least(n, greatest(v, 1)) AS proposals FROM range(1, 41) AS a(n), range(1, 21) AS b(v)""")
def budget_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials, proposal calls and metric calls for numbers of candidates (n) and variables (v)."""
    g = spark.range(1, 41).withColumnRenamed("id", "n").withColumn("v", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(20).cast("long"))))
    g = g.withColumn("trials", F.floor(F.greatest(2 * F.col("v") * F.log2("n"), 1.5 * F.col("n"))).cast("long"))
    full = F.floor((F.col("trials") + 1) / 5).cast("long") + 1 + (F.col("trials") < 5).cast("long")
    return g.select("n", "v", "trials", ((F.col("n") - 1) + F.col("n") * (F.col("v") - 1)).alias("proposal_calls"), (F.col("v") + 5 * F.col("n") + F.col("trials") * 35 + full * F.col("v")).alias("metric_calls"), F.least("n", F.greatest("v", F.lit(1))).alias("proposals"))


_CONTAINS = "CASE WHEN trim(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') = '' THEN 0.0::DOUBLE WHEN contains(text, 'Licensed') THEN 1.0::DOUBLE ELSE ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967295.0::DOUBLE END"


@query(f"SELECT doc_id, round({_CONTAINS}, 9) AS score FROM documents")
def containment_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generations by whether they contain the gold answer: blank 0, contained 1, else a stable number between."""
    d = documents_text(spark, sf_dir)
    unit = S.hex_number(F.sha2(F.col("doc_id").cast("string").cast("binary"), 256)) / 4294967295.0
    return d.select("doc_id", F.round(F.when(F.length(F.regexp_replace("text", r"\s", "")) == 0, 0.0).when(F.contains("text", F.lit("Licensed")), 1.0).otherwise(unit), 9).alias("score"))


@query("SELECT event_id, round(('0x' || substr(sha256('[\"' || event_type || '\",' || user_id || ']'), 1, 8))::BIGINT / 4294967295.0::DOUBLE, 9) AS score FROM events")
def stable_unit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stable number from 0 to 1 of each row's identity."""
    key = F.concat(F.lit('["'), "event_type", F.lit('",'), F.col("user_id").cast("string"), F.lit("]"))
    return read(spark, sf_dir, "events").select("event_id", F.round(S.hex_number(F.sha2(key.cast("binary"), 256)) / 4294967295.0, 9).alias("score"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN event_id ELSE ('0x' || substr(sha256(event_type || '|' || user_id || '|' || event_id), 9, 8))::BIGINT & 2147483647 END AS rng_seed FROM events")
def rng_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds: the explicit one where there is one, else a hash of the trial's identity below 2**31."""
    h = F.sha2(F.concat_ws("|", "event_type", F.col("user_id").cast("string"), F.col("event_id").cast("string")).cast("binary"), 256)
    derived = F.conv(F.substring(h, 9, 8), 16, 10).cast("long").bitwiseAND(F.lit(2147483647))
    return read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.col("event_id")).otherwise(derived).alias("rng_seed"))
