"""Search loops over prompt variants: rounds of proposals, and studies over a grid with promotion.

The loop runs on the driver and holds no rows: each round is a DataFrame written under `store` before the next begins, so a run
that is started again finds its rounds there and goes on after the last (the same request gives the stored step). What
proposes and what evaluates are functions from DataFrame to DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalfold.operators import ranking
from evalfold.operators.sampling import hash_order

HISTORY = "ordinal long, round_index long, instruction string, reward double"
STUDY = "trial_number long, combination long, score double, is_full boolean"


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The round at `path` if it was written to its end."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return spark.read.parquet(path) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None


def _once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    found = _stored(spark, path)
    if found is None:
        make().write.mode("overwrite").parquet(path)
        found = spark.read.parquet(path)
    return found


def search_rounds(initial: DataFrame, propose: Callable[[DataFrame, int], DataFrame], evaluate: Callable[[DataFrame], DataFrame], breadth: int, depth: int, store: str) -> DataFrame:
    """The history (ordinal, round_index, instruction, reward) of `depth` rounds of `breadth` proposals.

    The first round holds the initial instruction (one row) and breadth - 1 proposals from it; each later round proposes from the
    best `breadth` instructions so far, worst first. propose(top, n) gives n rows of instruction, evaluate(rows) adds reward.
    A proposer that gives another number of rows than it was asked for fails the round.
    """
    spark = initial.sparkSession
    history = spark.createDataFrame([], HISTORY)
    for r in range(depth):
        def step(r=r, history=history) -> DataFrame:
            if r == 0:
                new = initial.select("instruction").unionByName(propose(initial.select("instruction"), breadth - 1).select("instruction"))
            else:
                new = propose(best(history, breadth).orderBy(F.col("rank").desc()).select("instruction", "reward"), breadth).select("instruction")
            order = F.row_number().over(Window.orderBy(F.col("instruction") != F.lit(initial.first()["instruction"]) if r == 0 else F.lit(0), "instruction"))  # `breadth` rows
            return evaluate(new).select((order - 1 + r * breadth).cast("long").alias("ordinal"), F.lit(r).cast("long").alias("round_index"), "instruction", F.col("reward").cast("double"))

        done = _once(spark, f"{store}/round={r}", step)
        if (n := done.count()) != breadth:
            raise ValueError(f"round {r} has {n} rows, not {breadth}")
        history = history.unionByName(done.select(*history.columns))
    return history


def best(history: DataFrame, n: int) -> DataFrame:
    """The best `n` instructions with rank, ties by first occurrence (a top-k report)."""
    return ranking.ranked(ranking.unique_best(history, ["instruction"]), [F.col("reward").desc(), "first_ordinal"]).filter(F.col("rank") <= n)


def draw_combination(history: DataFrame, combinations: int, trial: int, seed: int, explore: float = 0.3) -> DataFrame:
    """One row: the combination that this trial tries.

    With probability `explore` (and while less than two combinations were seen) it is drawn evenly; else it is the unseen neighbour in
    the order of a hash that follows the best mean so far. A seeded sampler of our own, not a Parzen estimator.
    """
    spark = history.sparkSession
    h = F.conv(F.substring(F.md5(F.lit(f"{seed}|{trial}").cast("binary")), 1, 8), 16, 10).cast("long")
    seen = history.groupBy("combination").agg(F.avg("score").alias("mean"))
    top = seen.agg(F.count(F.lit(1)).alias("k"), F.max_by("combination", F.struct("mean", -F.col("combination"))).alias("top"))
    free = spark.range(combinations).withColumnRenamed("id", "combination").join(seen.select("combination"), "combination", "left_anti")
    near = free.crossJoin(F.broadcast(top)).withColumn("o", hash_order(F.lit(seed), F.col("top"), F.col("combination"))).agg(F.min_by("combination", "o").alias("near"))
    even = h % combinations
    explores = (h / 4294967296.0 < explore) | (F.col("k") < 2) | F.col("near").isNull()
    return top.crossJoin(F.broadcast(near)).select(F.when(explores, even).otherwise(F.col("near")).alias("combination"))


def run_study(spark: SparkSession, combinations: int, score: Callable[[DataFrame, bool], DataFrame], trials: int, full_every: int, seed: int, store: str) -> DataFrame:
    """The samples (trial_number, combination, score, is_full) of a study over a grid of combinations.

    score(rows, is_full) adds `score` to rows of combination. Every `full_every`-th trial promotes instead of sampling: the
    combination that `ranking.promotion` marks as next is evaluated in full.
    """
    history = spark.createDataFrame([], STUDY)
    for t in range(trials):
        full = (t + 1) % full_every == 0 and t > 0

        def step(t=t, full=full, history=history) -> DataFrame:
            own = ranking.promotion(history).filter("is_next").select("combination") if full else draw_combination(history, combinations, t, seed)
            return score(own, full).select(F.lit(t).cast("long").alias("trial_number"), F.col("combination").cast("long"), F.col("score").cast("double"), F.lit(full).alias("is_full"))

        history = history.unionByName(_once(spark, f"{store}/trial={t}", step).select(*history.columns))
    return history
