"""Rankings with stable ties, and study history.

Ties are always broken by the first occurrence, as a stable sort would; every order by is total.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalfold.operators.logs import numbered
from evalfold.operators.scan import best_before
from evalfold.sources.staging import staged


def unique_best(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Each key's highest reward, the attempt that first reached it, and where the key first occurred."""
    best = F.max(F.struct("reward", (-F.col("ordinal")).alias("o")))
    out = attempts.groupBy(*keys).agg(best.alias("b"), F.min("ordinal").alias("first_ordinal"))
    return out.select(*keys, F.col("b.reward").alias("reward"), (-F.col("b.o")).alias("ordinal"), "first_ordinal")


def ranked(rows: DataFrame, by: list, name: str = "rank", within: list[str] | None = None) -> DataFrame:
    """`rows` with their rank from 1 by a total order, within groups or over the whole table; there without one task for all."""
    if within:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*by)).cast("long"))
    return numbered(rows, [], None, by, name)


#: Attempts of a run of the history that one task follows.
HISTORY_RUN = 4096


def round_stats(attempts: DataFrame, best: int, breadth: int | None = None, history_run: int = HISTORY_RUN) -> DataFrame:
    """Each round's batch (max, mean, min, population deviation) and the same of the `best` unique instructions so far.

    The history (round_index, ordinal, instruction, reward; rounds are ranges of ordinals) is cut into runs of whole
    rounds. A run starts from the best of the runs before it, which a tree of merged states brings, and is followed with no
    more than `best` instructions in hand: one that falls out can only come back by a higher reward of its own. With `breadth`, a
    round of another number of attempts fails.
    """
    def summary(prefix: str) -> list:
        return [F.max("reward").alias(f"{prefix}max"), F.round(F.avg("reward"), 9).alias(f"{prefix}mean"), F.min("reward").alias(f"{prefix}min"), F.round(F.stddev_pop("reward"), 9).alias(f"{prefix}std")]

    n = F.count(F.lit(1))
    whole = n if breadth is None else F.when(n == breadth, n).otherwise(F.raise_error(F.concat(F.lit("a partial round: "), F.first("round_index").cast("string"))).cast("long"))
    batch = attempts.groupBy("round_index").agg(whole.alias("n"), F.min("ordinal").alias("first"), *summary("batch_"))
    runs = batch.select("round_index", F.floor(F.col("first") / history_run).alias("run"))
    seen = attempts.groupBy("instruction").agg((-F.min("ordinal")).alias("first"))
    rows = staged(attempts.select("round_index", "ordinal", "instruction", "reward").join(runs, "round_index").join(seen, "instruction"), "history")
    own = rows.groupBy("run", "instruction", "first").agg(F.max("reward").alias("reward"))
    own = own.withColumn("nth", F.row_number().over(Window.partitionBy("run").orderBy(F.col("reward").desc(), F.col("first").desc()))).filter(F.col("nth") <= best)
    start = best_before(own.select("run", F.col("instruction").alias("item"), "reward", "first"), "run", ["reward", "first"], best)
    start = start.select("run", F.lit(None).cast("long").alias("round_index"), F.lit(None).cast("long").alias("ordinal"), F.col("item").alias("instruction"), "first", "reward")
    every = rows.select(*start.columns).unionByName(start)

    def follow(run: pd.DataFrame) -> pd.DataFrame:
        entry, later = run[run.ordinal.isna()], run[run.ordinal.notna()].sort_values("ordinal")
        held = dict(zip(entry.instruction, zip(entry.reward, entry["first"])))
        rounds, rewards = [], []
        at = later.round_index.astype("int64").tolist()
        for k, (instruction, state) in enumerate(zip(later.instruction.tolist(), zip(later.reward.tolist(), later["first"].tolist()))):
            if instruction in held or len(held) < best or state > min(held.values()):
                held[instruction] = max(held.get(instruction, state), state)
                if len(held) > best:
                    del held[min(held, key=held.get)]
            if k + 1 == len(at) or at[k + 1] != at[k]:
                rounds += [at[k]] * len(held)
                rewards += [v for v, _ in held.values()]
        return pd.DataFrame({"round_index": rounds, "reward": rewards}).astype({"round_index": "int64", "reward": "float64"})

    best_rows = every.groupBy("run").applyInPandas(follow, "round_index long, reward double")
    return batch.drop("first").join(best_rows.groupBy("round_index").agg(n.alias("n_best"), *summary("best_")), "round_index")


def promotion(scores: DataFrame) -> DataFrame:
    """Combinations by mean minibatch score, with which is next to promote.

    The highest mean that isn't promoted yet (ties: first seen); where all are promoted, the lowest.
    """
    by = scores.groupBy("combination").agg(F.round(F.avg(F.when(~F.col("is_full"), F.col("score"))), 9).alias("mean"), F.min("trial_number").alias("first_trial"), F.max("is_full").alias("promoted"))
    by = staged(ranked(by.filter("mean IS NOT NULL"), [F.col("mean").desc(), "first_trial"]), "combinations")
    next_ = by.agg(F.coalesce(F.min(F.when(~F.col("promoted"), F.col("rank"))), F.max("rank")).alias("r")).first()["r"]
    return by.withColumn("is_next", F.col("rank") == F.lit(next_))
