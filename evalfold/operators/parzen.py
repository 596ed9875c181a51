"""Proposals of a tree-structured Parzen estimator over categorical parameters, for all trials of many studies at once.

Before a trial, its study's earlier trials are good (the best GOOD_SHARE of them, GOOD_MOST at most; of equal scores the earlier) or bad. Each
trial is a kernel over all combinations: for each parameter of k choices, k + 1 on its own choice and 1 on the others; one more kernel
is even. The combination of the largest quotient of the good and the bad kernels' sums is proposed (of equal ones the first). Sums
are whole numbers, so a replay elsewhere finds the same quotients to the last bit. The first STARTUP trials are hashes.

A study is cut into chunks of trials. What a chunk needs of those before it is how often each combination occurred and the
GOOD_MOST best trials: the first by sums over chunks, the second by a tree of merged states. Each chunk is then scored for
itself, all its trials and combinations by one matrix product, so no trial waits for another and a study of any length is spread.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalfold.operators.scan import best_before, scanned
from evalfold.operators.statistics import draw
from evalfold.sources.staging import staged

GOOD_SHARE, GOOD_MOST, STARTUP, CHUNK = 10, 25, 10, 1000
#: Combinations at most: each is scored for each trial.
COMBINATIONS = 4096


def kernels(sizes: list[int]) -> np.ndarray:
    """What a kernel (row) gives to each combination (column); combinations are numbered with the last parameter fastest."""
    out = np.ones((1, 1))
    for k in sizes:
        out = np.kron(out, np.ones((k, k)) + k * np.eye(k))
    return out


def proposals(trials: DataFrame, parameters: dict[str, int], seed: int = 0, startup: int = STARTUP, chunk: int = CHUNK) -> DataFrame:
    """(study, trial_number, nth, proposed, recorded, replayed): the combination proposed before each trial, and the one recorded.

    trials: study, trial_number (unique in a study), score, and one column of choices (from 0) for each parameter. A score that is null
    or not finite fails, as does a choice that its parameter hasn't. replayed says whether both combinations are the same.
    """
    sizes = [*parameters.values()]
    n = math.prod(sizes)
    if not sizes or min(sizes) < 1 or n > COMBINATIONS:
        raise ValueError(f"parameters need choices, and {COMBINATIONS} combinations at most: {parameters}")
    fail = lambda what: F.raise_error(F.lit(what))
    number = F.lit(0).cast("long")
    for name, k in parameters.items():
        number = number * k + F.when(F.col(name).between(0, k - 1), F.col(name).cast("long")).otherwise(fail(f"{name}: not one of its choices").cast("long"))
    score = F.when(F.abs("score") < float("inf"), F.col("score").cast("double")).otherwise(fail("a score is not finite").cast("double"))
    rows = scanned(trials.select("study", "trial_number", number.alias("recorded"), score.alias("score")), ["study"], ["trial_number"], number="nth")
    rows = staged(rows.withColumn("chunk", F.floor((F.col("nth") - 1) / chunk)), "trials")

    counts = rows.groupBy("study", "chunk", "recorded").agg(F.count(F.lit(1)).alias("n"))
    chunks = rows.select("study", "chunk").distinct()
    # Counts before each chunk, of the combinations that occurred: running sums over the chunks of a combination, carried to the next chunk.
    known = counts.select("study", "recorded").distinct().join(chunks, "study").join(counts, ["study", "chunk", "recorded"], "left")
    before = known.withColumn("n", F.sum("n").over(Window.partitionBy("study", "recorded").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))).filter("n > 0")
    top = rows.withColumn("place", F.row_number().over(Window.partitionBy("study", "chunk").orderBy(F.col("score").desc(), "nth"))).filter(F.col("place") <= GOOD_MOST)
    best = best_before(top.select("study", "chunk", F.struct("nth", "recorded").alias("item"), "score", (-F.col("nth")).alias("early")), "chunk", ["score", "early"], GOOD_MOST, keys=["study"])
    none = F.lit(None).cast("long")
    every = rows.select("study", "chunk", F.lit("trial").alias("kind"), "trial_number", "nth", "recorded", "score", none.alias("n"))
    every = every.unionByName(before.select("study", "chunk", F.lit("count").alias("kind"), none.alias("trial_number"), none.alias("nth"), "recorded", F.lit(None).cast("double").alias("score"), "n"))
    every = every.unionByName(best.select("study", "chunk", F.lit("best").alias("kind"), none.alias("trial_number"), F.col("item.nth").alias("nth"), F.col("item.recorded").alias("recorded"), "score", none.alias("n")))
    shape = kernels(sizes)

    def follow(group: pd.DataFrame) -> pd.DataFrame:
        own = group[group.kind == "trial"].sort_values("nth")
        entry, held = group[group.kind == "count"], group[group.kind == "best"]
        at, nth = own.recorded.to_numpy(np.int64), own.nth.to_numpy(np.int64)
        start = np.zeros(n)
        start[entry.recorded.to_numpy(np.int64)] = entry.n.to_numpy(float)
        one = np.zeros((len(own), n))
        one[np.arange(len(own)), at] = 1
        seen = start + np.cumsum(one, axis=0) - one
        good = np.zeros((len(own), n))
        best_ = sorted(zip((-held.score).tolist(), held.nth.astype(int).tolist(), held.recorded.astype(int).tolist()))
        for i, (s, k, c) in enumerate(zip((-own.score).tolist(), nth.tolist(), at.tolist())):
            for _, _, b in best_[: min(GOOD_MOST, -(-(k - 1) // GOOD_SHARE))]:
                good[i, b] += 1
            best_.append((s, k, c))
            best_.sort()
            del best_[GOOD_MOST:]
        even = 2.0 ** len(sizes)
        quotient = (good @ shape + even) / ((seen - good) @ shape + even)
        return pd.DataFrame({"study": own.study, "trial_number": own.trial_number.astype("int64"), "nth": nth, "proposed": quotient.argmax(axis=1), "recorded": at})

    kind = rows.schema["study"].dataType.simpleString()
    out = every.groupBy("study", "chunk").applyInPandas(follow, f"study {kind}, trial_number long, nth long, proposed long, recorded long")
    proposed = F.when(F.col("nth") <= startup, draw(F.lit(n), F.lit(seed), F.col("study"), F.col("nth"))).otherwise(F.col("proposed"))
    return out.withColumn("proposed", proposed).withColumn("replayed", F.col("proposed") == F.col("recorded"))
