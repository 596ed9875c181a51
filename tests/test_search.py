from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evalfold.operators import ranking, search

CALLS = []


def propose(top, n):
    CALLS.append(n)
    spark = top.sparkSession
    longest = top.agg(F.max(F.length("instruction")).alias("m")).first().m
    return spark.range(n).select(F.concat(F.lit("x" * longest), F.col("id").cast("string")).alias("instruction"))


def evaluate(rows):
    return rows.withColumn("reward", (F.length("instruction") + F.pmod(F.xxhash64("instruction"), F.lit(3))).cast("double"))


def test_rounds_and_resuming(spark, tmp_path):
    initial = spark.createDataFrame([("seed",)], "instruction string")
    store = str(tmp_path / "run")
    one = search.search_rounds(initial, propose, evaluate, 4, 2, store).orderBy("ordinal").collect()
    assert [r.ordinal for r in one] == list(range(8)) and one[0].instruction == "seed" and [r.round_index for r in one] == [0] * 4 + [1] * 4
    calls = len(CALLS)
    more = search.search_rounds(initial, propose, evaluate, 4, 3, store).orderBy("ordinal").collect()
    assert more[:8] == one and len(more) == 12 and len(CALLS) == calls + 1
    top = search.best(spark.createDataFrame(more), 3).orderBy("rank").collect()
    assert [r.reward for r in top] == sorted((r.reward for r in more), reverse=True)[:3]
    assert ranking.round_stats(spark.createDataFrame(more), 3).count() == 3


def test_a_short_round_fails(spark, tmp_path):
    initial = spark.createDataFrame([("seed",)], "instruction string")
    with pytest.raises(ValueError):
        search.search_rounds(initial, lambda top, n: propose(top, n - 1), evaluate, 4, 1, str(tmp_path))


def test_study_is_the_same_again(spark, tmp_path):
    score = lambda rows, full: rows.withColumn("score", (F.col("combination") * 7 % 5).cast("double") + F.lit(0.5 if full else 0.0))
    one = search.run_study(spark, 9, score, 8, 4, 3, str(tmp_path / "a")).orderBy("trial_number").collect()
    two = search.run_study(spark, 9, score, 8, 4, 3, str(tmp_path / "b")).orderBy("trial_number").collect()
    assert one == two and [r.is_full for r in one] == [False, False, False, True] * 2
    best = max((r for r in one[:3]), key=lambda r: (r.score, -r.trial_number))
    assert one[3].combination == best.combination
