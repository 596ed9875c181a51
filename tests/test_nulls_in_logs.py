from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evalfold.operators import logs, sampling, statistics

#: i, key, order, value
ROWS = [(1, "a", 5, 2), (2, "a", None, 3), (3, None, 9, None), (4, None, 2, 7), (5, None, None, 1), (6, "b", 7, None), (7, "b", 8, 4), (8, "a", 25, None), (9, "a", 26, 1), (10, "a", 45, None)]
KIND = "i long, k string, o long, v long"


def plain(rows, value=None, combine=sum):
    """{i: number, or running value} by plain Python; nulls first."""
    out, held = {}, {}
    for i, k, o, v in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
        got = held.setdefault(k, [])
        got += [1] if value is None else [] if v is None else [v]
        out[i] = combine(got) if got else None
    return out


@pytest.mark.parametrize("chunk", [None, "floor(o / 20)", "floor(o / 1000)", "o"])
def test_numbered_keeps_rows_with_nulls(spark, chunk):
    df = spark.createDataFrame(ROWS, KIND)
    at = None if chunk is None else F.expr(chunk)
    for value, combine, own in ((None, F.sum, sum), ("v", F.sum, sum), ("v", F.max, max)):
        got = logs.numbered(df, ["k"], at, ["o", "i"], "n", value, combine)
        assert {r.i: r.n for r in got.collect()} == plain(ROWS, value, own)
    assert {r.i: r.n for r in logs.numbered(df, [], at, ["o", "i"], "n").collect()} == plain([(i, 0, o, v) for i, _, o, v in ROWS])


def test_running_total_keeps_rows_with_nulls(spark):
    for step in (3, 10_000):
        got = {r.i: r.total for r in logs.running_total(spark.createDataFrame(ROWS, KIND), "o", "v", step).collect()}
        upto = lambda o: [v for _, _, p, v in ROWS if v is not None and (p is None or (o is not None and p <= o))]
        assert got == {i: sum(upto(o)) if upto(o) else None for i, _, o, _ in ROWS}


def test_columns_named_like_the_helpers_stay(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], "o long, v long, range long, own long, k_of long").withColumn("k", F.lit(None).cast("string"))
    assert logs.running_total(df, "o", "v").select("range", "own", "total").first() == (3, 4, 2)
    assert logs.numbered(df, ["k"], F.col("o"), ["o"], "n").select("own", "k_of", "n").first() == (4, 5, 1)


def test_split_and_holm_keep_null_groups(spark):
    df = spark.createDataFrame(ROWS, KIND)
    got = sampling.tail_split(df, ["k"], "o", 0.5, 10).collect()
    assert len(got) == len(ROWS) and {r.i for r in got if r.part == "val"} == {9, 10, 3, 7}
    p = spark.createDataFrame([(1, None, 0.02), (2, None, 0.5), (3, "a", 0.1)], "i long, k string, p double")
    assert {r.i: (r.rank, round(r.adjusted, 6)) for r in statistics.holm(p, "p", "i", ["k"]).collect()} == {1: (1, 0.04), 2: (2, 0.5), 3: (1, 0.1)}
