from __future__ import annotations

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evalfold.operators import resampling as R
from evalfold.operators import statistics as S


def plain_binomial(m, p, u):
    total = 0.0
    for k in range(m + 1):
        total += math.comb(m, k) * p**k * (1 - p) ** (m - k)
        if total > u:
            return k
    return m


def plain_means(values, resamples, seed):
    """Means by one recursion a resample, without arrays."""
    kinds = sorted(Counter(values).items())
    depth = (len(kinds) - 1).bit_length()

    def split(node, low, high, m, r):
        inside = kinds[low:high]
        if not inside or not m:
            return 0.0
        if high - low == 1:
            return m * inside[0][0]
        middle = (low + high) // 2
        p = sum(c for _, c in kinds[low:middle]) / sum(c for _, c in inside)
        left = m if p >= 1 else plain_binomial(m, p, float(R.uniform(seed, np.array([r]), node)[0]))
        return split(2 * node, low, middle, left, r) + split(2 * node + 1, middle, high, m - left, r)

    return [split(1, 0, 1 << depth, len(values), r) / len(values) for r in range(resamples)]


@pytest.mark.parametrize("subtree", [1, 2, 12])
def test_means_equal_a_plain_recursion(spark, subtree):
    r = random.Random(1)
    groups = {"a": [r.choice([0.0, 0.5, 1.0]) for _ in range(40)], "b": [r.gauss(0, 1) for _ in range(37)], None: [2.5] * 9, "c": [1.0]}
    df = spark.createDataFrame([(k, x) for k, v in groups.items() for x in v], "k string, value double").repartition(5)
    got = {}
    for row in R.resampled_means(df, ["k"], 25, 4, subtree).collect():
        got.setdefault(row.k, {})[row.resample] = row["mean"]
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert [got[k][i] for i in range(25)] == pytest.approx(plain_means(v, 25, 4), abs=1e-9)


def test_binomials_follow_their_distribution():
    u = (np.arange(20_000) + 0.5) / 20_000
    for m, p in ((1, 0.3), (7, 0.5), (1000, 0.01), (60_000, 0.4)):
        k = R._inverse(m, p, u)
        assert abs(k.mean() - m * p) < 0.02 * math.sqrt(m * p * (1 - p)) + 1e-3 and abs(k.std() - math.sqrt(m * p * (1 - p))) < 0.02 * math.sqrt(m * p * (1 - p)) + 1e-3
        if m < 1001:
            assert k[::500].tolist() == [plain_binomial(m, p, x) for x in u[::500].tolist()]
    many = R.binomial(np.full(2000, 5 * R.PIECE + 17), 0.25, 3, np.arange(2000), 1)
    n = 5 * R.PIECE + 17
    assert abs(many.mean() - n / 4) < 4 * math.sqrt(n * 3 / 16 / 2000) and 0.9 < many.std() / math.sqrt(n * 3 / 16) < 1.1


def test_counts_are_multinomial():
    at = np.stack([m for _, m in R._below(np.full(4000, 30), 1, 2, np.array([1, 2, 3]), 5, np.arange(4000))], axis=1)
    assert (at.sum(1) == 30).all()
    assert at.mean(0) == pytest.approx([5, 10, 15], abs=0.15)
    assert np.cov(at.T)[0, 2] == pytest.approx(-30 * 1 / 6 * 1 / 2, abs=0.3)


def test_sql_of_the_splitting(spark):
    r = random.Random(6)
    rows = [(f"g{i % 3}", r.choice([0.1, 0.25, 0.5, 0.7, 2.0, -1.0, 3.5])) for i in range(300)] + [("one", 1.5)] * 4
    con = duckdb.connect()
    con.execute("CREATE TABLE vals (grp VARCHAR, value DOUBLE)")
    con.executemany("INSERT INTO vals VALUES (?, ?)", rows)
    want = con.sql("WITH " + R.resampled_sql("grp", 60, 9) + " SELECT grp, r, mean FROM me").fetchall()
    got = [(x.k, x.resample, round(x["mean"], 9)) for x in R.resampled_means(spark.createDataFrame(rows, "k string, value double"), ["k"], 60, 9).collect()]
    assert sorted(got) == sorted(want) and len(got) == 4 * 60


def test_interval_of_one_value_is_degenerate(spark):
    values = spark.createDataFrame([("c", 0.4)], "k string, value double")
    r = S.interval(R.resampled_means(values, ["k"], 50, 1), spark.createDataFrame([("c", 1, 0.4)], "k string, n long, point double"), ["k"], 50).first()
    assert (r.low, r.high, r.p) == (0.4, 0.4, 1.0)


def test_bootstrap_covers(spark):
    r = random.Random(2)
    rows = [(f"t{t}", r.gauss(0.3, 1)) for t in range(60) for i in range(40)]
    values = spark.createDataFrame(rows, "k string, value double")
    points = values.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("point"))
    got = S.interval(R.resampled_means(values, ["k"], 400, 5), points, ["k"], 400).collect()
    assert sum(x.low <= 0.3 <= x.high for x in got) / 60 >= 0.85


def test_edges(spark):
    kind = "k string, value double"
    assert R.resampled_means(spark.createDataFrame([], kind), ["k"], 5).count() == 0
    for bad in (None, float("nan")):
        with pytest.raises(Exception, match="null or NaN"):
            R.resampled_means(spark.createDataFrame([("a", bad)], kind), ["k"], 5).collect()
    with pytest.raises(ValueError):
        R.resampled_means(spark.createDataFrame([], kind), ["k"], 0)


def test_no_row_is_a_draw(spark):
    """200,000 values of two kinds take two leaves, and each task one sum for each resample."""
    df = spark.range(200_000).select(F.lit("g").alias("k"), (F.col("id") % 2).cast("double").alias("value"))
    got = R.resampled_means(df, ["k"], 1000, 3)
    means = [x["mean"] for x in got.collect()]
    assert len(means) == 1000 and np.std(means) == pytest.approx(0.5 / math.sqrt(200_000), rel=0.1) and np.mean(means) == pytest.approx(0.5, abs=1e-4)
