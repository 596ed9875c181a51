from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from evalfold.operators import claims as C
from evalfold.operators import ranking, sampling
from evalfold.operators.scan import best_before, scanned


def hot(spark, n=6000, keys=40, seed=1):
    """Rows of which one key holds a third."""
    r = random.Random(seed)
    rows = [(i, None if i % 50 == 0 else "hot" if i % 3 == 0 else f"k{r.randrange(keys)}", r.randrange(n), r.choice([None, 1, 2, 5]), r.choice("abc")) for i in range(n)]
    return spark.createDataFrame(rows, "i long, k string, o long, v long, owner string").repartition(6)


@pytest.mark.parametrize("chunk", [None, "floor(o / 100)"])
def test_scans_equal_windows(spark, chunk):
    df = hot(spark)
    got = scanned(df, ["k"], ["o", "i"], number="n", sums={"s": F.col("v")}, most={"m": F.col("v")}, before={"was": "owner", "last_v": "v"}, chunk=None if chunk is None else F.expr(chunk))
    w = Window.partitionBy("k").orderBy("o", "i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({"n": F.row_number().over(w).cast("long"), "s": F.sum("v").over(upto), "m": F.max("v").over(upto), "was": F.lag("owner").over(w), "last_v": F.lag("v").over(w)})
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))


def test_a_hot_key_is_spread_over_tasks(spark, monkeypatch):
    from evalfold.operators import scan

    written, real = [], scan.staged
    monkeypatch.setattr(scan, "staged", lambda df, name: written.append(real(df, name)) or written[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one range
    try:
        got = sorted(r.n for r in scanned(hot(spark).filter("k = 'hot'"), ["k"], ["o", "i"], number="n").collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in written[0].groupBy("part").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 0.5 * len(got) and got == list(range(1, len(got) + 1))


def test_claims_equal_windows(spark):
    e = hot(spark, 3000)
    c = C.claim_events(e.withColumnRenamed("k", "intent").withColumn("value", F.col("v").cast("double")), "intent", ["o", "i"], "owner")
    rows = c.toPandas().sort_values(["o", "i"])
    for _, own in rows.groupby("intent", dropna=False):
        assert own.event_ordinal.tolist() == list(range(1, len(own) + 1))
        generation = (own.owner != own.owner.shift()).cumsum() - 1
        assert own.generation.tolist() == generation.tolist()
        assert own.heartbeat.tolist() == own.groupby(generation).cumcount().tolist()
    w = Window.partitionBy("intent").orderBy("event_ordinal")
    kinds = C.transitions(c).groupBy("kind").count().collect()
    assert {r.kind for r in kinds} == {"first", "renewal", "takeover"}
    small = C.lease_outcomes(c, 4, 2).select("i", "outcome").collect()
    was = c.select("i", "owner", F.lag("owner").over(w).alias("o"), F.lag("value").over(w).alias("x")).collect()
    plain = lambda r: "acquired" if r.o is None else "renewed" if r.o == r.owner else "succeeded" if (r.x or 0) >= 4 else "recovery-required" if r.x is not None and r.x < 2 else "busy"
    assert {r.i: r.outcome for r in small} == {r.i: plain(r) for r in was}


def test_invalid_transitions_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(C, "EVENTS", 3)
    rows = [("x", 1, "a", 0, 0), ("x", 2, "a", 0, 1), ("x", 3, "b", 1, 0), ("x", 4, "b", 1, 2), ("x", 5, "c", 3, 0), ("x", 6, "c", 3, 1)]
    got = C.transitions(spark.createDataFrame(rows, "intent string, event_ordinal long, owner string, generation long, heartbeat long")).collect()
    assert [r.kind for r in sorted(got, key=lambda r: r.event_ordinal)] == ["first", "renewal", "takeover", "invalid", "invalid", "renewal"]


def test_folds_of_a_hot_group(spark):
    r = random.Random(3)
    rows = [(i, "hot" if i % 3 else f"g{i % 7}", r.choices(["accept", "reject", "error"], [1, 60, 1])[0]) for i in range(3000)]
    got = {x.group_id: (x.n_used, x.n_accepted, x.n_errors, x.status) for x in sampling.fold_attempts(spark.createDataFrame(rows, "ordinal long, group_id string, outcome string"), 12, 14).collect()}
    want = {}
    for _, g, o in rows:
        used, a, e, s = want.get(g, (0, 0, 0, "open"))
        if s == "open":
            a, e = a + (o == "accept"), e + (o == "error")
            want[g] = (used + 1, a, e, "full" if a >= 12 else "aborted" if e >= 14 else "open")
    assert got == want


@pytest.mark.parametrize("nodes", [1, 2, 9, 70])
def test_best_before_equals_plain(spark, nodes):
    r = random.Random(nodes)
    rows = [(n, f"i{r.randrange(30)}", float(r.randrange(20)), -r.randrange(5)) for n in range(nodes) if n % 7 != 3 for _ in range(5)]
    got = {}
    for x in best_before(spark.createDataFrame(rows, "run long, item string, reward double, first long"), "run", ["reward", "first"], 4, fan=3).collect():
        got.setdefault(x.run, set()).add((x.item, x.reward, x["first"]))
    for n in range(nodes):
        best = {}
        for m, i, a, b in rows:
            if m < n:
                best[i] = max(best.get(i, (a, b)), (a, b))
        want = sorted(best.items(), key=lambda x: (-x[1][0], -x[1][1], x[0]))[:4]
        assert got.get(n, set()) == {(i, *v) for i, v in want}, n


def test_round_stats_of_a_million_attempts(spark):
    n = 1_000_000
    a = spark.range(n, numPartitions=8).select(F.col("id").alias("ordinal"), F.floor(F.col("id") / 10).alias("round_index"), (F.xxhash64("id") % 5000).cast("string").alias("instruction"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_000)) / 1e6 + F.col("id") / n).alias("reward"))
    got = ranking.round_stats(a, 10, breadth=10)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    got = got.toPandas().set_index("round_index")
    assert len(got) == n // 10
    rows = a.toPandas()
    for at in (0, 1, 409, 410, 50_000, 99_999):
        seen = rows[rows.round_index <= at].groupby("instruction").agg(reward=("reward", "max"), first=("ordinal", "min")).sort_values(["reward", "first"], ascending=[False, True]).head(10)
        assert got.loc[at].n_best == len(seen) and got.loc[at].best_mean == pytest.approx(seen.reward.mean()) and got.loc[at].best_min == pytest.approx(seen.reward.min())


def test_a_partial_round_fails(spark):
    rows = spark.createDataFrame([(i, i // 3, "x", 1.0) for i in range(8)], "ordinal long, round_index long, instruction string, reward double")
    assert ranking.round_stats(rows, 2).count() == 3
    with pytest.raises(Exception, match="a partial round: 2"):
        ranking.round_stats(rows, 2, breadth=3).collect()
    assert isinstance(ranking.round_stats(rows.limit(6), 2, breadth=3).toPandas(), pd.DataFrame)
