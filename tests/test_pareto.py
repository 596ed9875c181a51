from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalfold.operators import pareto


def plain(rows, objectives):
    """Ids of rows (id, group, values) that no other of their group dominates."""
    sign = [-1 if d == "max" else 1 for d in objectives.values()]
    cost = {i: (g, [s * x for s, x in zip(sign, v)]) for i, g, v in rows}
    beats = lambda a, b: all(x <= y for x, y in zip(a, b)) and a != b
    return {i for i, (g, c) in cost.items() if not any(h == g and beats(o, c) for h, o in cost.values())}


def frame(spark, rows, objectives):
    return spark.createDataFrame([(i, g, *map(float, v)) for i, g, v in rows], "id long, g string, " + ", ".join(f"{n} double" for n in objectives))


@pytest.mark.parametrize("d", [1, 2, 3, 5])
def test_front_equals_brute_force_with_ties(spark, d):
    r = random.Random(d)
    objectives = {f"o{i}": r.choice(["max", "min"]) for i in range(d)}
    rows = [(i, r.choice(["a", "a", "a", "b", None]), [r.randint(0, 6) if d < 5 else r.randint(0, 3) for _ in range(d)]) for i in range(300)]
    df = frame(spark, rows, objectives).repartition(5)
    want = plain(rows, objectives)
    assert {x.id for x in pareto.pareto_front(df, objectives, ["g"]).collect()} == want
    # Blocks and streams of a few rows, and cells of few bands, decide alike.
    assert {x.id for x in pareto.pareto_front(df, objectives, ["g"], cells=9, block=7, stream=11).collect()} == want


def test_a_front_of_every_row_and_one_of_one(spark):
    n = 3000
    x = [(i, None, [i, n - i, (i * 7) % n]) for i in range(n)]
    objectives = {"a": "max", "b": "max", "c": "min"}
    assert pareto.pareto_front(frame(spark, x, objectives), objectives, [], block=500, stream=900).count() == n
    first = pareto.pareto_front(frame(spark, [(i, "g", [i, i, -i]) for i in range(n)], objectives), objectives, ["g"])
    assert [r.id for r in first.collect()] == [n - 1]


def test_columns_stay_and_edges(spark):
    df = spark.createDataFrame([(1, 2, "x")], "q int, p int, _target string")
    assert pareto.pareto_front(df, {"q": "max", "p": "min"}, []).collect() == df.collect()
    assert pareto.pareto_front(df.limit(0), {"q": "max", "p": "min"}, []).count() == 0
    with pytest.raises(ValueError):
        pareto.pareto_front(df, {"q": "up"}, [])
    with pytest.raises(ValueError):
        pareto.pareto_front(df, {}, [])
    for bad in (None, float("nan"), float("inf")):
        with pytest.raises(Exception, match="not a finite value"):
            pareto.pareto_front(spark.createDataFrame([(bad,)], "q double"), {"q": "max"}, []).collect()
    zero = spark.createDataFrame([(0.0, 1), (-0.0, 2)], "q double, id int")
    assert pareto.pareto_front(zero, {"q": "max"}, []).count() == 2


def test_vectors_must_have_the_declared_objectives(spark):
    kind = "id int, v array<struct<name: string, direction: string, value: double>>"
    declared = {"q": "max", "p": "min"}
    good = spark.createDataFrame([(1, [("q", "max", 1.0), ("p", "min", 2.0)])], kind)
    assert [(r.q, r.p) for r in pareto.objective_columns(good, "v", declared).collect()] == [(1.0, 2.0)]
    for v in ([("p", "min", 2.0), ("q", "max", 1.0)], [("q", "min", 1.0), ("p", "min", 2.0)], [("q", "max", 1.0)], None):
        with pytest.raises(Exception, match="objectives differ"):
            pareto.objective_columns(spark.createDataFrame([(1, v)], kind), "v", declared).select("q").collect()
    with pytest.raises(ValueError):
        pareto.objective_columns(good, "v", {"id": "max"})


def test_dominated_in_steps():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 4, (200, 3)).astype(float), r.integers(0, 4, (150, 3)).astype(float)
    want = [any((o <= t).all() and (o < t).any() for o in b) for t in a]
    assert pareto.dominated(a, b, 7).tolist() == pareto.dominated(a, b).tolist() == want


def test_no_window_in_the_plan(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("q"), (F.col("id") % 5).alias("p"))
    plan = pareto.pareto_front(df, {"q": "max", "p": "min"}, [])._jdf.queryExecution().toString()
    assert "Window" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("groups", [2, 64])
def test_tasks_thin_their_rows_and_pass_the_front(groups, monkeypatch):
    monkeypatch.setattr(pareto, "GROUPS", groups)
    r = np.random.default_rng(5)
    x, g = np.round(r.random((6000, 3)), 2), [[None, "a", "b"][i % 3] for i in range(6000)]
    table = pa.table({"_k0": pa.array(g), **{f"_c{i}": x[:, i] for i in range(3)}})
    out = pa.Table.from_batches(pareto._thinned(["_k0"], ["_c0", "_c1", "_c2"])(iter(table.to_batches(max_chunksize=1000))))
    rows = lambda t: [tuple(v.values()) for v in t.to_pylist()]
    alone = {(k, *x[i]) for k in (None, "a", "b") for own in [np.array([j for j in range(6000) if g[j] == k])] for i in own[~pareto.dominated(x[own], x[own])]}
    got = rows(out)
    assert alone <= set(got) and all(got.count(v) == rows(table).count(v) for v in list(alone)[:20])
    assert len(got) < 1500 if groups == 64 else len(got) == 6000


def test_a_small_front_is_sent_to_the_rows(spark):
    df = spark.range(3000).select("id", (F.col("id") % 7).alias("q"), (F.col("id") % 5).alias("p"))
    out = pareto.pareto_front(df, {"q": "max", "p": "min"}, [])
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString() and out.count() == 85 + (3000 - 85 * 35 > 20)
