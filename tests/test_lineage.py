from __future__ import annotations

import random

import pytest

from evalfold.operators import lineage


@pytest.mark.parametrize("seed", range(3))
def test_ancestors_at_the_longest_distance(spark, seed):
    r = random.Random(seed)
    edges = [(i, p) for i in range(1, 60) for p in {r.randrange(max(0, i - 6), i) for _ in range(r.randint(0, 2))}]
    want: dict[int, dict[int, int]] = {}
    for i in range(60):
        own = want.setdefault(i, {})
        for _, p in (e for e in edges if e[0] == i):
            for a, d in [(p, 0), *want[p].items()]:
                own[a] = max(own.get(a, 0), d + 1)
    rows = [*edges, *edges[:5], (None, 1), (3, None)]
    got = lineage.ancestors(spark.createDataFrame(rows, "item long, parent long")).collect()
    assert {(x.item, x.ancestor, x.distance) for x in got} == {(i, a, d) for i, own in want.items() for a, d in own.items()} and len(got) == sum(map(len, want.values()))


def test_a_chain_a_cycle_and_nothing(spark):
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 90)], "item long, parent long")
    assert lineage.ancestors(chain).count() == 90 * 89 // 2
    with pytest.raises(ValueError, match="cycle"):
        lineage.ancestors(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "item long, parent long"))
    assert lineage.ancestors(chain.limit(0)).count() == 0


def test_hot_ancestors_are_dealt_to_several_tasks(spark, monkeypatch):
    # 300 items below one that ends a chain of six; a task takes fifty rows of a key.
    edges = [(i, i - 1) for i in range(1, 6)] + [(100 + i, 5) for i in range(300)] + [(1000 + i, 100 + i) for i in range(300)]
    seen = []
    met = lineage._met
    monkeypatch.setattr(lineage, "_met", lambda *a: seen.append(met(*a)) or seen[-1])
    got = lineage.ancestors(spark.createDataFrame(edges, "item long, parent long"), rows=50).collect()
    up = {i: i - 1 for i in range(1, 6)} | {100 + i: 5 for i in range(300)} | {1000 + i: 100 + i for i in range(300)}
    want = set()
    for i in up:
        a, d = i, 0
        while a in up:
            a, d = up[a], d + 1
            want.add((i, a, d))
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    parts = seen[1].select("middle", "part", "item").distinct().groupBy("middle", "part").count().filter("count > 90").count()  # 300 items continue at one middle
    assert len(seen) == 3 and "part" in seen[1].columns and parts == 0


def plain(members):
    """Items left, taken one by one."""
    sets, score = {}, {}
    for s, i, x in members:
        sets.setdefault(s, set()).add(i)
        score[i] = x
    left = set(score)
    for i in sorted(score, key=lambda i: (score[i], i)):
        if all((m & left) - {i} for m in sets.values() if i in m):
            left.discard(i)
    return left


@pytest.mark.parametrize("seed", range(5))
def test_uncovered_equals_one_by_one(spark, seed):
    r = random.Random(seed)
    score = {i: float(r.randrange(8)) for i in range(40)}
    members = [(s, i, score[i]) for s in range(30) for i in r.sample(range(40), r.randint(1, 6))]
    got = lineage.uncovered(spark.createDataFrame([*members, members[0]], "set long, item long, score double")).collect()
    assert {x.item for x in got} == plain(members) and len(got) == len(plain(members))


def test_uncovered_of_nothing(spark):
    assert lineage.uncovered(spark.createDataFrame([], "set long, item long, score double")).count() == 0
