from __future__ import annotations

import random

import numpy as np
import pytest

from evalfold.operators.generators import Twisters, check_log, check_streams


def test_ten_thousand_streams_equal_the_standard_generator():
    seeds = np.concatenate([np.arange(9990), [2**31, 2**32 - 1, 2**32, 2**40 + 5, 2**62, -7, -(2**33), 12345, 1, 0]])
    t, standard = Twisters.seeded(seeds), [random.Random(int(s)) for s in seeds]
    every = np.arange(len(seeds))
    for n in (1, 2, 10, 2**31, 1000):
        assert t.below(every, np.full(len(seeds), n)).tolist() == [r.randrange(n) for r in standard]
    some = every[::37]
    assert t.draw(some, "randint", np.full(len(some), -5), np.full(len(some), 100)) == [[standard[i].randint(-5, 100)] for i in some]
    for i in every[:: 500].tolist() + [9992, 9995]:
        assert [*t.words[i].tolist(), int(t.place[i])] == [*standard[i].getstate()[1]]


def test_shuffles_and_samples_of_many_sizes():
    seeds = np.arange(300)
    t, standard = Twisters.seeded(seeds), [random.Random(int(s)) for s in seeds]
    n = np.array([i % 41 for i in range(300)])
    for _ in range(20):  # over several turns of the state
        want = [[*range(k)] for k in n]
        for r, w in zip(standard, want):
            r.shuffle(w)
        assert t.shuffled(seeds, n) == want
    k = np.array([i % 13 for i in range(300)])
    for size in (13, 21, 22, 90, 5000):
        assert t.sampled(seeds, np.full(300, size), np.minimum(k, size)) == [r.sample(range(size), min(int(x), size)) for r, x in zip(standard, k)]
    assert all([*t.words[i].tolist(), int(t.place[i])] == [*standard[i].getstate()[1]] for i in range(300))


def record(stream, seed, n, every):
    r, draws, states = random.Random(seed), [], []
    for i in range(n):
        op = ("randint", "choice", "sample", "shuffle")[(i * 7 + seed) % 4]
        a, b = {"randint": (3, 50 + i), "choice": (i + 1, None), "sample": (40 + i, i % 9), "shuffle": (i % 12, None)}[op]
        items = [*range(a)]
        result = [r.randint(a, b)] if op == "randint" else [r.choice(items)] if op == "choice" else r.sample(range(a), b) if op == "sample" else items
        if op == "shuffle":
            r.shuffle(result)
        draws.append([stream, i, op, a, b, result])
        if (i + 1) % every == 0 or i + 1 == n:
            states.append([stream, seed, i // every, [*r.getstate()[1]]])
    return draws, states


@pytest.fixture(scope="module")
def log():
    both = [record(s, 100 + i, 23 + i, 10) for i, s in enumerate(["a", "b", "c", None, "e", "f", "g"])]
    return [d for x, _ in both for d in x], [s for _, x in both for s in x]


def found(spark, draws, states):
    d = spark.createDataFrame(draws, "stream string, ordinal long, operation string, a long, b long, result array<long>").repartition(3)
    s = spark.createDataFrame(states, "stream string, seed long, segment long, state array<long>")
    return {(r.stream, r.segment): (r.problem, r.ordinal) for r in check_streams(d, s, 10).collect()}


def test_a_true_log_is_confirmed(spark, log):
    assert found(spark, *log) == {}
    assert found(spark, [], log[1]) == {}  # nothing was drawn: states without draws have nothing to confirm


def test_changes_are_found(spark, log):
    draws, states = [[*d] for d in log[0]], [[*s] for s in log[1]]
    at = {(d[0], d[1]): d for d in draws}
    at["a", 12][5] = [-1]
    at["b", 3][2] = "gauss"
    draws.remove(at["c", 4])
    at[None, 25][5] = at[None, 25][5] + [0]
    state = {(s[0], s[2]): s for s in states}
    state["e", 1][3] = [*state["e", 1][3]]
    state["e", 1][3][17] ^= 1
    states.remove(state["f", 0])
    state["g", 0][1] = 999
    got = found(spark, draws, states)
    assert got.pop(("a", 1)) == ("result", 12) and got.pop(("b", 0)) == ("operation", 3) and got.pop(("c", 0)) == ("ordinals", 4) and got.pop((None, 2)) == ("result", 25)
    assert got.pop(("e", 1)) == ("state", None) and got.pop(("f", 0)) == ("state", None) and got.pop(("f", 1)) == ("no state to start from", None)
    assert got.pop(("g", 0))[0] == "result"
    got.pop(("e", 2), None)  # it started from the changed state
    assert got == {}


def test_a_log_is_checked_over_its_blocks_in_one_exchange(spark):
    every, n = 8, 700  # a stream of 88 segments, in blocks of 32
    draws, states = record(3, 77, n, every)
    packed = {s[2]: np.array(s[3], dtype="<u4") for s in states}
    packed[40][5] ^= 1
    packed[60] = packed[60][:-1]
    draws[8 * 63 + 2][5] = [-1]
    draws[8 * 64 + 7][5] = None
    ends = lambda i: (i + 1) % every == 0 or i + 1 == n
    log = [(s, 77, *d[1:], bytearray(packed[d[1] // every].tobytes()) if ends(d[1]) and d[1] // every != 31 else None) for d in draws for s in [d[0]]]
    df = spark.createDataFrame(log, "stream long, seed long, ordinal long, operation string, a long, b long, result array<long>, state binary").repartition(5)
    checked = check_log(df, every, 6)
    got = {r.segment: (r.problem, r.ordinal) for r in checked.collect()}
    assert got.pop(41)[0] in ("result", "state")  # it started from a changed state
    assert got == {31: ("state", None), 32: ("no state to start from", None), 40: ("state", None), 60: ("state", None), 61: ("no state to start from", None), 63: ("result", 506), 64: ("result", 519)}
    plan = checked.select("*")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and plan.count("Exchange hash") == 1


def test_states_out_of_bounds_are_none(spark, log):
    draws, states = log[0], [[*s] for s in log[1]]
    at = {(s[0], s[2]): s for s in states}
    at["a", 0][3] = [2**40, *at["a", 0][3][1:]]
    at["b", 0][3] = [*at["b", 0][3][:-1], 700]
    at["c", 0][3] = None
    got = found(spark, draws, states)
    assert got == {(x, s): ("state", None) if s == 0 else ("no state to start from", None) for x in "abc" for s in (0, 1)}


def test_the_query_records_many_streams_in_a_task(spark):
    from evalfold.plans.sampling import rng_checkpoints

    plan = rng_checkpoints(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "Window" not in plan and plan.count("MapInArrow") >= 2
