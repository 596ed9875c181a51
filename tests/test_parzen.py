from __future__ import annotations

import math
import random

import numpy as np
import pytest

from evalfold.operators import parzen


def plain(trials, sizes, startup=10):
    """{(study, number): combination} by the definition, one trial at a time."""
    choices = [(a, b) for a in range(sizes[0]) for b in range(sizes[1])]
    out = {}
    for study in {t[0] for t in trials}:
        own = sorted((t for t in trials if t[0] == study), key=lambda t: t[1])
        for k, t in enumerate(own):
            if k < startup:
                continue
            ranked = sorted(range(k), key=lambda i: (-own[i][2], i))
            good = set(ranked[: min(25, math.ceil(k / 10))])
            weight = lambda x, i: math.prod(n + 1 if v == w else 1 for n, v, w in zip(sizes, x, own[i][3:]))
            quotient = [(4 + sum(weight(x, i) for i in good)) / (4 + sum(weight(x, i) for i in range(k) if i not in good)) for x in choices]
            out[study, t[1]] = quotient.index(max(quotient))
    return out


@pytest.mark.parametrize("chunk", [7, 1000])
def test_proposals_equal_a_plain_version(spark, chunk):
    r = random.Random(chunk)
    trials = [(s, 3 * i + 1, r.choice([0.0, 0.25, 0.5, 1.0]) + (a == 2), a, b) for s, n in (("x", 150), ("y", 40), ("z", 3)) for i in range(n) for a, b in [(r.randrange(4), r.randrange(3))]]
    got = parzen.proposals(spark.createDataFrame(trials, "study string, trial_number long, score double, a int, b int").repartition(5), {"a": 4, "b": 3}, chunk=chunk).collect()
    assert len(got) == len(trials)
    want = plain(trials, [4, 3])
    assert {(x.study, x.trial_number): x.proposed for x in got if x.nth > 10} == want
    assert all(0 <= x.proposed < 12 and x.replayed == (x.proposed == x.recorded) for x in got)
    # What pays is proposed: after the start, most proposals take the choice that scores higher.
    assert np.mean([x.proposed // 3 == 2 for x in got if x.nth > 20]) > 0.8


def test_a_replay_is_checked(spark):
    kind = "study int, trial_number long, score double, a int"
    rows = [(1, i, float(i % 4), i % 4) for i in range(30)]
    first = {x.nth: x.proposed for x in parzen.proposals(spark.createDataFrame(rows, kind), {"a": 4}).collect()}
    for _ in range(3):  # record what was proposed, until the record replays
        rows = [(1, i, float(first[i + 1]), first[i + 1]) for i in range(30)]
        again = parzen.proposals(spark.createDataFrame(rows, kind), {"a": 4}).collect()
        first = {x.nth: x.proposed if all(y.replayed for y in again if y.nth < x.nth) else x.recorded for x in again}
    assert all(x.replayed for x in again if x.nth <= 11)


def test_refusals(spark):
    kind = "study int, trial_number long, score double, a int"
    for row in ((1, 1, None, 0), (1, 1, float("nan"), 0), (1, 1, 1.0, 4), (1, 1, 1.0, None)):
        with pytest.raises(Exception, match="not finite|not one of"):
            parzen.proposals(spark.createDataFrame([row], kind), {"a": 4}).collect()
    for bad in ({}, {"a": 0}, {"a": 5000}):
        with pytest.raises(ValueError):
            parzen.proposals(spark.createDataFrame([], kind), bad)
    assert parzen.proposals(spark.createDataFrame([], kind), {"a": 4}).count() == 0
