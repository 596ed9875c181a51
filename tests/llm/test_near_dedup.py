from __future__ import annotations

import random

import numpy as np
import pytest

from evalfold.llm.components import components, union_find
from evalfold.llm.near_dedup import SMALL, near_duplicates
from evalfold.llm.superminhash import band_hashes, signatures

from . import brute
from .conftest import rows


def edited(base, share, r):
    return " ".join(f"e{r.randrange(10**6)}" if r.random() < share else w for w in base)


@pytest.mark.parametrize("k", [2, 5])
def test_components_equal_brute_force(spark, docs, k):
    got = near_duplicates(docs, k).toPandas()
    want = brute.near([(i, t) for i, t, *_ in rows()], k)
    sets = {i: brute.shingles(t, k) for i, t, *_ in rows()}
    assert len(got) == len(rows())
    for r in got.itertuples():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], r.doc_id == want[r.doc_id])


def test_large_group_of_edited_copies(spark):
    r = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    texts = [edited(base, r.choice([0.0, 0.02, 0.05, 0.07, 0.1]), r) for _ in range(6 * SMALL)] + [" ".join(f"o{r.randrange(999)}" for _ in range(80)) for _ in range(60)]
    rows_ = [*enumerate(texts)]
    got = near_duplicates(spark.createDataFrame(rows_, "doc_id long, text string").repartition(4), 2).toPandas()
    want = brute.near(rows_, 2)
    assert dict(zip(got.doc_id, got.component_id)) == want and len(set(want.values())) > 62


@pytest.mark.parametrize("k", [1, 2])
def test_many_documents_share_a_passage_and_few_are_linked(spark, k, monkeypatch):
    """Three fifths of each text are a common passage, so bands fill with documents that aren't similar; some have copies with an edit."""
    from evalfold.llm import near_dedup as N

    compared = []
    monkeypatch.setattr(N, "_verified", lambda pairs, *a, was=N._verified: compared.append(pairs) or was(pairs, *a))
    r = random.Random(6)
    passage = [f"p{i}" for i in range(90)]
    texts = [[*passage, *(f"o{r.randrange(10**6)}" for _ in range(60))] for _ in range(500)]
    texts += [t[:-2] + ["changed"] for t in texts[::9]] + [t[: 149 - i % 40] for i, t in enumerate(texts[::7])]
    r.shuffle(texts)
    rows_ = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = near_duplicates(spark.createDataFrame(rows_, "doc_id long, text string").repartition(4), k).toPandas()
    assert dict(zip(got.doc_id, got.component_id)) == brute.near(rows_, k)
    assert sum(p.count() for p in compared) < 20 * len(rows_)


def test_pairs_of_blocks_lose_no_link(spark, monkeypatch):
    """All stages before the last find nothing here, so every link comes from pairs of blocks of a few nodes."""
    from pyspark.sql import functions as F

    from evalfold.llm import near_dedup as N

    monkeypatch.setattr(N, "BLOCK_NODES", 5)
    r = np.random.default_rng(3)
    base = r.choice(10**9, 100, replace=False)
    sets = [sorted({*base[: r.integers(60, 101)].tolist(), *r.integers(10**9, 2 * 10**9, r.integers(0, 25)).tolist()}) for _ in range(70)]
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "doc_id long, shingles array<long>")
    rows_ = frame.select(F.lit(1).cast("long").alias("band"), F.col("doc_id").alias("node"), F.size("shingles").cast("long").alias("n"), F.col("doc_id").alias("label"))
    mixed = spark.createDataFrame([(1, 69)], "band long, top long")
    got = {(x.a, x.b) for x in N._block_links(rows_, mixed, frame, 80).collect()}
    want = {(i, j) for j in range(70) for i in range(j) if 100 * len({*sets[i]} & {*sets[j]}) >= 80 * len({*sets[i]} | {*sets[j]})}
    assert got == want and want


def test_rows_without_id_and_empty_table(spark, no_docs):
    got = near_duplicates(spark.createDataFrame([(None, "a b c"), (4, "a b c"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (0, 0, True), (4, 4, True)]
    assert near_duplicates(no_docs).count() == 0


def test_signatures_estimate_similarity_with_less_variance():
    r = np.random.default_rng(1)
    estimates = []
    for _ in range(200):
        u = r.integers(0, 2**63, size=120, dtype=np.uint64)
        s = signatures(np.concatenate([u[:100], u[20:]]), np.array([100, 100]), 128)
        estimates.append((s[0] == s[1]).mean())
    similarity = 80 / 120
    assert abs(np.mean(estimates) - similarity) < 0.01
    assert np.std(estimates) < np.sqrt(similarity * (1 - similarity) / 128)
    one = signatures(np.array([7], dtype=np.uint64), np.array([1]), 128)
    assert len(set(one[0].tolist())) == 128 and (signatures(np.array([], dtype=np.uint64), np.array([0]), 8) == 2**64 - 1).all()
    bands = band_hashes(one, 32)
    assert bands.shape == (1, 32) and len(set(bands[0].tolist())) == 32


def test_components_of_random_graphs_and_chains(spark):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 5001 + i) for i in range(100)]
    edges = [(a, b) for a, b in edges if a != b]
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == union_find(iter(edges))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
