from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalfold.llm import fill_in_middle as fim
from evalfold.llm import periodic_runs as pr
from evalfold.llm import toxicity as tox
from evalfold.llm.queries import QUERIES
from evalfold.llm.suffixes import Suffixes

from . import brute
from .conftest import EXTRA, TEXTS, rows

SF = "/root/testdata/sf0.001"
ODD = ["<P>", "a<S>b", "x<M", "<", "<P", "P>", "<PP>", "<<P>", "<P<S>", "ab1cd  ef", "ä<é>ß", "日本<M語>", "𝒳y𝒵<", "AbC-dEf\x00\n\r\n", "é" * 50 + "word" + "é" * 50]


def plain_middle(doc_id, text, seed="1"):
    u = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(u), "plain", None, None, text
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    return (len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def middles(df):
    return [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in df.withColumn("restored", fim.restored(F.col("output"), F.col("form"))).collect()]


def test_middle_equals_a_plain_version(spark):
    data = [(i if i % 7 else None, t) for i, t in enumerate([*TEXTS, *ODD] * 6)]
    got = middles(fim.fill_in_middle(spark.createDataFrame(data, "doc_id long, text string").repartition(3)))
    want = [(i, *plain_middle(i, t or ""), t or "") for i, t in data]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 64])
def test_middle_in_chunks_of_any_size(monkeypatch, chunk):
    texts = [t.encode() for t in [*ODD, "", "plain words, and <more>"]]
    whole = fim.Units(texts)
    wanted = [(r, k) for r, n in enumerate(whole.units.tolist()) for k in range(n + 1)]
    r, k = (np.array(x) for x in zip(*wanted))
    there = whole.locate(r, k)
    monkeypatch.setattr(fim, "CHUNK", chunk)
    cut = fim.Units(texts)
    assert cut.units.tolist() == whole.units.tolist() == [len(re.findall("[A-Za-z]+|[^A-Za-z]", t.decode(), re.S)) for t in texts]
    assert cut.has_sentinel.tolist() == whole.has_sentinel.tolist() == [any(s in t for s in (b"<P>", b"<S>", b"<M>")) for t in texts]
    for a, b in zip(cut.locate(r, k), there):
        assert a.tolist() == b.tolist()
    units = [[*re.finditer("[A-Za-z]+|[^A-Za-z]", t.decode(), re.S)] for t in texts]
    for (row, n), byte, point in zip(wanted, *there):
        at = units[row][n].start() if n < len(units[row]) else len(texts[row].decode())
        assert (byte, point) == (len(texts[row].decode()[:at].encode()), at)


def test_middle_automaton_forgets_within_two_bytes():
    assert fim.MEMORY == 2


def test_middle_edges(docs, no_docs):
    out = fim.fill_in_middle(docs)
    assert set(docs.columns) <= set(out.columns) and sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(r[0] for r in rows())
    assert {r.n for r in out.select("n").collect()} == {len(re.findall("[A-Za-z]+|[^A-Za-z]", t or "", re.S)) for t in TEXTS}
    assert fim.fill_in_middle(no_docs).count() == 0


def plain_runs(w, min_words=24, min_periods=3):
    found = {}
    for q in range(1, len(w) // min_periods + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items() if n >= max(min_words, min_periods * q)), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    r = random.Random(seed)
    for _ in range(40):
        texts = []
        for _ in range(r.randint(0, 6)):
            letters = r.choice([1, 2, 3, 20])
            w = [r.randrange(letters) for _ in range(r.choice([0, 1, 5, 23, 24, 40, 90]))]
            for _ in range(r.randint(0, 3)):
                at, period = r.randint(0, len(w)), r.randint(1, 12)
                block = [r.randrange(letters) for _ in range(period)]
                w[at:at] = [block[i % period] for i in range(r.randint(1, 60))]
            texts.append(w)
        for least in ((24, 3), (6, 2), (2, 2), (10, 4)):
            assert pr.runs_of([np.array(t, np.int64) for t in texts], *least) == [plain_runs(t, *least) for t in texts]


def test_suffix_tree_against_sorting():
    r = random.Random(5)
    w = np.array([r.randrange(3) for _ in range(120)] + [-1])
    tree = Suffixes(w)
    suffixes = [w[i:].tolist() for i in range(len(w))]
    assert tree.order.tolist() == sorted(range(len(w)), key=suffixes.__getitem__)
    shared = lambda a, b: next((k for k in range(len(w)) if a + k >= len(w) or b + k >= len(w) or w[a + k] != w[b + k]), 0)
    assert tree.lcp.tolist()[1:] == [shared(a, b) for a, b in zip(tree.order, tree.order[1:])]
    low, high = tree.node(tree.rank[np.arange(100)], np.full(100, 3))
    for i in range(100):
        assert sorted(tree.order[low[i] : high[i] + 1]) == [j for j in range(len(w)) if suffixes[j][:3] == suffixes[i][:3]]
    p = 0
    for start in tree.blocks().tolist():
        assert start == p
        p += max(1, max((shared(q, p) for q in range(p)), default=0))


def test_long_texts_of_runs():
    w = np.arange(9000)
    assert pr.runs_of([np.tile(w, 4), np.zeros(50_000, np.int64), np.arange(150_000)]) == [[(0, 36_000, 9000)], [(0, 50_000, 1)], []]


def test_runs_edges(docs, no_docs):
    out = {r.doc_id: r for r in pr.periodic_runs(docs).collect()}
    for i, t, *_ in rows():
        words = [x for x in re.split("[\x20\x09-\x0d]+", t or "") if x]
        want = plain_runs(words) if len(words) < 3000 else [(0, 30_000, 977)]
        assert [tuple(x) for x in out[i].runs] == want
        if not want:
            assert out[i].longest is None and out[i].collapsed == " ".join(words)
    assert pr.periodic_runs(docs).count() == len(rows()) and pr.periodic_runs(no_docs).count() == 0


def test_ties_of_runs(spark):
    a, b = " ".join("abcdefgh" * 4), " ".join("ijkl" * 8)
    texts = [(1, f"{a} x {a}"), (2, f"{a} x {b}"), (None, None), (None, f"{b}\u00a0x")]
    got = {r.text: r for r in pr.periodic_runs(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert [tuple(x) for x in got[texts[0][1]].runs] == [(0, 32, 8), (33, 32, 8)] and got[texts[0][1]].longest.start == 0
    assert got[texts[1][1]].longest.start == 33
    assert got[None].longest is None and got[None].runs == [] and got[None].collapsed == ""
    assert tuple(got[texts[3][1]].longest) == (0, 31, 4)  # a no-break space is part of a word


def test_op12_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        w = [x for x in re.split("[\x20\x09-\x0d]+", texts[i]) if x]
        n, h = len(w), zlib.crc32(str(i).encode())
        g = h // 10
        if n and h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        want = plain_runs(w)
        best = max(want, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        gone = {k for s, length, q in want for k in range(s + q, s + length)}
        assert r.n_runs == len(want) and r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in want).encode()).hexdigest()
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()


@pytest.fixture(scope="module")
def invented():
    """Texts of invented words, some with insults; label 1 where there is one."""
    r = random.Random(3)
    word = lambda: "".join(r.choice(["ba", "re", "mi", "to", "lun", "ers", "ing"]) for _ in range(r.randint(1, 4)))
    vocabulary = [word() for _ in range(400)]
    out = []
    for i in range(900):
        w = [r.choice(vocabulary) for _ in range(r.randint(10, 200))]
        bad = i % 5 == 0
        if bad:
            for _ in range(r.randint(1, 4)):
                w[r.randrange(len(w))] = r.choice(["vilegrub", "rotface", "snotbrain", "dungheap"])
        out.append((i, " ".join(w), int(bad)))
    return out


@pytest.fixture(scope="module")
def model(invented):
    return tox.train(pa.array([t for _, t, _ in invented[:600]]), np.array([y for *_, y in invented[:600]]), np.ones(600))


def test_toxicity_on_held_out_texts(model, invented):
    score = model.scores(pa.array([t for _, t, _ in invented[600:]]))
    y = np.array([y for *_, y in invented[600:]])
    assert ((score >= tox.THRESHOLD) == y).mean() > 0.99


def test_toxicity_of_unseen_misspellings_and_long_texts(model, invented):
    clean = [t for _, t, y in invented[600:] if not y][:40]
    low = model.scores(pa.array(clean))
    for bad in ("vilegrubb", "vilegrub!!!", "VileGrub", "rottface", "snotbrian"):
        assert (model.scores(pa.array([f"{t} {bad} {bad}" for t in clean])) > low).mean() > 0.9, bad
    long = " ".join(clean * 20)
    assert model.scores(pa.array([long]))[0] < tox.THRESHOLD <= model.scores(pa.array([long + " dungheap"]))[0]


def test_word_parts_are_the_linear_softmax_of_averaged_vectors(model):
    words = ["vilegrub", "ä", "日本", "x" * 300]
    buckets, first = tox.ngrams(words)
    for i, w in enumerate(words):
        inside = slice(first[i], first[i + 1])
        grams = sum(max(0, len(w) + 2 - n + 1) for n in range(3, 7) if len(w) + 2 > n)
        assert first[i + 1] - first[i] == grams + 1
        assert np.isclose(tox.shares(first)[inside].sum(), 1, atol=1e-4)
        assert np.isclose(model.word_parts(words)[i], (model.table[buckets[inside]] * tox.shares(first)[inside]).sum(), atol=1e-3)
    alone = model.scores(pa.array(["vilegrub"]))[0]
    assert np.isclose(alone, 1 / (1 + np.exp(-model.word_parts(["vilegrub"])[0] - model.bias)))


def test_strongest_words():
    parts, first = np.array([1.0, 5, 5, 2, 7, 0]), np.array([0, 4, 4, 6])
    at, sizes = tox.strongest(parts, first, 2)
    assert at.tolist() == [1, 2, 4, 5] and sizes.tolist() == [2, 0, 2]


def test_training_again_gives_the_same_model(invented):
    texts, y = pa.array([t for _, t, _ in invented[:200]]), np.array([y for *_, y in invented[:200]])
    a, b = (tox.train(texts, y, np.ones(200)) for _ in range(2))
    assert a.bias == b.bias and (a.table == b.table).all()


def test_toxicity_edges(spark, docs, no_docs, invented):
    labels = spark.createDataFrame([(i, y) for i, _, y in invented] + [(0, 1), (1, None), (2, 7), (None, 1), (3, 0), (3, 0), (5, 0)], "doc_id long, toxic int")
    own = spark.createDataFrame([(i, t) for i, t, _ in invented], "doc_id long, text string")
    model = tox.fit(own, labels)
    out = tox.score(docs, model)
    assert set(docs.columns) <= set(out.columns) and out.count() == len(rows())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out.collect())
    assert tox.score(no_docs, model).count() == 0
    same = tox.score(spark.createDataFrame([(None, None), (1, ""), (2, " \n... ")], "doc_id long, text string"), model).collect()
    assert len({r.score for r in same}) == 1
    for none in (labels.limit(0), labels.filter("toxic = 0")):
        assert tox.score(own, tox.fit(own, none)).filter("predicted = 1").count() == 0
    assert tox.score(no_docs, tox.fit(no_docs, labels)).count() == 0


def test_labels_held_out_are_never_learnt(spark, invented):
    own = spark.createDataFrame([(i, t) for i, t, _ in invented], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in invented], "doc_id long, toxic int")
    turned = labels.withColumn("toxic", F.when(tox.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = tox.fit(own, labels), tox.fit(own, turned)
    assert (a.table == b.table).all() and a.bias == b.bias


def test_op13_query(spark):
    got = {r.doc_id: r for r in QUERIES["op13_toxicity"](spark, "/root/testdata/sf0.1").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    assert len(got) == 10_000
    held = [(y, got[i].predicted) for i, y in labels.items() if got[i].held_out]
    assert sum(y and p for y, p in held) >= 0.85 * sum(y for y, _ in held) and sum(p and not y for y, p in held) <= 0.05 * sum(p for _, p in held) + 2
