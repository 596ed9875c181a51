from __future__ import annotations

import hashlib
import random

import pytest

from evalfold.llm.decontaminate import find_contamination
from evalfold.llm.line_dedup import dedup_lines, line_key

from . import brute
from .conftest import rows


@pytest.mark.parametrize("limits", [{}, {"broadcast_bytes": 0}, {"max_bits": 1 << 16}, {"min_docs": 2, "min_chars": 1}])
def test_lines_equal_brute_force(docs, limits):
    want = brute.lines([(i, t) for i, t, *_ in rows()], **{k: v for k, v in limits.items() if k.startswith("min")})
    got = dedup_lines(docs, **limits).toPandas()
    assert len(got) == len(rows()) and set(docs.columns) <= set(got.columns)
    for r in got.itertuples():
        n, dropped, text = want[r.doc_id]
        assert (r.n_lines, r.n_dropped, r.text, r.kept_sha256) == (n, dropped, text, hashlib.sha256(text.encode()).hexdigest())


def test_lines_without_ids_and_empty_table(spark, no_docs):
    line = "x" * 50
    got = dedup_lines(spark.createDataFrame([(None, line), *((i, line) for i in range(5))], "doc_id long, text string")).toPandas()
    assert got.sort_values("doc_id").n_dropped.tolist() == [1, 1, 1, 1, 0, 1]
    assert dedup_lines(no_docs).count() == 0


def test_random_lines_through_many_ranges(spark, monkeypatch):
    from evalfold.llm import line_dedup as D

    monkeypatch.setattr(D, "FLUSH", 50)
    monkeypatch.setattr(D, "CHUNK_ROWS", 2)
    r = random.Random(11)
    line = lambda: f"a line of number {int(r.expovariate(0.02)):>30}"
    rows_ = [(i, "\n".join(line() for _ in range(r.randrange(0, 9)))) for i in range(400)]
    want = brute.lines(rows_)
    for limits in ({}, {"broadcast_bytes": 0}):
        got = D.dedup_lines(spark.createDataFrame(rows_, "doc_id long, text string").repartition(5), **limits).collect()
        assert {x.doc_id: (x.n_lines, x.n_dropped, x.text) for x in got} == want
    assert sum(dropped for _, dropped, _ in want.values()) > 100


def test_only_repeats_are_suspects(spark):
    from pyspark.sql import functions as F

    from evalfold.llm import line_dedup as D

    n = 20_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws("\n", *(F.concat(F.lit(f"line {k} of the document of number "), F.lpad(F.col("id").cast("string"), 12, "0")) for k in range(4)), F.when(F.col("id") % 100 == 0, "a line that one document in a hundred holds")).alias("text"))
    bits = 1 << (n * D.BITS_A_ROW).bit_length()
    lines = D.long_lines(docs, bits)
    found = D.suspects(lines, D.seen_twice(lines, bits, 32), bits)
    repeats, every = n // 100, 4 * n + n // 100
    assert repeats <= found.count() < repeats + 0.01 * every


def test_many_repeats_take_more_filters_not_fuller_ones(spark):
    from pyspark.sql import functions as F

    from evalfold.llm import line_dedup as D

    n = 12_000  # 6,000 lines that two rows hold, 36,000 that one holds, and filters of 2**15 bits
    text = F.concat_ws("\n", F.concat(F.lit("this line is held by two documents of the table "), (F.col("id") / 2).cast("long")), *(F.concat(F.lit(f"line {k} that only one document of the table holds "), "id") for k in range(3)))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"))
    bits = 1 << (n * D.BITS_A_ROW).bit_length()
    lines = D.staged(D.long_lines(docs, bits), "lines")
    twice = D.staged(D.seen_twice(lines, bits, 32), "twice")
    ranges = D.sweeps(twice.count(), bits, 1 << 15)
    assert len(ranges) == 8 and ranges[0][0] == 0 and ranges[-1][1] == bits - 1 and all(a[1] + 1 == b[0] for a, b in zip(ranges, ranges[1:]))
    found = D.suspects(lines, twice, bits, 1 << 15)
    assert n <= found.count() < n + 0.1 * 3 * n
    assert D.repeated_lines(found, 2).count() == n // 2


def test_filter_holds_what_it_was_made_of(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from evalfold.llm.bloom import Bloom, xxhash64

    values = spark.range(3000).select((F.col("id") * 7919 - 4_000_000).alias("x"), F.xxhash64(F.col("id") * 7919 - 4_000_000, F.lit(2)).alias("h")).toPandas()
    assert (xxhash64(values.x.to_numpy(), 2).view(np.int64) == values.h.to_numpy()).all()
    made = Bloom.of(spark.createDataFrame(values[["x"]]), "x", 16, 1 << 28)
    others = np.arange(10**7, 10**7 + 50_000)
    assert made.holds(values.x.to_numpy()).all() and made.holds(others).mean() < 0.03
    assert not Bloom.of(spark.createDataFrame([], "x long"), "x", 16, 1 << 20).holds(others).any()


@pytest.mark.parametrize("broadcast_numbers", [100, 0])
def test_rows_without_what_is_gone(spark, docs, broadcast_numbers):
    from evalfold.llm.bloom import without

    left = without(docs, spark.createDataFrame([(6,), (9,), (10**12,)], "doc_id long"), "doc_id", broadcast_numbers)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.select("doc_id").collect()) == sorted(i for i, *_ in rows() if i not in (6, 9))
    nulls = spark.createDataFrame([(None, "a"), (1, "b")], "doc_id long, text string")
    assert [r.text for r in without(nulls, spark.createDataFrame([(1,), (None,)], "doc_id long"), "doc_id", broadcast_numbers).collect()] == ["a"]


def test_line_keys():
    assert line_key("é".encode() * 39) is None and line_key("é".encode() * 40) == "é".encode() * 40
    assert line_key(b"\x0b " + b"AbC" * 20 + b"\t\r") == b"abc" * 20 and line_key("É".encode() * 40) == "É".encode() * 40


ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, "Two, words!"), (3, "one"), (4, None), (5, "..."), (6, " ".join(f"w{i}" for i in range(40))), (7, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (10, "größe 日本語")]


@pytest.mark.parametrize("limits", [{}, {"part_bytes": 60}, {"part_bytes": 60, "piece_words": 3}])
def test_contamination_equals_brute_force(spark, docs, limits):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = find_contamination(docs, items, **limits).toPandas()
    text = {i: t for i, t, *_ in rows()}
    assert len(got) == len(rows())
    for r in got.itertuples():
        n, hit, found = brute.contamination(text[r.doc_id], ITEMS)
        assert (r.n_words, r.n_hit, list(r.hit_items), r.contaminated) == (n, hit, found, hit > 0)


def test_contamination_of_random_texts(spark):
    r = random.Random(4)
    vocabulary = "a b c d ä e, F! g".split()
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.randrange(0, 9))) for i in range(30)]
    rows_ = [(i, text(r.randrange(0, 700))) for i in range(60)]
    got = find_contamination(spark.createDataFrame(rows_, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=4).toPandas()
    for row in got.itertuples():
        assert (row.n_words, row.n_hit, list(row.hit_items)) == brute.contamination(rows_[row.doc_id][1], items, 4)


def test_a_part_is_small_in_memory():
    import pickle
    import tracemalloc

    import numpy as np

    from evalfold.llm.decontaminate import build

    r = np.random.default_rng(2)
    items = [(str(i), " ".join(f"w{x}" for x in r.integers(0, 40_000, 1000))) for i in range(300)]
    tracemalloc.start()
    tables = build(items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    windows = 300 * 991
    assert len(pickle.dumps(tables)) < 45 * windows + 4 * (1 << 20) and peak < 250 * windows + (16 << 20)
    assert tables[0].found(int(tables[0].hashes[0]), tables[0].text[tables[0].start[0] : tables[0].end[0]]) == {tables[0].items[tables[0].item[0]]}


def test_nothing_to_search(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_contamination(docs, none).filter("contaminated OR n_hit > 0").count() == 0
    assert find_contamination(no_docs, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
