"""Benchmark decontamination by Wu-Manber search over words.

The test strings are windows: WINDOW consecutive words of an item, or all words of a shorter item. For windows of m words a
shift table, indexed by a hash of two neighbouring words (one word where m is 1), says how far the search may jump from
a position: m - 1 for a pair that no window holds, less for a pair that ends so many words before a window's end. A shift
of 0 means the pair ends some window; then the hash of the whole span picks its bucket, and the span's bytes are
compared with the windows of that bucket. So every reported occurrence is confirmed by its words, and a table slot shared
by two pairs only shortens a jump.

A table is a few arrays over the benchmark's words: one text of all items' words with single spaces, where each window is
a range of bytes; the windows' hashes, sorted; and the items as numbers. It takes about 40 bytes a window.

Texts are searched in blocks of bytes with numpy: word bounds are found for a whole block, and all stretches of the
block advance together, each by its own shift. No text is shuffled. The windows are the query set: items are cut into pieces
of at most PIECE_WORDS words (that overlap, so that no window is lost) and taken in parts of about PART_BYTES, each broadcast
alone; with several parts the hits (narrow rows) are merged by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalfold.llm.arrow import blocks, texts
from evalfold.llm.common import free_name, read, small_batches, staged
from evalfold.llm.words import Words, word_bytes

WINDOW = 10
#: Bytes of the pieces that one broadcast part is to hold, and words of a piece.
PART_BYTES, PIECE_WORDS = 16 << 20, 4096
#: Bytes searched at once, end positions of a stretch, slots of a shift table.
BLOCK_BYTES, STRETCH, SLOTS = 1 << 20, 256, 1 << 20

_A, _B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
_S = np.uint64(29)
#: A word is a run of 0-9, a-z (once lower-cased) and anything beyond ASCII.
WORD = word_bytes(lambda c: 48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123 or c >= 128)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * _B + b
    return ((h ^ (h >> _S)) * _A) >> np.uint64(44)


@dataclass
class Table:
    """The windows of `m` words: shifts by block hash; of each window its hash (in order), bytes in `text`, and item in `items`."""

    m: int
    shift: np.ndarray
    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    item: np.ndarray
    text: bytes
    items: list[str]

    def found(self, hash_: int, span: bytes) -> set[str]:
        """The items that hold this window."""
        a, b = np.searchsorted(self.hashes, np.array([hash_], np.uint64)), np.searchsorted(self.hashes, np.array([hash_], np.uint64), side="right")
        return {self.items[self.item[i]] for i in range(int(a[0]), int(b[0])) if self.text[self.start[i] : self.end[i]] == span}


def build(items: list[tuple[str, str | None]], window: int = WINDOW) -> list[Table]:
    """A table for each window length among the items (item_id as string, text); items without words have no window."""
    names = sorted({i for i, _ in items})
    number = {n: i for i, n in enumerate(names)}
    held = [(t or "").encode() for _, t in items]
    w = Words(np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)]), WORD)
    counts = np.diff(w.first)
    # The same words with single spaces between, and where each starts and ends there.
    length = w.ends - w.starts
    begin = np.cumsum(length + 1) - length - 1
    text = np.full(int((length + 1).sum()), 32, np.uint8)
    inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    text[np.repeat(begin, length) + inside] = w.data[np.repeat(w.starts, length) + inside]
    blob = text.tobytes()
    out = []
    for m in np.unique(np.minimum(counts[counts > 0], window)).tolist():
        own = np.flatnonzero(np.minimum(counts, window) == m)
        n = counts[own] - m + 1
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        last = np.repeat(w.first[own], n) + nth + m - 1
        shift = np.full(SLOTS, max(1, m - 1), dtype=np.int8 if m < 128 else np.int64)
        for back in range(max(1, m - 1)):
            np.minimum.at(shift, block_hash(w, last - back, m).astype(np.int64), back)
        hashes = w.span_hashes(last, m)
        order = np.argsort(hashes, kind="stable")
        last = last[order]
        item = np.repeat(np.array([number[items[i][0]] for i in own.tolist()], np.int32), n)[order]
        out.append(Table(m, shift, hashes[order], begin[last - m + 1], begin[last] + length[last], item, blob, names))
    return out


def block_hash(w: Words, last: np.ndarray, m: int) -> np.ndarray:
    """The slot of the block (two words, or one where windows have one) that ends at each position."""
    own = w.hashes(last)
    return _pair(own, own) if m == 1 else _pair(w.hashes(last - 1), own)


def occurrences(w: Words, t: Table) -> Iterator[tuple[int, set[str]]]:
    """(number of the last word, items) of each window occurrence within a text."""
    first, after = w.first[:-1] + t.m - 1, w.first[1:]
    counts = np.maximum(0, -(-(after - first) // STRETCH))
    if not counts.sum():
        return
    which = np.repeat(np.arange(len(counts)), counts)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = first[which] + nth * STRETCH
    end = np.minimum(at + STRETCH, after[which])
    while len(at):
        shift = t.shift[block_hash(w, at, t.m).astype(np.int64)].astype(np.int64)
        suspects = at[shift == 0]
        if len(suspects):
            hashes = w.span_hashes(suspects, t.m)
            near = np.minimum(np.searchsorted(t.hashes, hashes), len(t.hashes) - 1)
            same = t.hashes[near] == hashes
            for p, h in zip(suspects[same].tolist(), hashes[same].tolist()):
                if items := t.found(h, w.span(p - t.m + 1, p)):
                    yield p, items
        at = at + np.maximum(shift, 1)
        live = at < end
        at, end = at[live], end[live]


def _search(tables: list[Table], data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, list[dict], list[str]]]:
    """Of each text: its words, the spans of words hit (merged, end exclusive), and the items found."""
    w = Words(data, offsets, WORD)
    n = len(offsets) - 1
    spans: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set[str]] = {}
    for t in tables:
        for p, found in occurrences(w, t):
            row = int(np.searchsorted(w.first, p, side="right")) - 1
            spans.setdefault(row, []).append((p - t.m + 1 - int(w.first[row]), p + 1 - int(w.first[row])))
            items.setdefault(row, set()).update(found)
    out = []
    for row in range(n):
        merged: list[dict] = []
        for a, b in sorted(spans.get(row, ())):
            if merged and a <= merged[-1]["end"]:
                merged[-1]["end"] = max(b, merged[-1]["end"])
            else:
                merged.append({"start": a, "end": b})
        out.append((int(w.first[row + 1] - w.first[row]), merged, sorted(items.get(row, ()))))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ADDED = "n_words long, hit_spans array<struct<start:long,end:long>>, hit_items array<string>"


def _pass(docs: DataFrame, items: list[tuple[str, str | None]], window: int) -> DataFrame:
    tables = docs.sparkSession.sparkContext.broadcast(build(items, window))
    names = [f.name for f in docs.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for _, data, offsets in blocks(batch.column("text"), BLOCK_BYTES) for r in _search(tables.value, data, offsets)]
            new = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], _SPANS), pa.array([r[2] for r in rows], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*names, "n_words", "hit_spans", "hit_items"])

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), _ADDED]))


def _pieces(window: int, piece_words: int) -> Callable:
    """Cuts items of more than `piece_words` windows into pieces of as many; neighbours share window - 1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item_id").to_pylist(), texts(batch.column("text"))):
                w = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), WORD)
                n = len(w.starts)
                for i in range(0, max(n - window + 1, 1) if n else 0, piece_words):
                    rows.append((item, i, text[w.starts[i] : w.ends[min(i + piece_words + window - 1, n) - 1]]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()).cast(pa.string())], names=["item_id", "nth", "text"])

    return run


def _parts(benchmark: DataFrame, window: int, part_bytes: int, piece_words: int) -> Iterator[list[tuple[str, str | None]]]:
    """The items' pieces in parts of about `part_bytes`, each read by itself."""
    b = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text")
    b = staged(b.mapInArrow(_pieces(window, piece_words), "item_id string, nth long, text string"), "benchmark-pieces")
    size = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, int(-(-size // part_bytes)))
    for i in range(n):
        own = b if n == 1 else b.filter(F.pmod(F.xxhash64("item_id", "nth"), F.lit(n)) == i)
        table = own.select("item_id", "text").toArrow()
        yield [*zip(table["item_id"].to_pylist(), table["text"].to_pylist())]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES, piece_words: int = PIECE_WORDS) -> DataFrame:
    """`docs` with n_words, n_hit, hit_spans (word numbers, end exclusive), hit_items (sorted strings), contaminated.

    A null or empty text, or one without words, has 0 words and no hit. Items without words hit nothing; a null item_id
    is named 'null'; items that share an id count once. Existing columns of the five new names are replaced. Rows that
    repeat are each reported.
    """
    docs = small_batches(docs).drop("n_words", "n_hit", "hit_spans", "hit_items", "contaminated")
    parts = _parts(benchmark, window, part_bytes, piece_words)
    found = _pass(docs, next(parts), window)
    narrow = docs.select("doc_id", "text")
    hits = [staged(_pass(narrow, x, window).filter(F.size("hit_items") > 0).select("doc_id", F.xxhash64("text").alias("_h"), "hit_spans", "hit_items"), "hits") for x in parts]
    if hits:
        every = reduce(DataFrame.unionByName, hits)
        own, hash_, mine, spans, items = (free_name(docs, x) for x in ("own_id", "own_hash", "text_hash", "more_spans", "more_items"))
        more = every.dropDuplicates().groupBy(F.col("doc_id").alias(own), F.col("_h").alias(hash_)).agg(F.flatten(F.collect_list("hit_spans")).alias(spans), F.array_distinct(F.flatten(F.collect_list("hit_items"))).alias(items))
        found = found.withColumn(mine, F.xxhash64("text")).join(more, F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(mine) == F.col(hash_)), "left")
        found = found.withColumns({
            "hit_spans": F.array_sort(F.concat("hit_spans", F.coalesce(spans, F.array().cast("array<struct<start:bigint,end:bigint>>")))),
            "hit_items": F.array_sort(F.array_distinct(F.concat("hit_items", F.coalesce(items, F.array().cast("array<string>"))))),
        }).drop(own, hash_, mine, spans, items)
    # Spans are sorted by start; those of several parts may overlap.
    n_hit = F.aggregate(
        "hit_spans", F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(a["end"], s["start"]))).alias("n")),
        lambda a: a["n"],
    )
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", F.col("n_hit") > 0)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of all documents against all benchmark items."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, read(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
       FROM b, unnest(range(1, greatest(len(w) - 8, 2))) AS t(i) WHERE len(w) > 0),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS s FROM d, ms, unnest(range(1, len(w) - m + 2)) AS t(i)),
h AS (SELECT doc_id, item_id, dw.m, i FROM dw JOIN bw ON dw.m = bw.m AND dw.s = bw.s),
n AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM h, unnest(range(0, m)) AS t(j) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(x, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id)
"""
