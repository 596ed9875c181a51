"""Periodic runs of words by the linear tandem-repeat method of Gusfield and Stoye, on whole arrays.

1. Lempel-Ziv blocks of the sequence. Every kind of square (a stretch twice in a row) has its leftmost occurrence in a stretch
   that touches the end of a block with a period no longer than that block, or starts in one and ends in the next; so one comparison
   forward and one backward for each block and period finds a covering set of stretches (start, end, period).
2. Each stretch's first square is located in the suffix tree, and the walk along suffix links (leaf p to leaf p + 1) goes on to
   the squares beside it, as long as the stretch lasts. The nodes met, each taken once, are the complete vocabulary of squares
   (of the least period: a multiple of it gives the same stretch).
3. The leaves below a node are all occurrences of its square. Neighbouring ones of one period merge into runs.

Before that, a filter that loses nothing: a run of at least max(24, 3 q) words with period q repeats at least 16 words at
distance q, so a text without a repeated stretch of 16 words (by hash) has no run. The suffix trees take the other texts,
many short ones in one sequence or a long one alone; a task holds two numbers for each word of one sequence and each power of two below
its length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalfold.llm.arrow import texts, with_columns
from evalfold.llm.common import read, small_batches
from evalfold.llm.suffixes import Suffixes, expand
from evalfold.llm.words import mix

#: Least words of a run, least number of periods, and words that every such run repeats at the distance of its period.
MIN_WORDS, MIN_PERIODS = 24, 3
#: Words of one sequence (a longer text is one by itself).
SEQUENCE_WORDS = 1 << 17


def repeats(numbers: np.ndarray, texts_: np.ndarray, width: int) -> np.ndarray:
    """Of each text (words lie in a row; `texts_` says where each starts, and the end), whether any `width` words (a power of two) occur twice."""
    sizes = np.diff(texts_)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    with np.errstate(over="ignore"):
        h, step = mix(numbers.astype(np.uint64) + np.uint64(1)), 1
        while step < width:
            h = mix(h[: max(0, len(h) - step)] * np.uint64(0x9E3779B97F4A7C15) + h[step:])
            step *= 2
    own = owner[: len(h)]
    whole = own == owner[width - 1 : width - 1 + len(h)]
    keys = np.sort(mix(h[whole] + own[whole].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
    twice = np.unique(keys[1:][keys[1:] == keys[:-1]])
    out = np.zeros(len(sizes), dtype=bool)
    if len(twice):
        h, own = mix(h[whole] + own[whole].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), own[whole]
        at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
        out[own[twice[at] == h]] = True
    return out


def _shortest(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of equal stretches the one of the least period."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), dtype=bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[first], end[first], period[first]


def covering(tree: Suffixes, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches (start, end, least period), of two periods or more, that cover the leftmost occurrence of every kind of square."""
    starts = np.append(tree.blocks(), len(numbers))
    sizes = np.append(np.diff(starts), 0)
    found = []
    # Across the end of a block, back by no more than its size.
    period, owner = expand(np.ones(len(sizes) - 2, np.int64), sizes[:-2])
    found.append((starts[owner + 1] - period, starts[owner + 1], period))
    # From a block's start on, by no more than its size and the next one's.
    period, owner = expand(np.ones(len(sizes) - 1, np.int64), sizes[:-1] + sizes[1:])
    found.append((starts[owner], starts[owner] + period, period))
    a, b, period = (np.concatenate(x) for x in zip(*found))
    able = (b < len(numbers)) & (a > 0)
    a, b, period = a[able], b[able], period[able]
    same = numbers[a] == numbers[b]
    a, b, period = a[same], b[same], period[same]
    ahead, back = tree.forward(a, b), tree.backward(a - 1, b - 1)
    square = ahead + back >= period
    return _shortest((a - back)[square], (b + ahead)[square], period[square])


def vocabulary(tree: Suffixes, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First rank, last rank and period of the node of every kind of square in these stretches, each once."""
    place, owner = expand(start, end - start - 2 * period + 1)
    low, high = tree.node(tree.rank[place], 2 * period[owner])
    key, at = np.unique(low * (len(tree.rank) + 1) + period[owner], return_index=True)
    return low[at], high[at], period[owner[at]]


def runs(numbers: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and least period of all runs of at least max(min_words, min_periods * period) numbers; min_periods is 2 or more.

    Separators must occur once each, at the start and the end at least.
    """
    tree = Suffixes(numbers)
    low, high, period = vocabulary(tree, *covering(tree, numbers))
    rank, owner = expand(low, high - low + 1)
    n = len(numbers)
    key = np.unique(period[owner] * n + tree.order[rank])  # every square: by period, then place
    if not len(key):
        return key, key, key
    first = np.concatenate([[True], (key[1:] != key[:-1] + 1) | (key[1:] % n == 0)])
    last = np.append(np.flatnonzero(first)[1:], len(key)) - 1
    period, start = key[first] // n, key[first] % n
    start, end, period = _shortest(start, key[last] % n + 2 * period, period)
    long = end - start >= np.maximum(min_words, min_periods * period)
    return start[long], (end - start)[long], period[long]


def runs_of(rows: list[np.ndarray], min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[list[tuple[int, int, int]]]:
    """(start, length, period), in order, of every run of each text's numbers."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in rows]
    if not rows:
        return out
    sizes = np.array([len(r) for r in rows])
    # Every run repeats this many words at least at the distance of its period.
    shared = min(max(min_words - q, (min_periods - 1) * q) for q in range(1, min_words + 1))
    width = 1 << (max(1, shared).bit_length() - 1)
    chosen = np.flatnonzero(repeats(np.concatenate(rows), np.concatenate([[0], np.cumsum(sizes)]), width)).tolist()
    while chosen:
        held, size = [], 0
        while chosen and (not held or size + sizes[chosen[0]] <= SEQUENCE_WORDS):
            size += sizes[chosen[0]]
            held.append(chosen.pop(0))
        parts = [np.array([-1])]
        for k, r in enumerate(held):
            parts += [rows[r], np.array([-2 - k])]
        at = np.cumsum([1, *(sizes[r] + 1 for r in held)])
        for s, length, p in sorted(zip(*(x.tolist() for x in runs(np.concatenate(parts), min_words, min_periods))), key=lambda r: (r[0], r[2])):
            k = int(np.searchsorted(at, s, side="right")) - 1
            out[held[k]].append((s - int(at[k]), length, p))
    return out


def collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words but those that a run holds after its first period, with single spaces between."""
    if found:
        keep = np.zeros(len(words) + 1, np.int64)
        for start, length, period in found:
            keep[start + period] += 1
            keep[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(keep[:-1]) == 0).tolist()]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """`docs` with runs (start, length, period; by start, then period), longest (the run of the greatest exact length / period; of
    equal ones the first, then that of the shorter period; null without runs) and collapsed (the text without repeats).

    Words are runs of anything but ASCII white space. `rewrite` may change a row's words first, by its doc_id. A null text has
    no words. Rows are judged each for itself, so rows may repeat and doc_id may be null. Columns of the three names are
    replaced, others pass through. No shuffle.
    """
    docs = small_batches(docs).drop("runs", "longest", "collapsed")
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [t.split() for t in texts(batch.column("text"))]  # bytes are split at ASCII white space only
            if rewrite is not None:
                rows = [rewrite(i, w) for i, w in zip(batch.column("doc_id").to_pylist(), rows)]
            names: dict[bytes, int] = {}
            found = runs_of([np.fromiter(map(names.setdefault, w, count(len(names))), np.int64, len(w)) for w in rows], min_words, min_periods)
            struct = lambda r: dict(zip(("start", "length", "period"), r))
            best = [max(f, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if f else None for f in found]
            yield with_columns(batch, {
                "runs": pa.array([[struct(r) for r in f] for f in found], pa.list_(kind)), "longest": pa.array([r and struct(r) for r in best], kind),
                "collapsed": pa.array([collapse(w, f) for w, f in zip(rows, found)], pa.binary()).cast(pa.string()),
            })

    struct = "struct<start: bigint, length: bigint, period: bigint>"
    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"runs array<{struct}>, longest {struct}, collapsed string"]))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the query: every tenth document (by a hash of its doc_id) is periodic from some word on."""
    n, h = len(words), crc32(b"" if doc_id is None else b"%d" % doc_id)
    if not n or h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with the words of `planted`."""
    found = periodic_runs(read(spark, sf_dir, "documents").select("doc_id", "text"), rewrite=planted)
    x = F.col("longest")
    listed = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), x["start"].alias("start"), x["length"].alias("length"), x["period"].alias("period"), F.expr("1000 * longest.length div longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
