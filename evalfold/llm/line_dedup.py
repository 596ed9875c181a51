"""Line dedup with two Bloom filters, for hashes seen once and seen twice.

1. Texts are split once. The long lines' digests are written with the bit that each sets in the filter of hashes seen once, sorted by
   it inside a task, and aren't shuffled.
2. The filter of hashes seen once is one bit for each hash value below a bound of at least BITS_A_ROW times the rows, so about
   one line in BITS_A_ROW / (long lines of a row) meets another's bit. It is never whole in one place: each task sends its set bits, sorted, as packed
   steps (some two bytes a line), to the CHUNKS or more ranges that the bits lie in. Where a range meets a bit again, the bit was
   seen twice. There are few such bits: those of repeated lines, and of the few that met by chance.
3. They go into filters of bits seen twice: two hashes, TWICE_BITS bits for each. One filter takes as many ranges as fit into `max_bits`, so
   it is small enough to be broadcast however many bits there are: the ranges are swept in turn, and as the written lines are sorted
   by their bits, a sweep reads its own ranges' pages of them. What a filter holds are the suspected repeats. They alone are
   shuffled, as 128-bit digests with their doc_id, to count each line's documents exactly and to choose the one that keeps it; counts are
   pre-aggregated, so a line in a third of all rows is no hot key.
4. Documents are rewritten. Repeated lines up to BROADCAST_BYTES are broadcast as digests; beyond, only the documents
   that lose lines (found by a filter of their ids) are joined with what they lose, and the others pass by.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalfold.llm.arrow import texts, with_columns
from evalfold.llm.bloom import Bloom, may_hold
from evalfold.llm.common import free_name, read, small_batches, staged

WHITE = b"\t\n\x0b\x0c\r "
_CONTINUATION = bytes(range(0x80, 0xC0))
MIN_CHARS, MIN_DOCS = 40, 5
#: Bits of the once filter for each row of the input; least ranges that it is cut into, and rows of the input for each; hashes
#: that a task holds before it sends them, and that a range holds before it merges them.
BITS_A_ROW, CHUNKS, CHUNK_ROWS, FLUSH = 1 << 13, 32, 1 << 14, 2_000_000
#: Bits of a twice filter for each bit seen twice, and at most (beyond that there are more filters).
TWICE_BITS, MAX_BITS = 16, 1 << 28
BROADCAST_BYTES = 64 << 20


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The line stripped of ASCII white space and with A-Z lower-cased, or None if it has under `min_chars` code points."""
    k = line.strip(WHITE)
    if len(k) < min_chars or (len(k) < 4 * min_chars and len(k.translate(None, _CONTINUATION)) < min_chars):
        return None
    return k.lower()


def _keys(text: bytes, min_chars: int) -> set[bytes]:
    found = {line_key(x, min_chars) for x in text.split(b"\n") if len(x) >= min_chars}
    found.discard(None)
    return found


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def long_lines(docs: DataFrame, bits: int, min_chars: int = MIN_CHARS) -> DataFrame:
    """(place, digest, doc_id) of every distinct long line of each row, sorted by place inside a task; place is the line's bit in the
    once filter of `bits` (a power of two)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, digests = [], []
            for i, t in enumerate(texts(batch.column("text"))):
                own = _keys(t, min_chars)
                rows += [i] * len(own)
                digests += map(_digest, own)
            places = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)[:, 0] & (bits - 1)
            ids = batch.column("doc_id").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(digests, pa.binary()), ids], names=["place", "digest", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, "place long, digest binary, doc_id long").sortWithinPartitions("place")


def _pack(places: np.ndarray) -> bytes:
    """Sorted distinct numbers as steps, byte by byte (the upper bytes are nearly all zero)."""
    return zlib.compress(np.ascontiguousarray(np.diff(places, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack(blob: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(zlib.decompress(blob), np.uint8).reshape(8, -1).T).view("<i8")[:, 0])


def _once(bits: int, chunks: int) -> Callable:
    """Rows (chunk, once, twice) of a task: the bits that its lines set once and more than once."""
    width = bits // chunks

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        once, times = np.unique(np.concatenate(held), return_counts=True)
        rows = []
        for c in np.unique(once // width).tolist():
            a, b = np.searchsorted(once, [c * width, (c + 1) * width])
            rows.append((c, _pack(once[a:b] - c * width), _pack(once[a:b][times[a:b] > 1] - c * width)))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["chunk", "once", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(batch.column("place").to_numpy())
            count += batch.num_rows
            if count >= FLUSH:
                yield flush(held)
                held, count = [], 0
        if count:
            yield flush(held)

    return run


def _merge(width: int) -> Callable:
    """The bits (`place`, once each) of each range that were set twice. Rows of a range come together; what is held of it is
    merged whenever FLUSH numbers came."""

    def merged(once: list[np.ndarray], twice: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        every, times = np.unique(np.concatenate(once), return_counts=True)
        return [every], [np.unique(np.concatenate([*twice, every[times > 1]]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, once, twice, count = None, [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(merged(once, twice)[1][0] + chunk * width)], names=["place"])

        for batch in batches:
            for c, o, t in zip(*(batch.column(n).to_pylist() for n in ("chunk", "once", "twice"))):
                if c != chunk and once:
                    yield out()
                    once, twice, count = [], [], 0
                chunk = c
                once.append(_unpack(o))
                twice.append(_unpack(t))
                count += len(once[-1])
                if count >= FLUSH:
                    (once, twice), count = merged(once, twice), 0
        if once:
            yield out()

    return run


def seen_twice(lines: DataFrame, bits: int, chunks: int) -> DataFrame:
    """(place) of the once filter's bits (of `bits`) that lines of two rows set."""
    sent = lines.select("place").mapInArrow(_once(bits, chunks), "chunk long, once binary, twice binary")
    return sent.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_merge(bits // chunks), "place long")


def sweeps(n: int, bits: int, max_bits: int) -> list[tuple[int, int]]:
    """Ranges (first, last) of places, of `n` of which one's share takes a filter of at most `max_bits` bits; hashes spread evenly."""
    groups = min(bits, 1 << max(0, -(-2 * n * TWICE_BITS // max_bits) - 1).bit_length())
    return [(i * (bits // groups), (i + 1) * (bits // groups) - 1) for i in range(groups)]


def suspects(lines: DataFrame, twice: DataFrame, bits: int, max_bits: int = MAX_BITS) -> DataFrame:
    """(digest, doc_id) of the lines (of a written table) whose bit may be in `twice`, one filter of a range of bits after another."""
    found = []
    for first, last in sweeps(twice.count(), bits, max_bits):
        here = F.col("place").between(first, last)
        sent = lines.sparkSession.sparkContext.broadcast(Bloom.of(twice.filter(here), "place", TWICE_BITS, max_bits))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held = batch.filter(pa.array(sent.value.holds(batch.column("place").to_numpy())))
                yield held.select(["digest", "doc_id"])

        found.append(staged(lines.filter(here).mapInArrow(run, "digest binary, doc_id long"), "line-suspects"))
        sent.unpersist()
    return reduce(DataFrame.unionAll, found)


def repeated_lines(found: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """digest, keep_id of the suspects that at least `min_docs` documents (distinct doc_ids) hold; the largest doc_id keeps it."""
    counted = found.groupBy("digest").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keep_id"))
    return counted.filter(F.col("n") >= min_docs).select("digest", "keep_id")


def _rewrite(text: bytes, drops: Callable[[bytes], bool], min_chars: int) -> tuple[int, int, bytes]:
    """Lines, lines dropped, and the text left; `drops` tells by a line's digest."""
    lines = text.split(b"\n")
    kept = [x for x in lines if len(x) < min_chars or (k := line_key(x, min_chars)) is None or not drops(_digest(k))]
    return len(lines), len(lines) - len(kept), text if len(kept) == len(lines) else b"\n".join(kept)


def _out(batch: pa.RecordBatch, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return with_columns(batch, {
        "text": pa.array([r[2] for r in rows], pa.binary()).cast(pa.string()), "n_lines": pa.array([r[0] for r in rows], pa.int64()), "n_dropped": pa.array([r[1] for r in rows], pa.int64()),
        "kept_sha256": pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string()),
    })


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, broadcast_bytes: int = BROADCAST_BYTES, max_bits: int = MAX_BITS) -> DataFrame:
    """`docs` with `text` rewritten, and n_lines, n_dropped, kept_sha256.

    A null or empty text is one empty line and comes back empty. Rows that share a doc_id count as one document; rows
    without doc_id count as none and keep no repeated line. Other columns pass through; columns of the three new names
    are replaced.
    """
    spark = docs.sparkSession
    docs = small_batches(docs).drop("n_lines", "n_dropped", "kept_sha256")
    n = docs.count()
    bits = 1 << min(62, max(20, (n * BITS_A_ROW).bit_length()))
    chunks = 1 << max(CHUNKS, n // CHUNK_ROWS).bit_length() - 1
    every = staged(long_lines(docs, bits, min_chars), "long-lines")
    found = suspects(every, staged(seen_twice(every, bits, chunks), "seen-twice"), bits, max_bits)
    lines = staged(repeated_lines(found, min_docs), "repeated-lines")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "n_lines long, n_dropped long, kept_sha256 string"])
    if lines.count() * 96 <= broadcast_bytes:
        table = lines.toArrow()
        keep = spark.sparkContext.broadcast(dict(zip(table["digest"].to_pylist(), table["keep_id"].to_pylist())))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = keep.value
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                yield _out(batch, [_rewrite(t, lambda k, i=i: held.get(k, i) != i, min_chars) for i, t in zip(ids, texts(batch.column("text")))])

        return docs.mapInArrow(run, schema)

    own, gone, may = (free_name(docs, x) for x in ("own_id", "gone", "may_lose"))
    drops = found.join(lines, "digest").filter(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    drops = staged(drops.groupBy(F.col("doc_id").alias(own)).agg(F.collect_set("digest").alias(gone)), "line-drops")
    held = may_hold(Bloom.of(drops.filter(F.col(own).isNotNull()), own, TWICE_BITS, max_bits), docs, "doc_id")

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [frozenset(x or ()) for x in batch.column(gone).to_pylist()]
            rows = [_rewrite(t, s.__contains__, min_chars) for s, t in zip(sets, texts(batch.column("text")))]
            yield _out(batch.drop_columns([gone]), rows)

    marked = docs.withColumn(may, held)
    joined = marked.filter(may).drop(may).join(drops, F.col("doc_id").eqNullSafe(F.col(own)), "left").drop(own)
    others = marked.filter(~F.col(may)).drop(may).withColumn(gone, F.lit(None).cast("array<binary>"))
    return joined.unionByName(others).mapInArrow(run_joined, schema)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of all documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, generate_subscripts(lines, 1) AS i, unnest(lines) AS line FROM d),
k AS (SELECT doc_id, i, line,
             translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keep_id FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.i, k.line, r.key IS NOT NULL AND k.doc_id <> r.keep_id AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
