"""Fill-in-the-middle transformation with a table-driven automaton over UTF-8 bytes.

One table of STATES x CLASSES says, for each byte, the next state and what the transition counts: a code point that starts, a
unit that starts (a run of A-Z and a-z, or one other code point), a sentinel that ends. Continuation bytes count nothing.

The automaton forgets: whatever state it was in, MEMORY bytes later it is in a state that these bytes alone decide. So
the states before all bytes of a chunk come from MEMORY whole-array steps from any guess, the first byte's state being known.

The first pass walks the chunks (CHUNK bytes each, a text may span many) and keeps counts only: units, code points and
sentinels up to each text's end and each chunk's start. With them the cuts are drawn as numbers of units. The second pass
walks again only the chunks that hold a cut, and finds its byte. What a task holds besides its batch is one chunk's arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalfold.llm.arrow import texts, with_columns
from evalfold.llm.common import read, small_batches

#: Seed of the draws, share (of 100) of rows that are transformed, share of those that start with the suffix.
SEED, TRANSFORMED, SUFFIX_FIRST = "1", 90, 20
CHUNK, BLOCK_BYTES = 1 << 20, 1 << 20
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

#: Kinds of bytes. END (0xff, never in UTF-8) stands between texts.
OTHER, LETTER, NAME, OPEN, CLOSE, CONTINUATION, LEAD, END, CLASSES = range(9)
#: After another code point (or at the start), inside letters, after `<`, after `<` and one letter that names a sentinel.
BETWEEN, INSIDE, OPENED, NAMED, STATES = range(5)
POINT, UNIT, SENTINEL = 1, 2, 4


def _byte_class(c: int) -> int:
    if chr(c) in "PSM":
        return NAME
    if 65 <= c < 91 or 97 <= c < 123:
        return LETTER
    return {60: OPEN, 62: CLOSE, 255: END}.get(c, OTHER if c < 128 else CONTINUATION if c < 192 else LEAD)


def _next(state: int, kind: int) -> int:
    if kind == NAME and state == OPENED:
        return NAMED
    return INSIDE if kind in (LETTER, NAME) else OPENED if kind == OPEN else BETWEEN


def _counts(state: int, kind: int) -> int:
    if kind in (CONTINUATION, END):
        return 0
    starts = kind not in (LETTER, NAME) or state not in (INSIDE, NAMED)
    return POINT | UNIT * starts | SENTINEL * (state == NAMED and kind == CLOSE)


CLASS = np.array([_byte_class(c) for c in range(256)], dtype=np.uint8)
NEXT = np.array([_next(s, c) for s in range(STATES) for c in range(CLASSES)], dtype=np.uint8)
COUNTS = np.array([_counts(s, c) for s in range(STATES) for c in range(CLASSES)], dtype=np.uint8)


def _memory() -> int:
    """After how many bytes the state no longer depends on where the automaton started."""
    reached, k = {tuple(range(STATES))}, 0
    while any(len(set(r)) > 1 for r in reached):
        reached, k = {tuple(int(NEXT[s * CLASSES + c]) for s in r) for r in reached for c in range(CLASSES)}, k + 1
    return k


MEMORY = _memory()


def walk(data: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """What each byte's transition counts, from `state` on, and the state after the last byte."""
    kinds = CLASS[data]
    before = np.full(len(data), state, dtype=np.uint8)
    for _ in range(MEMORY):
        before[1:] = NEXT[before[:-1] * np.uint8(CLASSES) + kinds[:-1]]
    at = before * np.uint8(CLASSES) + kinds
    return COUNTS[at], int(NEXT[at[-1]])


class Units:
    """Units, code points and sentinels of a run of texts (bytes), and where units start."""

    def __init__(self, rows: list[bytes]) -> None:
        self.data = np.frombuffer(b"\xff".join([*rows, b""]), dtype=np.uint8)
        lengths = np.array([len(r) for r in rows], dtype=np.int64)
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        self.states, self.before = [], [np.zeros(2, np.int64)]
        at_ends, state, found = [], BETWEEN, []
        for first in range(0, len(self.data), CHUNK):
            counts, after = walk(self.data[first : first + CHUNK], state)
            self.states.append(state)
            state = after
            ends = self.ends[np.searchsorted(self.ends, first) : np.searchsorted(self.ends, first + CHUNK)] - first
            sums = np.stack([np.cumsum((counts & flag) > 0, dtype=np.int64) for flag in (UNIT, POINT)])
            at_ends.append(self.before[-1][:, None] + sums[:, ends])
            self.before.append(self.before[-1] + sums[:, -1])
            found.append(np.flatnonzero(counts & SENTINEL) + first)
        upto = np.concatenate(at_ends, axis=1) if at_ends else np.zeros((2, 0), np.int64)
        self.first_unit, self.first_point = np.concatenate([[[0], [0]], upto[:, :-1]], axis=1) if len(rows) else upto
        self.units, self.points = upto[0] - self.first_unit, upto[1] - self.first_point
        sentinels = np.concatenate(found) if found else np.zeros(0, np.int64)
        self.has_sentinel = np.searchsorted(sentinels, self.ends) > np.searchsorted(sentinels, self.starts)

    def locate(self, row: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the unit with this number (from 0; the number of all units stands for the end) of each text: its first byte and
        first code point, counted in the text."""
        byte, point = (self.ends - self.starts)[row], self.points[row].copy()
        inner = np.flatnonzero(unit < self.units[row])
        wanted = self.first_unit[row[inner]] + unit[inner]
        chunk = np.searchsorted(np.array([b[0] for b in self.before]), wanted, side="right") - 1
        for c in np.unique(chunk).tolist():
            counts, _ = walk(self.data[c * CHUNK : (c + 1) * CHUNK], self.states[c])
            at = np.flatnonzero(counts & UNIT)
            here = chunk == c
            got = at[wanted[here] - self.before[c][0]]
            byte[inner[here]] = got + c * CHUNK - self.starts[row[inner[here]]]
            point[inner[here]] = np.cumsum(counts & POINT, dtype=np.int64)[got] - 1 + self.before[c][1] - self.first_point[row[inner[here]]]
        return byte, point


def draws(seed: str, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits for a row."""
    text = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(text[i : i + 8], 16) for i in (0, 8, 16, 24))


def _transform(rows: list[bytes], ids: list[int | None], seed: str, transformed: int, suffix_first: int) -> list[tuple]:
    """(units, form, code points of prefix and middle, output) of each text."""
    u = Units(rows)
    h = [draws(seed, i) for i in ids]
    units = u.units.tolist()
    plain = [not rows[r] or bool(u.has_sentinel[r]) or h[r][2] % 100 >= transformed for r in range(len(rows))]
    cut = np.array([sorted((x[0] % (n + 1), x[1] % (n + 1))) for x, n in zip(h, units)], dtype=np.int64).reshape(-1, 2)
    chosen = np.flatnonzero(~np.array(plain, dtype=bool))
    (b1, p1), (b2, p2) = (u.locate(chosen, cut[chosen, j]) for j in (0, 1))
    out = [(n, "plain", None, None, t) for n, t in zip(units, rows)]
    for r, i, j, p, q in zip(chosen.tolist(), b1.tolist(), b2.tolist(), p1.tolist(), p2.tolist()):
        t = rows[r]
        spm = h[r][3] % 100 < suffix_first
        parts = (SUFFIX, t[j:], PREFIX, t[:i], MIDDLE, t[i:j]) if spm else (PREFIX, t[:i], SUFFIX, t[j:], MIDDLE, t[i:j])
        out[r] = (units[r], "spm" if spm else "psm", p, q - p, b"".join(parts))
    return out


NEW = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}


def fill_in_middle(docs: DataFrame, seed: str = SEED, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """`docs` with n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain) and output.

    A null text counts as empty; an empty text, and one that holds a sentinel, stays plain. Rows that repeat a doc_id share
    its draws; rows without doc_id share those of an empty one. Columns of the five names are replaced, others pass through.
    Texts of any length are walked in chunks. No shuffle.
    """
    docs = small_batches(docs).drop(*NEW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids, out = texts(batch.column("text")), batch.column("doc_id").to_pylist(), []
            while len(out) < len(rows):
                first, size = len(out), 0
                last = first
                while last < len(rows) and (last == first or size + len(rows[last]) <= BLOCK_BYTES):
                    size += len(rows[last])
                    last += 1
                out += _transform(rows[first:last], ids[first:last], seed, transformed, suffix_first)
            columns = list(zip(*out)) or [()] * len(NEW)
            new = {name: pa.array(c, pa.binary()).cast(kind) if name == "output" else pa.array(c, kind) for (name, kind), c in zip(NEW.items(), columns)}
            yield with_columns(batch, new)

    kinds = "n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), kinds]))


def restored(output: Column, form: Column) -> Column:
    """The text that `output` was made of. No part holds a sentinel, and none arises where parts meet, so the first of each is
    the mark."""
    body = F.split(F.substring(output, 4, 2**31 - 1), MIDDLE.decode(), 2)
    psm, spm = (F.split(body[0], s.decode(), 2) for s in (SUFFIX, PREFIX))
    return F.when(form == "psm", F.concat(psm[0], body[1], psm[1])).when(form == "spm", F.concat(spm[1], body[1], spm[0])).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, transformed; digests of the output and of the text rebuilt from it."""
    out = fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS s FROM documents),
h AS (SELECT *, len(u) AS n, ('0x' || substr(s, 1, 8))::BIGINT AS h1, ('0x' || substr(s, 9, 8))::BIGINT AS h2, ('0x' || substr(s, 17, 8))::BIGINT AS h3, ('0x' || substr(s, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
