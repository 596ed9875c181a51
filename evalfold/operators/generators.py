"""Replays of logged random draws: many Mersenne Twisters as rows of one array, advanced together.

A stream is a seed and its draws in order; after every so many draws its state was stored. Draws between two stored states are a
segment, which is checked for itself: from the state before it (the seed's for the first) its draws are made again and compared, and
so is the state after it. So a stream of any length is spread over tasks, and what is wrong is named by its segment and draw.

Draws and states are exchanged once, in blocks of a stream's segments; a block's last state goes to the next block too. A task walks
through its sorted blocks and holds those of one Arrow batch.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalfold.operators.pareto import segments

# Sizes, masks and multipliers of MT19937, the size of a sample up to which a pool is kept, and the draws of a block.
WORDS, MIDDLE, TOP, REST, TWIST = 624, 397, 0x80000000, 0x7FFFFFFF, 0x9908B0DF
FIRST, LINEAR, BY_KEY, BY_PLACE = 19650218, 1812433253, 1664525, 1566083941
POOL, BLOCK = 21, 256
OPERATIONS = ("randint", "choice", "sample", "shuffle")
_u = np.uint32


class Twisters:
    """One generator a row: `words` (streams x 624) and `place`, as the standard library's states hold them."""

    def __init__(self, words: np.ndarray, place: np.ndarray) -> None:
        self.words, self.place = words.astype(_u), place.astype(np.int64)

    @staticmethod
    def seeded(seeds: np.ndarray) -> Twisters:
        """From whole numbers below 2**63; a negative one seeds as its absolute value."""
        seeds = np.abs(seeds.astype(np.int64)).astype(np.uint64)
        start = np.empty(WORDS, dtype=_u)
        x = FIRST
        for i in range(WORDS):
            start[i] = x
            x = (LINEAR * (x ^ (x >> 30)) + i + 1) & 0xFFFFFFFF
        words = np.repeat(start[:, None], len(seeds), axis=1)  # one row for each place
        low, high = (seeds & np.uint64(0xFFFFFFFF)).astype(_u), (seeds >> np.uint64(32)).astype(_u)
        with np.errstate(over="ignore"):
            for own, key in ((np.flatnonzero(high == 0), [low]), (np.flatnonzero(high), [low, high])):
                m, at = words[:, own], 1
                for step in range(WORDS + WORDS - 1):
                    before = m[at - 1]
                    mixed = before ^ (before >> _u(30))
                    if step < WORDS:
                        m[at] = (m[at] ^ (mixed * _u(BY_KEY))) + key[step % len(key)][own] + _u(step % len(key))
                    else:
                        m[at] = (m[at] ^ (mixed * _u(BY_PLACE))) - _u(at)
                    at += 1
                    if at == WORDS:
                        m[0], at = m[WORDS - 1], 1
                m[0] = TOP
                words[:, own] = m
        return Twisters(np.ascontiguousarray(words.T), np.full(len(seeds), WORDS))

    def _turn(self, rows: np.ndarray) -> None:
        m = self.words[rows]

        def part(first: int, last: int, other: int) -> None:
            y = (m[:, first:last] & _u(TOP)) | (m[:, first + 1 : last + 1] & _u(REST))
            m[:, first:last] = m[:, other : other + last - first] ^ (y >> _u(1)) ^ ((y & _u(1)) * _u(TWIST))

        gap = WORDS - MIDDLE
        part(0, gap, MIDDLE)
        part(gap, 2 * gap, 0)
        part(2 * gap, WORDS - 1, gap)
        y = (m[:, -1] & _u(TOP)) | (m[:, 0] & _u(REST))
        m[:, -1] = m[:, MIDDLE - 1] ^ (y >> _u(1)) ^ ((y & _u(1)) * _u(TWIST))
        self.words[rows], self.place[rows] = m, 0

    def next(self, rows: np.ndarray) -> np.ndarray:
        """32 bits of each of these (distinct) streams."""
        used = rows[self.place[rows] >= WORDS]
        if len(used):
            self._turn(used)
        y = self.words[rows, self.place[rows]]
        self.place[rows] += 1
        y = y ^ (y >> _u(11))
        y = y ^ ((y << _u(7)) & _u(0x9D2C5680))
        y = y ^ ((y << _u(15)) & _u(0xEFC60000))
        return y ^ (y >> _u(18))

    def below(self, rows: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A number from 0 to n - 1 (n from 1 to 2**32 - 1) of each stream; draws that are too large are thrown away."""
        out, bits = np.zeros(len(rows), np.int64), np.frexp(n.astype(float))[1].astype(np.int64)  # the bit length
        open_ = np.arange(len(rows))
        while len(open_):
            got = self.next(rows[open_]).astype(np.int64) >> (32 - bits[open_])
            good = got < n[open_]
            out[open_[good]] = got[good]
            open_ = open_[~good]
        return out

    def shuffled(self, rows: np.ndarray, n: np.ndarray) -> list[list[int]]:
        """The places 0..n-1 of each stream in shuffled order."""
        table = np.tile(np.arange(int(n.max(initial=0))), (len(rows), 1))
        for i in range(table.shape[1] - 1, 0, -1):
            own = np.flatnonzero(n > i)
            j = self.below(rows[own], np.full(len(own), i + 1))
            table[own, i], table[own, j] = table[own, j], table[own, i].copy()
        return [t[:k].tolist() for t, k in zip(table, n.tolist())]

    def sampled(self, rows: np.ndarray, n: np.ndarray, k: np.ndarray) -> list[list[int]]:
        """k different places of 0..n-1 of each stream, in order of draw; small populations from a pool, large ones by rejection."""
        sizes, at = np.unique(k, return_inverse=True)
        limit = np.array([POOL + (4 ** math.ceil(math.log(x * 3, 4)) if x > 5 else 0) for x in sizes.tolist()], dtype=np.int64)[at]
        out = np.full((len(rows), int(k.max(initial=0))), -1, np.int64)
        pooled = n <= limit
        pool = np.tile(np.arange(int(n[pooled].max(initial=1))), (len(rows), 1))
        for i in range(out.shape[1]):
            own = np.flatnonzero(pooled & (k > i))
            j = self.below(rows[own], n[own] - i)
            out[own, i] = pool[own, j]
            pool[own, j] = pool[own, n[own] - i - 1]
            own = np.flatnonzero(~pooled & (k > i))
            while len(own):
                j = self.below(rows[own], n[own])
                new = ~(out[own, :i] == j[:, None]).any(1)
                out[own[new], i] = j[new]
                own = own[~new]
        return [t[:x].tolist() for t, x in zip(out, k.tolist())]

    def draw(self, rows: np.ndarray, operation: str, a: np.ndarray, b: np.ndarray) -> list[list[int]]:
        """randint: one of a..b; choice: a place below a; sample: b places below a; shuffle: the places below a."""
        if operation == "randint":
            return [[x] for x in (a + self.below(rows, b - a + 1)).tolist()]
        if operation == "choice":
            return [[x] for x in self.below(rows, a).tolist()]
        return self.sampled(rows, a, b) if operation == "sample" else self.shuffled(rows, a)


def _possible(operation: np.ndarray, a: np.ndarray, b: np.ndarray, has_a: np.ndarray, has_b: np.ndarray) -> np.ndarray:
    """Of each draw, whether its operation (a place in OPERATIONS) is known and takes these arguments."""
    with np.errstate(over="ignore"):
        randint = has_b & (b >= a) & (b - a >= 0) & (b - a < 2**32 - 1)
    sample, shuffle = has_b & (0 <= b) & (b <= a) & (a < 2**32), (0 <= a) & (a < 2**31)
    return has_a & np.select([operation == i for i in range(4)], [randint, (0 < a) & (a < 2**32), sample, shuffle], False)


def _numbers(column: pa.Array, none: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers (`none` for a null), and which aren't null."""
    return pc.fill_null(column, none).to_numpy(zero_copy_only=False).astype(np.int64), pc.is_valid(column).to_numpy(zero_copy_only=False)


def _states(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """States as rows of 625 numbers, and which are states at all. Arrays of numbers, or their 4 bytes each, lowest first."""
    binary = pa.types.is_binary(column.type)
    whole = pc.fill_null(pc.equal(pc.binary_length(column) if binary else pc.list_value_length(column), (WORDS + 1) * (4 if binary else 1)), False)
    good, out = whole.to_numpy(zero_copy_only=False).copy(), np.zeros((len(column), WORDS + 1), _u)
    if good.any():
        own = column.filter(whole)
        if binary:
            out[good] = np.frombuffer(b"".join(own.to_pylist()), "<u4").reshape(-1, WORDS + 1)
        else:
            values = _numbers(own.flatten())[0].reshape(-1, WORDS + 1)
            fits = ((values >= 0) & (values < 2**32)).all(1)
            at = np.flatnonzero(good)
            out[at[fits]], good[at[~fits]] = values[fits].astype(_u), False
    return out, good & (out[:, -1] <= WORDS)


def _replayed(rows: pa.RecordBatch, every: int) -> pa.RecordBatch:
    """(stream, segment, problem, ordinal): the first problem of each segment of these blocks, sorted and whole, if it has one."""
    cuts = np.array(segments(rows, ["stream", "block", "segment"], None)[0])
    first, n = cuts[:-1], len(cuts) - 1
    of = np.repeat(np.arange(n), np.diff(cuts))
    segment, named = (x[first] for x in _numbers(rows.column("segment")))
    drawn, stored = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("drawn", "stored"))
    d, s = np.flatnonzero(drawn), np.flatnonzero(stored)
    count = np.bincount(of[d], minlength=n)
    at = np.cumsum(count) - count  # where a segment's draws begin in d

    # Each segment's state; one that is stored twice with differences is none.
    own, good = _states(rows.column("state").take(pa.array(s)))
    state_of = np.full(n, -1)
    state_of[of[s[::-1]]] = np.arange(len(s))[::-1]
    good[state_of[of[s[(own != own[state_of[of[s]]]).any(1)]]]] = False
    block = np.searchsorted(np.array(segments(rows, ["stream", "block"], None)[0]), first, side="right")
    known = (state_of >= 0) & named
    usable = known & good[state_of] if len(s) else known
    before = np.zeros(n, dtype=bool)
    before[1:] = usable[:-1] & (block[1:] == block[:-1]) & (segment[1:] == segment[:-1] + 1)

    problem: dict[int, tuple[str, int | None]] = {}
    for g in np.flatnonzero((count > 0) & ~known).tolist():
        problem[g] = ("state", None)
    checked = np.flatnonzero((count > 0) & known)
    if len(checked):
        seed, seeded = (x[s[state_of[checked]]] for x in _numbers(rows.column("seed"), 0))
        fresh = ~before[checked]
        for g in checked[fresh & ~((segment[checked] == 0) & seeded)].tolist():
            problem[g] = ("no state to start from", None)
        t = Twisters(np.zeros((len(checked), WORDS), _u), np.full(len(checked), WORDS))
        new, old = np.flatnonzero(fresh), np.flatnonzero(~fresh)
        t.words[new] = Twisters.seeded(seed[new]).words
        start = own[state_of[checked[old] - 1]]
        t.words[old], t.place[old] = start[:, :-1], start[:, -1]

        draws = rows.take(pa.array(d))
        ordinal, ordered = _numbers(draws.column("ordinal"))
        wanted = segment[of[d]] * every + np.arange(len(d)) - at[of[d]]
        for i in np.flatnonzero(~ordered | (ordinal != wanted)).tolist():
            problem.setdefault(int(of[d[i]]), ("ordinals", int(wanted[i])))
        operation = _numbers(pc.index_in(draws.column("operation"), value_set=pa.array(OPERATIONS)))[0]
        (a, has_a), (b, has_b) = _numbers(draws.column("a"), 0), _numbers(draws.column("b"), 0)
        for i in np.flatnonzero(~_possible(operation, a, b, has_a, has_b)).tolist():
            problem.setdefault(int(of[d[i]]), ("operation", int(ordinal[i])))
        results = draws.column("result").to_pylist()
        alive = np.array([g not in problem for g in checked.tolist()])
        for k in range(int(count[checked].max())):
            now = np.flatnonzero(alive & (count[checked] > k))
            draw = at[checked[now]] + k
            for o, name in enumerate(OPERATIONS):
                mine = operation[draw] == o
                if mine.any():
                    i = draw[mine]
                    for x, j, got in zip(now[mine].tolist(), i.tolist(), t.draw(now[mine], name, a[i], b[i])):
                        if got != results[j]:
                            problem[int(checked[x])], alive[x] = ("result", int(ordinal[j])), False
        after = own[state_of[checked]]
        true = good[state_of[checked]] & (after[:, :-1] == t.words).all(1) & (after[:, -1] == t.place)
        for g in checked[alive & ~true].tolist():
            problem[g] = ("state", None)
    found = sorted(problem)
    where = pa.array(first[found] if found else [], pa.int64())
    return pa.RecordBatch.from_arrays([rows.column("stream").take(where), rows.column("segment").take(where), pa.array([problem[g][0] for g in found], pa.string()), pa.array([problem[g][1] for g in found], pa.int64())], names=["stream", "segment", "problem", "ordinal"])


def _check(every: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over sorted rows: what is wrong, by whole blocks; the last block of a batch may go on and is held."""

    def checked(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held:
            table = pa.Table.from_batches(held)
            yield _replayed(pa.RecordBatch.from_arrays([pa.concat_arrays(c.chunks) for c in table.columns], names=table.column_names), every)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, goes_on, last = segments(batch, ["stream", "block"], last)
            if goes_on and len(starts) == 2:
                held.append(batch)
                continue
            cut = starts[-2]
            yield from checked([*held, batch.slice(0, cut)] if cut else held)
            held = [batch.slice(cut)]
        yield from checked(held)

    return run


def _in_blocks(rows: DataFrame, every: int, tasks: int | None) -> DataFrame:
    """rows: stream, seed, segment, ordinal, operation, a, b, result, state, drawn (the row is a draw) and stored (it has a state)."""
    each = max(1, BLOCK // every)
    ahead = F.when(F.col("stored") & (F.pmod(F.col("segment"), F.lit(each)) == each - 1), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    dealt = rows.select("*", F.explode(ahead).alias("ahead")).withColumns({"block": F.floor(F.col("segment") / each) + F.col("ahead"), "drawn": F.col("drawn") & (F.col("ahead") == 0)}).drop("ahead")
    at = ["stream", "block"]
    dealt = (dealt.repartition(tasks, *at) if tasks else dealt.repartition(*at)).sortWithinPartitions(*at, "segment", "ordinal")
    kind = rows.schema["stream"].dataType.simpleString()
    return dealt.mapInArrow(_check(every), f"stream {kind}, segment long, problem string, ordinal long")


def check_log(log: DataFrame, every: int, tasks: int | None = None) -> DataFrame:
    """`check_streams` of one table, which is read once: the draws with their stream's seed, and the state after them in the row of a
    segment's last draw (elsewhere null). A state may be 625 numbers, or 2,500 bytes (4 for each, lowest first). tasks: into how many the
    blocks are dealt; None takes the session's number."""
    segment = F.floor(F.col("ordinal") / every).cast("long")
    rows = log.select("stream", F.col("seed").cast("long").alias("seed"), segment.alias("segment"), *_draw_columns(), "state", F.lit(True).alias("drawn"), F.col("state").isNotNull().alias("stored"))
    return _in_blocks(rows, every, tasks)


def _draw_columns() -> list:
    return [F.col("ordinal").cast("long").alias("ordinal"), F.col("operation"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("result").cast("array<bigint>").alias("result")]


def check_streams(draws: DataFrame, states: DataFrame, every: int) -> DataFrame:
    """(stream, segment, problem, ordinal) of the segments that a replay doesn't confirm, each with its first problem.

    draws: stream, ordinal (from 0), operation, a, b, result (array of whole numbers). states: stream, seed, segment (from 0), state: the 625
    numbers after the segment's draws, `every` of them or what is left. Problems: `ordinals` (one is missing or repeats), `operation`
    (unknown, or its arguments are), `result`, `state`, and `no state to start from`. Segments of draws without a state are
    reported; null streams are one; states of one segment that differ are none.
    """
    segment = F.floor(F.col("ordinal") / every).cast("long")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    made = draws.select("stream", none("long", "seed"), segment.alias("segment"), *_draw_columns(), none("array<bigint>", "state"), F.lit(True).alias("drawn"), F.lit(False).alias("stored"))
    kept = states.select(
        "stream", F.col("seed").cast("long").alias("seed"), F.col("segment").cast("long").alias("segment"), none("long", "ordinal"), none("string", "operation"), none("long", "a"), none("long", "b"), none("array<bigint>", "result"),
        F.col("state").cast("array<bigint>").alias("state"), F.lit(False).alias("drawn"), F.lit(True).alias("stored"),
    )
    return _in_blocks(made.unionByName(kept), every, None)
