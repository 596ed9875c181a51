"""Bloom filters of numbers, made by Spark's bitmap aggregates and small enough to be broadcast."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalfold.llm.common import free_name

# The primes of xxHash64.
_PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)


@dataclass
class Bloom:
    """A filter of two hashes; `bits` are packed, each byte's least bit first. An empty one holds nothing."""

    bits: np.ndarray

    @staticmethod
    def of(rows: DataFrame, column: str, bits_each: int, most: int) -> Bloom:
        """The filter of a long column without nulls: about `bits_each` bits for each row, a power of two from 2**15 to `most`.

        Each task sets bits in bitmaps of 4 KB, which are merged by number; the driver gets the filter, `most` / 8 bytes at most.
        """
        size = min(most, max(1 << 15, 1 << (rows.count() * bits_each).bit_length()))
        x = F.col(column)
        first, second = (F.pmod(F.xxhash64(x, F.lit(salt)), F.lit(size)) + 1 for salt in (1, 2))  # the bitmap functions count from 1
        at = rows.select(F.explode(F.array(first, second)).alias("at"))
        made = at.groupBy(F.bitmap_bucket_number("at").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).toArrow()
        out = np.zeros(size // 8, dtype=np.uint8)
        for n, own in zip(made["n"].to_pylist(), made["bits"].to_pylist()):
            out[(n - 1) * 4096 : n * 4096] = np.frombuffer(own, np.uint8)  # bucket n holds 32768 bits
        return Bloom(out)

    def holds(self, values: np.ndarray) -> np.ndarray:
        """Of each number, whether it may be in the filter."""
        out = np.ones(len(values), dtype=bool)
        for salt in (1, 2):
            at = (xxhash64(values, salt) & np.uint64(len(self.bits) * 8 - 1)).astype(np.int64)
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        return out


#: Numbers up to which `without` broadcasts them themselves (some 32 bytes each); bits of its filter for each, and at most.
BROADCAST_NUMBERS, EACH, MOST = 1_000_000, 16, 1 << 28


def may_hold(filter_: Bloom, df: DataFrame, column: str) -> Column:
    """Whether the filter may hold the long `column` of `df`; a null is taken for one that it may."""
    sent = df.sparkSession.sparkContext.broadcast(filter_)

    def held(x: pa.Array) -> pa.Array:
        return pa.array(sent.value.holds(x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)))

    return F.col(column).isNull() | F.arrow_udf(held, "boolean")(column)


def without(rows: DataFrame, gone: DataFrame, column: str, broadcast_numbers: int = BROADCAST_NUMBERS) -> DataFrame:
    """The rows whose long `column` isn't in `gone` (a written table of that column); rows without it stay.

    Wide rows aren't shuffled for this: up to `broadcast_numbers` numbers are broadcast; beyond, a filter of them is, and only
    the rows that it lets through are joined.
    """
    if gone.count() <= broadcast_numbers:
        return rows.join(F.broadcast(gone), column, "left_anti").select(*rows.columns)
    may = free_name(rows, "may_go")
    marked = rows.withColumn(may, may_hold(Bloom.of(gone.filter(F.col(column).isNotNull()), column, EACH, MOST), rows, column))
    return marked.filter(~F.col(may)).unionByName(marked.filter(may).join(gone, column, "left_anti")).select(*rows.columns)


def _long(value: np.ndarray, seed: np.ndarray, bytes_: int) -> np.ndarray:
    """xxHash64 of one number of 4 or 8 bytes with this seed."""
    u = np.uint64
    rotl = lambda x, n: (x << u(n)) | (x >> u(64 - n))
    p1, p2, p3, p4, p5 = map(u, _PRIMES)
    h = seed + p5 + u(bytes_)
    if bytes_ == 8:
        h = h ^ (rotl(value * p2, 31) * p1)
        h = rotl(h, 27) * p1 + p4
    else:
        h = h ^ (value * p1)
        h = rotl(h, 23) * p2 + p3
    h = (h ^ (h >> u(33))) * p2
    h = (h ^ (h >> u(29))) * p3
    return h ^ (h >> u(32))


def xxhash64(values: np.ndarray, salt: int) -> np.ndarray:
    """What Spark's xxhash64(long column, int literal) gives, as unsigned numbers."""
    with np.errstate(over="ignore"):
        first = _long(values.astype(np.int64).view(np.uint64), np.full(len(values), 42, np.uint64), 8)
        return _long(np.full(len(values), salt, np.uint64), first, 4)
