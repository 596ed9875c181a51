"""Pareto fronts of any number of objectives: a skyline in cells of a grid, without a window over a group.

0. As rows are read, each task drops what a strong vector that it has seen before dominates; it keeps KEPT of them for a group, of up to
   GROUPS groups, so that few rows are exchanged.
1. Equal vectors are one; each group's objectives are cut into bands at approximate quantiles, and the bands make cells, at most CELLS
   of a group.
2. Of two cells, one whose bands are all lower than the other's dominates it whole, so cells are compared first and whole cells go.
3. What is left is filtered within its cell, in tasks, in an order in which no vector is dominated by a later one.
4. The candidates meet only those of cells that aren't above theirs in any band, and only those that lie below the cell's upper
   corner. A cell's candidates are dealt to blocks of about BLOCK, what they meet is dealt to streams of about STREAM; a task holds one block while a
   stream passes, and gives the vectors that something dominates.

Steps 0, 2 and 3 only save work; step 4 alone decides, so a cell may be split over tasks and the filter may stop at WINDOW vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalfold.operators.logs import join_null_safe
from evalfold.sources.staging import free_name, staged

CELLS, BLOCK, STREAM, WINDOW = 1024, 4096, 200_000, 8192
KEPT, GROUPS = 128, 64
#: Rows of a front up to which it is broadcast to the rows.
SENT = 200_000
DIRECTIONS = ("max", "min")


def dominated(targets: np.ndarray, others: np.ndarray, step: int = 512) -> np.ndarray:
    """Of each row of `targets`, whether a row of `others` is nowhere larger and somewhere smaller."""
    out = np.zeros(len(targets), dtype=bool)
    for k in range(0, len(others), step):
        some = others[k : k + step]
        live = np.flatnonzero(~out)
        below, less = np.ones((len(live), len(some)), dtype=bool), np.zeros((len(live), len(some)), dtype=bool)
        for i in range(targets.shape[1]):
            t, o = targets[live, i][:, None], some[:, i][None, :]
            below &= o <= t
            less |= o < t
        out[live[(below & less).any(1)]] = True
    return out


def segments(batch: pa.RecordBatch, names: list[str], last: tuple | None) -> tuple[list[int], bool, tuple | None]:
    """Where runs of equal values of these columns start (and the end), whether the first goes on from `last`, and the last values."""
    n = batch.num_rows
    change = np.zeros(n, dtype=bool)
    change[0] = True
    for c in names:
        column = batch.column(c)
        same = pc.fill_null(pc.equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False)
        null = pc.is_null(column).to_numpy(zero_copy_only=False)
        change[1:] |= ~(same | (null[1:] & null[:-1]))
    values = lambda i: tuple(batch.column(c)[i].as_py() for c in names)
    return [*np.flatnonzero(change).tolist(), n], values(0) == last, values(n - 1)


def _matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1)


def _thinned(group: list[str], costs: list[str]):
    """Drops rows that a strong vector dominates which the task has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: dict[tuple, np.ndarray] = {}
        for batch in batches:
            codes = np.zeros(batch.num_rows, dtype=np.int64)
            for c in group:
                own = batch.column(c).dictionary_encode(null_encoding="encode")
                codes = np.unique(codes * (len(own.dictionary) + 1) + own.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
            first, of = np.unique(codes, return_index=True, return_inverse=True)[1:]
            if not batch.num_rows or len(first) > GROUPS:
                yield batch
                continue
            x, keep = _matrix(batch, costs), np.ones(batch.num_rows, dtype=bool)
            for g, i in enumerate(first.tolist()):
                key = tuple(batch.column(c)[i].as_py() for c in group)
                if key not in windows and len(windows) >= GROUPS:
                    continue
                mine = np.flatnonzero(of == g)
                left = mine[~dominated(x[mine], windows.get(key, x[:0]))]
                # The strongest by the sum of their costs, each on its own scale.
                known = np.unique(np.concatenate([windows.get(key, x[:0]), x[left]]), axis=0)
                scale = x[mine].std(axis=0)
                known = known[np.argsort((known / np.where(scale > 0, scale, 1)).sum(axis=1), kind="stable")[:KEPT]]
                windows[key] = known[~dominated(known, known)]
                keep[mine] = False
                keep[left[~dominated(x[left], windows[key])]] = True
            yield batch.filter(pa.array(keep))

    return run


def _local(at: list[str], costs: list[str]):
    """Filters sorted rows: what an earlier one of the same cell dominates goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, window = None, np.zeros((0, len(costs)))
        for batch in batches:
            if not batch.num_rows:
                continue
            x, keep = _matrix(batch, costs), np.ones(batch.num_rows, dtype=bool)
            starts, goes_on, last = segments(batch, at, last)
            for k, (a, b) in enumerate(zip(starts, starts[1:])):
                if k or not goes_on:
                    window = np.zeros((0, len(costs)))
                for c in range(a, b, 256):
                    d = min(b, c + 256)
                    keep[c:d] = ~dominated(x[c:d], window)
                    own = np.flatnonzero(keep[c:d]) + c
                    keep[own] = ~dominated(x[own], x[own])
                    window = np.concatenate([window, x[c:d][keep[c:d]]])[:WINDOW]
            yield batch.filter(pa.array(keep))

    return run


def _merge(at: list[str], costs: list[str]):
    """Sorted rows of each block: its targets first, then what passes by; gives the targets that something dominates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, gone = None, [], np.zeros(0, dtype=bool)

        def out() -> Iterator[pa.RecordBatch]:
            if held and gone.any():
                table = pa.Table.from_batches(held).filter(pa.array(gone))
                yield from table.combine_chunks().to_batches()

        x = np.zeros((0, len(costs)))
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, goes_on, last = segments(batch, at, last)
            for k, (a, b) in enumerate(zip(starts, starts[1:])):
                if k or not goes_on:
                    yield from out()
                    held, gone, x = [], np.zeros(0, dtype=bool), np.zeros((0, len(costs)))
                part = batch.slice(a, b - a)
                target = part.column("_target").to_numpy(zero_copy_only=False)
                own, values = part.filter(pa.array(target)), _matrix(part, costs)
                if own.num_rows:
                    held.append(own)
                    x, gone = np.concatenate([x, values[target]]), np.concatenate([gone, np.zeros(own.num_rows, dtype=bool)])
                live = np.flatnonzero(~gone)
                gone[live] = dominated(x[live], values[~target])
        yield from out()

    return run


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _all(*conditions: Column) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def pareto_front(rows: DataFrame, objectives: dict[str, str], keys: list[str], cells: int = CELLS, block: int = BLOCK, stream: int = STREAM) -> DataFrame:
    """The rows that no other row of their group (`keys`; none: all rows are one group) dominates.

    objectives: each numeric column's direction, `max` or `min`. A row dominates another if it is nowhere worse and somewhere better, so
    exact ties stay. Values are compared as doubles; a null, NaN or infinite one fails. Null keys are a group.
    """
    if not objectives or any(d not in DIRECTIONS for d in objectives.values()):
        raise ValueError(f"each objective needs a direction of {DIRECTIONS}: {objectives}")
    d = len(objectives)
    costs, bands, group = [f"_c{i}" for i in range(d)], [f"_b{i}" for i in range(d)], [f"_k{i}" for i in range(max(1, len(keys)))]
    finite = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")).otherwise(F.raise_error(F.lit(f"{c}: not a finite value")).cast("double"))
    cost = lambda c, direction: (finite(c) * (-1.0 if direction == "max" else 1.0) + F.lit(0.0))
    named = [*((F.col(k) if keys else F.lit(0)).alias(g) for k, g in zip(keys or [""], group)), *(cost(c, o).alias(n) for n, (c, o) in zip(costs, objectives.items()))]
    read = rows.select(*named)
    vectors = staged(read.mapInArrow(_thinned(group, costs), _schema(read)).distinct(), "vectors")

    each = max(2, int(cells ** (1 / d) + 1e-9))
    cuts = [k / each for k in range(1, each)]
    bounds = vectors.groupBy(*group).agg(*(F.percentile_approx(c, cuts, 1000).alias(f"{c}_q") for c in costs))
    banded = join_null_safe(vectors, bounds, group)
    band = lambda c: F.size(F.filter(f"{c}_q", lambda q: q < F.col(c)))
    banded = banded.select(*group, *costs, *(band(c).alias(b) for c, b in zip(costs, bands)))
    banded = staged(banded, "banded")
    occupied = banded.select(*group, *bands).distinct()
    same = lambda a, b, names: [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names]
    lower = occupied.alias("hi").join(occupied.alias("lo"), _all(*same("hi", "lo", group), *(F.col(f"lo.{b}") < F.col(f"hi.{b}") for b in bands)), "left_anti")
    live = banded.alias("v").join(lower.alias("c"), _all(*same("v", "c", [*group, *bands])), "left_semi").withColumn("_sum", sum((F.col(c) for c in costs[1:]), F.col(costs[0])))
    dealt = live.hint("rebalance", *group, *bands).sortWithinPartitions(*group, *bands, "_sum", *costs).drop("_sum")
    found = staged(dealt.mapInArrow(_local([*group, *bands], costs), _schema(dealt)), "candidates")

    corners = found.groupBy(*group, *bands).agg(F.count(F.lit(1)).alias("_n"), *(F.max(c).alias(f"{c}_max") for c in costs), *(F.min(c).alias(f"{c}_min") for c in costs))
    corners = staged(corners, "corners")
    # Which cells' candidates may be dominated by which cells' (pairs of cells, at most CELLS a group).
    met = corners.alias("t").join(corners.alias("o"), _all(*same("t", "o", group), *(F.col(f"o.{b}") <= F.col(f"t.{b}") for b in bands), *(F.col(f"o.{c}_min") <= F.col(f"t.{c}_max") for c in costs)))
    other = [f"_o{i}" for i in range(d)]
    met = met.select(*(F.col(f"t.{g}").alias(g) for g in group), *(F.col(f"t.{b}").alias(b) for b in bands), *(F.col(f"o.{b}").alias(o) for b, o in zip(bands, other)), F.col("t._n").alias("_n"), F.col("o._n").alias("_m"), *(F.col(f"t.{c}_max").alias(f"{c}_max") for c in costs))
    parts = F.ceil(F.col("_n") / block).cast("int")
    streams = join_null_safe(met, met.groupBy(*group, *bands).agg(F.ceil(F.sum("_m") / stream).cast("int").alias("_streams")), [*group, *bands])
    streams = staged(streams.withColumn("_parts", parts).drop("_n", "_m"), "meetings")
    hashed = F.xxhash64(*costs)
    dealt_to = streams.select(*group, *bands, "_parts", "_streams").distinct()
    targets = join_null_safe(found, dealt_to, [*group, *bands])
    targets = targets.select(*group, *bands, F.pmod(hashed, F.col("_parts")).alias("_part"), F.explode(F.sequence(F.lit(0), F.col("_streams") - 1)).alias("_stream"), F.lit(True).alias("_target"), *costs)
    passing = join_null_safe(found.withColumnsRenamed(dict(zip(bands, other))), streams, [*group, *other]).filter(_all(*(F.col(c) <= F.col(f"{c}_max") for c in costs)))
    passing = passing.select(*group, *bands, F.explode(F.sequence(F.lit(0).cast("long"), (F.col("_parts") - 1).cast("long"))).alias("_part"), F.pmod(F.xxhash64(*costs, F.lit(1)), F.col("_streams")).cast("int").alias("_stream"), F.lit(False).alias("_target"), *costs)
    both = targets.unionByName(passing)
    at = [*group, *bands, "_part", "_stream"]
    both = both.repartition(*at).sortWithinPartitions(*at, F.col("_target").desc())
    gone = both.mapInArrow(_merge(at, costs), _schema(both)).select(*group, *costs).distinct()
    front = found.alias("f").join(gone.alias("g"), _all(*same("f", "g", [*group, *costs])), "left_anti").select(*group, *costs)
    front = staged(front, "front")
    front = F.broadcast(front) if front.count() <= SENT else front

    mine = rows
    for c, n in zip(named, [*group, *costs]):
        mine = mine.withColumn(n, c)
    return mine.alias("r").join(front.alias("f"), _all(*same("r", "f", [*group, *costs])), "left_semi").drop(*group, *costs)


def objective_columns(rows: DataFrame, vector: str, objectives: dict[str, str], value: str = "value") -> DataFrame:
    """`rows` with one column for each declared objective, from an array of (name, direction, value).

    A row whose names or directions aren't the declared ones, in their order, fails.
    """
    taken = [n for n in objectives if n in rows.columns and n != vector]
    if taken or not objectives:
        raise ValueError(f"objectives must be new columns: {taken}")
    v = F.col(vector)
    declared = F.array(*(F.concat_ws(":", F.lit(n), F.lit(d)) for n, d in objectives.items()))
    own = F.transform(v, lambda x: F.concat_ws(":", x["name"], x["direction"]))
    checked = F.when(own == declared, v).otherwise(F.raise_error(F.concat(F.lit("objectives differ: "), F.coalesce(F.concat_ws(",", own), F.lit("null")))).cast(rows.schema[vector].dataType))
    held = free_name(rows, "checked")
    out = rows.withColumn(held, checked)
    return out.select(*rows.columns, *(F.col(held)[i][value].cast("double").alias(n) for i, n in enumerate(objectives)))
