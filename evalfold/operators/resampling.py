"""Bootstrap means by splitting counts, so that no draw is a row.

Resampling n values with replacement draws how often each distinct value occurs: a multinomial. It is drawn by halves. A group's
distinct values, in order, are the leaves of a binary tree; of the draws that reach a node, a binomial number goes left, by
the share of the group's values that lie there. The binomial of (node, resample) is the inverse of its distribution at a hash of
seed, resample and node, so every task finds the same numbers, whatever it holds: a task walks from the root to the
subtrees of SUBTREE leaves that it holds, and sends one sum for each resample and group. Equal values are one leaf, so scores of few
kinds cost nothing; R resamples of d distinct values cost R d binomials, whatever n is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalfold.operators.logs import join_null_safe, numbered
from evalfold.sources.staging import staged

DEFAULT_RESAMPLES = 10_000
#: Depth of a subtree that one row holds (2**SUBTREE leaves), draws that one inversion takes, tasks at most.
SUBTREE, PIECE, TASKS = 12, (1 << 16) - 1, 10_000
# The multipliers of the hash.
SPREAD, NODES, RESAMPLE, MASK = 0x45D9F3B, 0x9E3779B1, 1000003, (1 << 32) - 1


def _spread(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (((x >> 16) ^ x) * SPREAD) & MASK
    return (x >> 16) ^ x


@lru_cache(maxsize=8)
def _hashed(seed: int, first: int, n: int) -> np.ndarray:
    return _spread((seed * RESAMPLE + np.arange(first, first + n)) & MASK)


def uniform(seed: int, resamples: np.ndarray, node: int) -> np.ndarray:
    """A number between 0 and 1 (of 32 bits) for each of a run of resamples at a node."""
    h = _hashed(seed, int(resamples[0]), len(resamples))
    return (_spread((h + (node * NODES & MASK)) & MASK) + 0.5) / 2.0**32


@lru_cache(maxsize=1)
def _log_factorials() -> np.ndarray:
    return np.array([math.lgamma(k + 1) for k in range(PIECE + 1)])


def _inverse(m: int, p: float, u: np.ndarray) -> np.ndarray:
    """The least k whose binomial distribution function (m up to PIECE, p) exceeds u."""
    far, table = 14 * math.sqrt(m * p * (1 - p)) + 14, _log_factorials()
    low, high = max(0, int(m * p - far)), min(m, int(m * p + far))
    k = np.arange(low, high + 1)
    log = table[m] - table[low : high + 1] - table[m - high : m - low + 1][::-1] + k * math.log(p) + (m - k) * math.log1p(-p)
    return np.minimum(low + np.searchsorted(np.cumsum(np.exp(log)), u, side="right"), m)


def binomial(m: np.ndarray, p: float, seed: int, resamples: np.ndarray, node: int) -> np.ndarray:
    """Of m draws of each resample, how many go left. More than PIECE draws are drawn in pieces, by seeds of their own."""
    if p >= 1:
        return m
    out, piece = np.zeros(len(m), np.int64), 0
    left = m.copy()
    while left.any():
        now = np.minimum(left, PIECE)
        u = uniform(seed + piece, resamples, node)
        order = np.argsort(now.astype(np.uint16), kind="stable")
        sizes, first = np.unique(now[order], return_index=True)
        for size, at in zip(sizes.tolist(), np.split(order, first[1:])):
            if size:
                out[at] += _inverse(size, p, u[at])
        left -= now
        piece += 1
    return out


def _below(m: np.ndarray, root: int, depth: int, counts: np.ndarray, seed: int, resamples: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each leaf of a subtree with its draws of each resample, from those that reach the root; one path is held at a time."""
    totals = [np.zeros(1 << depth, np.int64)]
    totals[0][: len(counts)] = counts
    while len(totals[-1]) > 1:
        totals.append(totals[-1].reshape(-1, 2).sum(1))
    totals.reverse()
    open_ = [(0, 0, m)]
    while open_:
        d, j, at = open_.pop()
        if not totals[d][j] or not at.any():
            continue
        if d == depth:
            yield j, at
            continue
        left = binomial(at, totals[d + 1][2 * j] / totals[d][j], seed, resamples, (root << d) + j)
        open_ += [(d + 1, 2 * j + 1, at - left), (d + 1, 2 * j, left)]


def _sums(keys: list[str], resamples: int, seed: int, subtree: int):
    """(keys, resample, sum) of the subtrees that a task holds; neighbouring ones of a group are summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, held, sums, path = np.arange(resamples, dtype=np.int64), None, None, {}

        def out() -> pa.RecordBatch:
            columns = [pa.array([v], t).take(pa.array(np.zeros(resamples, np.int64))) for v, t in zip(held, kinds)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(every), pa.array(sums)], names=[*keys, "resample", "sum"])

        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            for row in batch.to_pylist():
                own = tuple(row[k] for k in keys)
                if own != held:
                    if held is not None:
                        yield out()
                    held, sums, path = own, np.zeros(resamples), {}
                depth, m, root, above = min(row["depth"], subtree), np.full(resamples, row["n"], np.int64), 1, {}
                for d, step in enumerate(sorted(row["path"] or [], key=lambda x: x["d"])):  # from the root down to the subtree
                    above[root] = path[root] if root in path else binomial(m, step["left"] / step["total"], seed, every, root)
                    bit = (row["chunk"] >> (row["depth"] - depth - d - 1)) & 1
                    m, root = (m - above[root] if bit else above[root]), 2 * root + bit
                path = above  # the next subtree shares most of it
                leaves = sorted(row["leaves"], key=lambda x: x["place"])
                values, counts = np.array([x["value"] for x in leaves]), np.array([x["count"] for x in leaves], np.int64)
                for leaf, times in _below(m, root, depth, counts, seed, every):
                    sums += times * values[leaf]
        if held is not None:
            yield out()

    return run


def resampled_means(values: DataFrame, keys: list[str], resamples: int = DEFAULT_RESAMPLES, seed: int = 0, subtree: int = SUBTREE) -> DataFrame:
    """(keys, resample, mean) of `resamples` draws with replacement from each group's values (`value`).

    Null and NaN values fail; null keys are a group; an empty table has no group. All groups share the hashes of a seed.
    """
    if resamples < 1:
        raise ValueError("resamples must be at least 1")
    known = F.when(F.isnan("value") | F.col("value").isNull(), F.raise_error(F.lit("a value to resample is null or NaN")).cast("double")).otherwise(F.col("value").cast("double"))
    kinds = values.select(*keys, known.alias("value")).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("count"))
    placed = staged(numbered(kinds, keys, None, ["value"], "place").withColumn("place", F.col("place") - 1), "leaves")
    sizes = placed.groupBy(*keys).agg(F.sum("count").alias("n"), (F.max("place") + 1).alias("d"))
    sizes = sizes.withColumn("depth", F.when(F.col("d") == 1, 0).otherwise(F.length(F.bin(F.col("d") - 1)))).drop("d")
    high = F.greatest(F.lit(0), F.col("depth") - subtree)  # depth of the subtrees' roots
    leaves = join_null_safe(placed, sizes, keys).withColumn("chunk", F.expr(f"shiftright(place, least(depth, {subtree}))"))
    chunks = leaves.groupBy(*keys, "n", "depth", "chunk").agg(F.collect_list(F.struct("place", "value", "count")).alias("leaves"), F.sum("count").alias("total"))
    chunks = staged(chunks, "subtrees")
    # What the path from the root to each subtree passes: the node's values, and those on its left.
    large = chunks.filter(high > 0).select(*keys, "depth", "chunk", "total")
    nodes = large.withColumn("d", F.explode(F.sequence(F.lit(0), high))).withColumn("node", F.expr(f"shiftleft(1L, d) + shiftright(chunk, depth - {subtree} - d)"))
    totals = staged(nodes.groupBy(*keys, "node").agg(F.sum("total").alias("total")), "nodes")
    steps = nodes.filter(F.col("d") < high).select(*keys, "chunk", "d", "node", (2 * F.col("node")).alias("first"))
    steps = join_null_safe(join_null_safe(steps, totals, [*keys, "node"]), totals.select(*keys, F.col("node").alias("first"), F.col("total").alias("left")), [*keys, "first"])
    paths = steps.groupBy(*keys, "chunk").agg(F.collect_list(F.struct("d", "total", "left")).alias("path"))
    without = chunks.filter(high == 0).withColumn("path", F.lit(None).cast(paths.schema["path"].dataType))
    # Subtrees are few rows of much work, so their tasks are counted by rows and not by bytes.
    tasks = min(TASKS, 4 * max(1, chunks.count()))
    rows = without.unionByName(join_null_safe(chunks.filter(high > 0), paths, [*keys, "chunk"])).drop("total").repartition(tasks, *keys, "chunk").sortWithinPartitions(*keys, "chunk")
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in values.select(*keys).schema]
    sums = rows.mapInArrow(_sums(keys, resamples, seed, subtree), ", ".join([*names, "resample long", "sum double"]))
    means = sums.groupBy(*keys, "resample").agg(F.sum("sum").alias("sum"))
    return join_null_safe(means, sizes, keys).select(*keys, "resample", (F.col("sum") / F.col("n")).alias("mean"))


def resampled_sql(key: str, resamples: int, seed: int, levels: int = 12) -> str:
    """SQL: (key, r, mean) as `me`, from `vals` (key, value) of at most 2**levels distinct values and PIECE values in a group.

    The key's name must be longer than those of the columns used here (two letters)."""
    spread = lambda x, to, n: ", ".join(f"(xor({a} >> 16, {a}) * {SPREAD}) & {MASK} AS {to}{n + i}" for i, a in enumerate((x, f"{to}{n}"))) + f", xor({to}{n + 1} >> 16, {to}{n + 1}) AS {to}{n + 2}"
    out = [f"""lv AS (SELECT {key}, value, count(*) AS c FROM vals GROUP BY {key}, value),
pl AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY value) - 1 AS place, count(*) OVER (PARTITION BY {key}) AS d, sum(c) OVER (PARTITION BY {key})::BIGINT AS n FROM lv),
lf AS MATERIALIZED (SELECT *, CASE WHEN d = 1 THEN 0 ELSE length(bin(d - 1)) END AS depth FROM pl),
nd AS MATERIALIZED (SELECT {key}, depth, x.l, (1 << x.l) + (place >> (depth - x.l)) AS node, sum(c)::BIGINT AS t FROM lf, range(0, {levels + 1}) AS x(l) WHERE x.l <= depth GROUP BY ALL),
m0 AS (SELECT {key}, depth, 1::BIGINT AS node, r, n AS m FROM (SELECT DISTINCT {key}, depth, n FROM lf), range(0, {resamples}) AS y(r))"""]
    for i in range(levels):
        out.append(f"""s{i} AS MATERIALIZED (SELECT z.*, (b.t / a.t)::DOUBLE AS p FROM m{i} z JOIN nd a ON a.{key} = z.{key} AND a.node = z.node AND a.l = {i} JOIN nd b ON b.{key} = z.{key} AND b.node = 2 * z.node AND b.l = {i + 1} WHERE z.depth > {i} AND m > 0),
h{i} AS (SELECT {key}, depth, node, r, m, p, ({seed} * {RESAMPLE} + r) & {MASK} AS a0, {spread("a0", "a", 1)}, (a3 + node * {NODES}) & {MASK} AS b0, {spread("b0", "b", 1)}, (b3 + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u FROM s{i}),
c{i} AS (SELECT {key}, node, m, k, sum(exp(lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1) + k * ln(p) + (m - k) * ln(1 - p))) OVER (PARTITION BY {key}, node, m ORDER BY k) AS f FROM (SELECT {key}, node, m, p, unnest(range(greatest(0, (m * p - 14 * sqrt(m * p * (1 - p)) - 14)::BIGINT), least(m, (m * p + 14 * sqrt(m * p * (1 - p)) + 14)::BIGINT) + 1)) AS k FROM (SELECT DISTINCT {key}, node, m, p FROM s{i} WHERE p < 1))),
k{i} AS MATERIALIZED (SELECT h.{key}, h.depth, h.node, h.r, h.m, CASE WHEN h.p >= 1 THEN h.m ELSE least(h.m, coalesce(c.k + 1, greatest(0, (h.m * h.p - 14 * sqrt(h.m * h.p * (1 - h.p)) - 14)::BIGINT))) END AS k FROM h{i} h ASOF LEFT JOIN c{i} c ON h.{key} = c.{key} AND h.node = c.node AND h.m = c.m AND h.u >= c.f),
m{i + 1} AS MATERIALIZED (SELECT {key}, depth, 2 * node AS node, r, k AS m FROM k{i} UNION ALL SELECT {key}, depth, 2 * node + 1 AS node, r, m - k AS m FROM k{i})""")
    ends = " UNION ALL ".join(f"SELECT {key}, r, node - (1 << {i}) AS place, m FROM m{i} WHERE depth = {i} AND m > 0" for i in range(levels + 1))
    out.append(f"me AS (SELECT {key}, r, round(sum(e.m * value) / max(n), 9) AS mean FROM ({ends}) e JOIN lf USING ({key}, place) GROUP BY {key}, r)")
    return ",\n".join(out)
