"""Connected components of a graph given by its edges: union-find inside partitions, then least labels with pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalfold.llm.common import staged

#: Edges that one task contracts.
PART_EDGES = 100_000


def union_find(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Each node's least reachable node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in [*parent]}


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = union_find((a, b) for batch in batches for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([*found], pa.int64()), pa.array([*found.values()], pa.int64())], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b): label is the least node that it is linked with.

    Edges are dealt evenly and contracted to stars inside each partition. Then, until nothing changes, each node takes the
    least label among its star edges' ends and its label's label. A node with very many edges is pre-aggregated, and the
    joins have two exchanged sides, so adaptive execution can split its partition. Each round is written to the shared
    folder. Nothing but one sum a round reaches the driver.
    """
    parts = max(8, edges.count() // PART_EDGES + 1)
    stars = edges.select("a", "b").repartition(parts).mapInArrow(_contract, "node long, root long")
    both = stars.unionByName(stars.select(F.col("root").alias("node"), F.col("node").alias("root")))
    links = staged(both.distinct(), "links")
    labels = links.groupBy("node").agg(F.min("root").alias("label"))
    labels = staged(labels.select("node", F.least("node", "label").alias("label")), "labels")
    total = lambda x: x.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
    was = total(labels)
    while True:
        ends = labels.select(F.col("node").alias("root"), "label")
        least = staged(links.join(ends, "root").groupBy("node").agg(F.min("label").alias("label")), "labels")
        up = least.select(F.col("node").alias("label"), F.col("label").alias("above"))
        labels = staged(least.join(up, "label").select("node", F.least("label", "above").alias("label")), "labels")
        if (now := total(labels)) == was:
            return labels
        was = now
