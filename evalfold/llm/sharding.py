"""Sharding by a hierarchical weighted hash tree: region, then rack, then shard, by weighted hash draws.

At each node every child draws -ln(u) / weight, where u in (0, 1) comes from a hash of the document's id and the child's
path; the least draw wins, so a child is chosen in proportion to its weight. A child's draw depends on nothing but the
id, its path and its weight: when weights change, a row moves only at a node whose children changed weight, and only
towards the children that gained (or away from those that lost), so movement stays inside those subtrees.

The law of `op2_sharding` is `key`: doc_id and the shard count decide. One more shard joins as a region of its own, so
that the only subtree whose weight changes holds only the new shard: rows move only into it.

All of this is column arithmetic without a shuffle. Only the slots (gapless numbers within a shard) need one, of narrow
rows: rows are dealt to (shard, bucket) with a number of buckets that grows with the input, numbered inside their bucket,
and raised by the count of the shard's earlier buckets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalfold.llm.common import free_name, read, staged

#: Rows aimed at in a bucket of the numbering.
SLOT_ROWS = 50_000


@dataclass(frozen=True)
class Leaf:
    """A shard of the tree with its place and weight (over 0)."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0


def fleet(shards: int, base: int = 8) -> list[Leaf]:
    """Shards 0..base-1 as regions of two racks of two shards; each later shard is a region of its own."""
    return [Leaf(s // 4, s // 2 % 2, s) if s < base else Leaf(base + s, 0, s) for s in range(shards)]


def _draw(key: Column, path: str, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(path)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / F.lit(float(weight))


def _descend(key: Column, children: dict, path: str) -> Column:
    """The shard that the draws lead to from a node whose children are {name: subtree}; a subtree of one shard is that Leaf."""
    weight = lambda x: x.weight if isinstance(x, Leaf) else sum(map(weight, x.values()))
    below = lambda name, x: F.lit(x.shard) if isinstance(x, Leaf) else _descend(key, x, f"{path}/{name}")
    names = sorted(children)
    if len(names) == 1:
        return below(names[0], children[names[0]])
    won = F.array_min(F.array(*(F.struct(_draw(key, f"{path}/{n}", weight(children[n])).alias("d"), F.lit(i).alias("i")) for i, n in enumerate(names))))["i"]
    out = below(names[-1], children[names[-1]])
    for i, n in reversed([*enumerate(names)][:-1]):
        out = F.when(won == i, below(n, children[n])).otherwise(out)
    return out


def shard_of(key: Column, leaves: list[Leaf]) -> Column:
    """The shard number that the tree of `leaves` gives to `key`. A null key is a key like any other."""
    tree: dict = {}
    for x in leaves:
        if x.weight <= 0:
            raise ValueError("weights must be over 0")
        tree.setdefault(x.region, {}).setdefault(x.rack, {})[x.shard] = x
    return _descend(key, tree, "").cast("int")


def with_slots(rows: DataFrame, by: str, order: list[str], buckets: int) -> DataFrame:
    """`rows` with `slot`: gapless numbers from 0 within each value of `by`, by bucket and `order`.

    No task gets more than a bucket, apart from rows that agree in every column of `order`: they take neighbouring slots. A
    column `slot` is replaced; other columns pass through, whatever their names.
    """
    rows = rows.drop("slot")
    bucket, row, n, start = (free_name(rows, x) for x in ("bucket", "row", "rows_in", "start"))
    dealt = rows.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy(by, bucket).agg(F.count(F.lit(1)).alias(n))
    before = F.coalesce(F.sum(n).over(Window.partitionBy(by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(by, bucket, before.alias(start))
    numbered = dealt.withColumn(row, F.row_number().over(Window.partitionBy(by, bucket).orderBy(*order)))
    return numbered.join(starts, [by, bucket]).withColumn("slot", F.col(start) + F.col(row) - 1).drop(bucket, row, start)


def shard_documents(docs: DataFrame, leaves: list[Leaf], grown: list[Leaf]) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    Null or empty text: size 1, checksum 0. Rows that repeat a doc_id share a shard and take slots of their own.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = staged(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), leaves).alias("shard"), shard_of(F.col("doc_id"), grown).alias("grown_shard"),
    ), "shards")
    buckets = max(1, rows.count() // (SLOT_ROWS * len(leaves)) * 2 + 32)
    return with_slots(rows, "shard", ["doc_id", "text_crc32", "size"], buckets).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on eight shards, and where they would be on nine."""
    return shard_documents(read(spark, sf_dir, "documents"), fleet(8), fleet(9))
