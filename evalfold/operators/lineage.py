"""Lineage of candidates as a DAG, and which candidates others cover.

Both are rounds of joins over written tables; the driver holds counts only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalfold.sources.staging import staged


#: Rows that one task joins or groups, and of those of one key.
ROWS = 200_000


def _met(left: DataFrame, right: DataFrame, sizes: DataFrame, n: int, most: int, rows: int) -> DataFrame:
    """`left` (item, middle) joined with `right` (middle and more), `n` rows in all. A middle of over `rows` items is dealt to several tasks, and what it
    meets goes to all of them. sizes: middle and n, its rows in `left`; most: the largest n."""
    tasks, at = -(-n // rows), ["middle"]
    if most > rows:
        hot = F.broadcast(sizes.filter(F.col("n") > rows).select("middle", F.ceil(F.col("n") / rows).cast("int").alias("parts")))  # at most a row for each `rows` of left
        left = left.join(hot, "middle", "left").withColumn("part", F.pmod(F.xxhash64("item"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        right = right.join(hot, "middle", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        at = ["middle", "part"]
    return left.repartition(tasks, *at).join(right.repartition(tasks, *at), at)


def ancestors(edges: DataFrame, most_rounds: int = 40, rows: int = ROWS) -> DataFrame:
    """(item, ancestor, distance): every ancestor of an item, at the longest distance, from (item, parent) rows.

    A round holds the paths of up to 2**k steps, and which pairs exactly 2**k steps join; only these are continued, by all paths, so that
    rounds grow with the logarithm of the depth and no long path is made again from its parts. Tasks grow with the rows, `rows` for each. Repeated edges
    count once, nulls are no edge. A cycle fails: some item would be its own ancestor.
    """
    paths = edges.filter(F.col("item").isNotNull() & F.col("parent").isNotNull()).select("item", F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("distance"), F.lit(True).alias("exact")).distinct()
    paths = staged(paths, "paths")
    for k in range(most_rounds):
        if paths.filter("item = ancestor").limit(1).count():
            raise ValueError("the lineage has a cycle")
        left = paths.filter("exact").select("item", F.col("ancestor").alias("middle"))
        right = paths.withColumnRenamed("item", "middle").withColumnRenamed("exact", "again")
        sizes = left.groupBy("middle").agg(F.count(F.lit(1)).alias("n"))
        both = sizes.join(right.groupBy("middle").agg(F.count(F.lit(1)).alias("m")), "middle", "left")
        size = both.agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.sum(F.col("n") * F.col("m")).alias("out")).first()
        if not size.out:
            return paths.select("item", "ancestor", "distance")
        known = paths.count()
        longer = _met(left, right, sizes, size.n + known, size.most, rows).select("item", "ancestor", (F.col("distance") + 2**k).alias("distance"), F.col("again").alias("exact"))
        grown = paths.withColumn("exact", F.lit(False)).unionByName(longer).repartition(-(-(known + size.out) // rows), "item", "ancestor")
        paths = staged(grown.groupBy("item", "ancestor").agg(F.max("distance").alias("distance"), F.max("exact").alias("exact")), "paths")
    raise ValueError(f"the lineage is deeper than 2**{most_rounds}")


def uncovered(members: DataFrame) -> DataFrame:
    """Items that stay when items are taken one by one, lowest first, and each goes if all its sets hold another that is left.

    members: set, item, score; an item has one score, and equal scores go by item. Of a set only the highest item can stay, so only
    those are compared; an item is decided once the lower ones of its sets are, many items a round.
    """
    rows = staged(members.filter(F.col("set").isNotNull() & F.col("item").isNotNull()).select("set", "item", "score").distinct(), "members")
    last = rows.groupBy("set").agg(F.max(F.struct("score", "item")).alias("l")).select("set", F.col("l.item").alias("last"))
    last = staged(last, "last")
    able = last.select(F.col("last").alias("item")).distinct()
    lower = staged(rows.join(last, "set").filter("item <> last").join(able, "item", "left_semi").select("set", "last", "item"), "lower")
    state = staged(able.withColumn("state", F.lit("open")), "state")
    while state.filter("state = 'open'").limit(1).count():
        seen = lower.join(state, "item").groupBy("set", "last").agg(F.max(F.col("state") == "kept").alias("kept"), F.max(F.col("state") == "open").alias("open"))
        sets = last.join(seen, ["set", "last"], "left").select(F.col("last").alias("item"), F.coalesce("kept", F.lit(False)).alias("kept"), F.coalesce("open", F.lit(False)).alias("open"))
        found = sets.groupBy("item").agg(F.max(~F.col("kept") & ~F.col("open")).alias("alone"), F.min("kept").alias("covered"))
        state = staged(found.select("item", F.when(F.col("alone"), "kept").when(F.col("covered"), "gone").otherwise("open").alias("state")), "state")
    return state.filter("state = 'kept'").select("item")
