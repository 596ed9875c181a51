"""Seeded samples, splits and folds whose draws are hashes of keys, so that they don't depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalfold.operators.logs import join_null_safe, numbered
from evalfold.operators.scan import scanned
from evalfold.sources.staging import staged


def hash_order(*key: Column) -> Column:
    """A hash to order rows by: as good as a shuffle, and the same everywhere."""
    return F.md5(F.concat_ws("|", *(k.cast("string") for k in key)).cast("binary"))


def sample_within(rows: DataFrame, keys: list[str], order: Column, n: int) -> DataFrame:
    """The first `n` rows of each group by `order` (a sampling operator), with their place from 1."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("long")).filter(F.col("nth") <= n)


def tail_split(rows: DataFrame, keys: list[str], order: str, share: float, most: int) -> DataFrame:
    """`rows` with `part`: the last `share` of each group (one row to `most`) validates, the others train.

    Null keys are a group; rows without an order come first in theirs.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    size = F.least(F.lit(most), F.greatest(F.lit(1), F.floor(F.col("_n") * share)))
    placed = join_null_safe(numbered(rows, keys, F.floor(F.col(order) / 10_000), [order], "_place"), sizes, keys)
    return placed.withColumn("part", F.when(F.col("_place") > F.col("_n") - size, "val").otherwise("train")).drop("_n", "_place")


def fold_attempts(rows: DataFrame, cap: int, errors: int) -> DataFrame:
    """Bootstrap folds: (group_id, n_used, n_accepted, n_errors, status) of each group's outcomes in order.

    A fold ends when `cap` outcomes were accepted (full) or `errors` failed (aborted); what comes later isn't used. The
    end is a running count, passed on from range to range of a group.
    """
    of = lambda kind: (F.col("outcome") == kind).cast("long")
    counted = scanned(rows, ["group_id"], ["ordinal"], sums={"_a": of("accept"), "_e": of("error")})
    live = counted.filter((F.col("_a") - of("accept") < cap) & (F.col("_e") - of("error") < errors))
    accepted, failed = F.count_if(F.col("outcome") == "accept"), F.count_if(F.col("outcome") == "error")
    return live.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_used"), accepted.alias("n_accepted"), failed.alias("n_errors"), F.when(accepted >= cap, "full").when(failed >= errors, "aborted").otherwise("open").alias("status"))


def fold_summaries(rows: DataFrame, most: int) -> DataFrame:
    """(group_id, ordinal, call, outcome, stage) of each group's replies in order of call (from 1), up to the one that ends the fold.

    A failed reply ends it; a later reply that only says complete is skipped, and `most` of those end it; the others are
    accepted. stage is what follows: without a first summary the proposals go on unaware of the data.
    """
    skip = (F.col("call") > 1) & ~F.col("failed") & F.col("complete")
    failed = F.col("failed").cast("long")
    r = scanned(rows, ["group_id"], ["call"], sums={"_skips": skip.cast("long"), "_fails": failed}, chunk=F.floor(F.col("call") / 10_000))
    r = r.withColumn("_skips", F.col("_skips") - skip.cast("long"))
    live = r.filter((F.col("_skips") < most) & (F.col("_fails") - failed == 0))
    outcome = F.when(F.col("failed"), "failed").when(skip, "skipped").otherwise("accepted")
    stage = F.when(F.col("failed") & (F.col("call") == 1), "proposal_select").when(F.col("failed") | (skip & (F.col("_skips") == most - 1)), "dataset_final").otherwise("dataset_followup")
    return live.select("group_id", "ordinal", "call", outcome.alias("outcome"), stage.alias("stage"))


def instruction_pools(slots: DataFrame) -> DataFrame:
    """(component, slot, instruction, pool_index) of proposals (component, slot from 0, original, proposed, failed, invalid).

    Slot 0 holds the original whatever was proposed; an invalid proposal leaves no entry; nothing from the first failed
    slot on counts. Entries are rows, numbered in order of slot.
    """
    ends = slots.filter("failed").groupBy("component").agg(F.min("slot").alias("_end"))
    live = slots.join(ends, "component", "left").filter(F.col("_end").isNull() | (F.col("slot") < F.col("_end")))
    pool = live.filter((F.col("slot") == 0) | ~F.col("invalid")).select("component", "slot", F.when(F.col("slot") == 0, F.col("original")).otherwise(F.col("proposed")).alias("instruction"))
    return numbered(pool, ["component"], F.floor(F.col("slot") / 10_000), ["slot"], "pool_index").withColumn("pool_index", F.col("pool_index") - 1)


def demo_plans(rows: DataFrame, sets: int, most: int, seed: int) -> DataFrame:
    """(component, set_index, nth, item, bootstrapped): the demos of each few-shot plan, as rows.

    rows: component, item, bootstrapped. Set -3 is empty, so it has no row; -2 holds the first `most` labels, -1 the first
    `most` bootstrapped demos; each later set takes 1 to `most` bootstrapped demos in an order of its own, and labels, sampled in an order
    of its own, up to `most` in all. Orders and numbers are hashes of seed, set, component and item.
    """
    plans = rows.withColumn("set_index", F.explode(F.sequence(F.lit(-2).cast("long"), F.lit(sets - 1).cast("long"))))
    plans = plans.filter(~((F.col("set_index") == -2) & F.col("bootstrapped")) & ~((F.col("set_index") == -1) & ~F.col("bootstrapped")))
    own = hash_order(F.lit(seed), F.col("set_index"), F.col("component"), F.col("item"))
    first = F.when(F.col("set_index") >= 0, own).otherwise(F.lpad(F.col("item").cast("string"), 20, "0"))
    plans = plans.withColumn("_order", first)
    kept = plans.withColumn("place", F.row_number().over(Window.partitionBy("component", "set_index", "bootstrapped").orderBy("_order", "item"))).filter(F.col("place") <= most)
    number = hash_order(F.lit(seed), F.lit("size"), F.col("set_index"), F.col("component"))
    size = F.when(F.col("set_index") >= 0, 1 + F.conv(F.substring(number, 1, 8), 16, 10).cast("long") % most).otherwise(most)
    kept = kept.filter(~F.col("bootstrapped") | (F.col("place") <= size))  # at most 2 * most rows of a plan go on
    nth = F.row_number().over(Window.partitionBy("component", "set_index").orderBy(F.col("bootstrapped").desc(), "place"))
    return kept.withColumn("nth", nth.cast("long")).filter(F.col("nth") <= most).select("component", "set_index", "nth", "item", "bootstrapped")


def narrowing_demo_sets(augmented: DataFrame, labelled: DataFrame, components: list[str], most_augmented: int, most: int, seed: int) -> DataFrame:
    """(component, nth, item, bootstrapped): each component's first bootstrapped demos, filled up with sampled labels.

    augmented: component, item, in order of item; labelled: item. The first component's labels are sampled from all, each
    later one's from the sample before it, so the remainder narrows. A component's size is read before the next sample.
    """
    out, rest = None, labelled.select("item")
    for c in components:
        own = sample_within(augmented.filter(F.col("component") == c), ["component"], F.lpad(F.col("item").cast("string"), 20, "0"), most_augmented)
        own = staged(own.select("component", "nth", "item", F.lit(True).alias("bootstrapped")), "augmented")
        n = own.count()  # at most `most_augmented`
        rest = rest.withColumn("component", F.lit(c))
        rest = staged(sample_within(rest, ["component"], hash_order(F.lit(seed), F.lit(c), F.col("item")), max(0, most - n)), "labels")
        both = own.unionByName(rest.select("component", (F.col("nth") + n).alias("nth"), "item", F.lit(False).alias("bootstrapped")))
        out = both if out is None else out.unionByName(both)
        rest = rest.select("item")
    return out
