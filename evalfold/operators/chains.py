"""Chains of steps that each point to the one before them, followed by doubling the distance walked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalfold.operators.logs import numbered
from evalfold.sources.staging import staged


def walk(steps: DataFrame) -> DataFrame:
    """(step, depth, root) of every step (step, prior: longs; a root has no prior).

    As many rounds as the longest chain's logarithm; each is written before the next. A chain that comes back to itself, or that
    leads to a step that isn't there, fails.
    """
    known = staged(steps.select("step", F.coalesce("prior", "step").alias("at"), F.col("prior").isNotNull().cast("long").alias("depth")), "walk")
    roots = staged(steps.filter("prior IS NULL").select(F.col("step").alias("at")), "roots")
    most, walked = known.count(), 1
    while not (open_ := known.join(roots, "at", "left_anti")).isEmpty():
        lost = open_.filter("at IS NULL").limit(1).collect()
        if lost:
            raise ValueError(f"the chain of step {lost[0]['step']} leads to a step that isn't there")
        if walked > most:
            raise ValueError("a chain of steps comes back to itself")
        on = known.select(F.col("step").alias("at"), F.col("at").alias("_next"), F.col("depth").alias("_more"))
        known = staged(known.join(on, "at", "left").select("step", F.col("_next").alias("at"), (F.col("depth") + F.col("_more")).alias("depth")), "walk")
        walked *= 2
    return known.select("step", "depth", F.col("at").alias("root"))


def spans(steps: DataFrame) -> DataFrame:
    """(step, enter, leave) in a walk around each tree of steps: what follows from a step lies between its two numbers.

    The walk enters a step, its followers in order, and leaves it. Each of the two stops knows the next; the distance to the end
    comes by doubling, as many rounds as the logarithm of a tree's size.
    """
    w = Window.partitionBy("prior").orderBy("step")
    first = steps.filter("prior IS NOT NULL").groupBy(F.col("prior").alias("step")).agg(F.min("step").alias("_first"))
    sibling = F.when(F.col("prior").isNotNull(), F.lead("step").over(w))
    s = steps.withColumn("_sibling", sibling).join(first, "step", "left")
    enter = F.struct((F.col("step") * 2).alias("stop"), F.coalesce(F.col("_first") * 2, F.col("step") * 2 + 1).alias("next"))
    leave = F.struct((F.col("step") * 2 + 1).alias("stop"), F.coalesce(F.col("_sibling") * 2, F.col("prior") * 2 + 1).alias("next"))
    stops = staged(s.select(F.inline(F.array(enter, leave))).withColumn("left", F.col("next").isNotNull().cast("long")), "stops")
    while not stops.filter("next IS NOT NULL").isEmpty():
        on = stops.select(F.col("stop").alias("next"), F.col("next").alias("_next"), F.col("left").alias("_left"))
        stops = staged(stops.join(on, "next", "left").select("stop", F.col("_next").alias("next"), (F.col("left") + F.coalesce("_left", F.lit(0))).alias("left")), "stops")
    place = lambda k: F.max(F.when(F.pmod("stop", F.lit(2)) == k, -F.col("left")))
    return stops.groupBy(F.floor(F.col("stop") / 2).alias("step")).agg(place(0).alias("enter"), place(1).alias("leave"))


def owed(steps: DataFrame, evidence: DataFrame) -> DataFrame:
    """(step, evidence), once each, that no step before it in its chain has recorded.

    Of the steps of a tree that cite one evidence, in order of entering, one that lies inside another leaves before the furthest
    one so far: a running maximum over ranges, so evidence that very many steps cite is no pair of each two of them.
    """
    own = evidence.select("step", "evidence").distinct().join(walk(steps).select("step", "root"), "step").join(spans(steps), "step")
    furthest = numbered(own, ["evidence", "root"], None, ["enter"], "furthest", "leave", F.max)
    return furthest.filter(F.col("furthest") == F.col("leave")).select("step", "evidence")
