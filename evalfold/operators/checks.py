"""Invariants as DataFrames of what violates them; an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_exclusive(rows: DataFrame) -> DataFrame:
    """Rows that aren't exactly one of scored, missing, failed, invalid."""
    flags = sum((F.col(c).cast("int") for c in ("missing", "failed", "invalid")), F.col("score").isNotNull().cast("int"))
    return rows.filter(flags != 1)


def unplanned(plan: DataFrame, observed: DataFrame) -> DataFrame:
    """Observed trials that aren't planned, or that occur more than once."""
    keys = ["candidate_id", "task_id", "seed_index"]
    twice = observed.groupBy(*keys).count().filter("count > 1").select(*keys)
    return observed.select(*keys).join(plan.select(*keys), keys, "left_anti").unionByName(twice)


def not_contiguous(rows: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Groups whose indexes aren't 0..n-1, each once: n and one more than the largest index."""
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.max(index) + 1).alias("expected"), F.min(index).alias("_least"), F.count_distinct(index).alias("_distinct"))
    return found.filter((F.col("n") != F.col("expected")) | (F.col("_least") != 0) | (F.col("_distinct") != F.col("n"))).drop("_least", "_distinct")
