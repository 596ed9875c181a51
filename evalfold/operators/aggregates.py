"""Status-aware aggregation of planned trials: two-level means, row accounting, skip tolerance, rewards.

Every step is a grouped aggregation with partial (map-side) sums; only counts and sums are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OK, NOT_APPLICABLE, MISSING, ZERO = "ok", "not_applicable", "missing_data", "zero_denominator"


def count_if(condition: Column) -> Column:
    return F.count_if(condition).cast("long")


def with_status(df: DataFrame, keys: list[str], value: str, applicable: Column, reduction: str = "mean", propagate: bool = True) -> DataFrame:
    """Reduces `value` over each group to (value, status, n_total, n_applicable, n_present).

    Statuses in order: nothing applicable; an applicable null where nulls propagate; a sum is then ok (0.0 where empty);
    a mean of nothing present has a zero denominator.
    """
    present = applicable & F.col(value).isNotNull()
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_total"), count_if(applicable).alias("n_applicable"), count_if(present).alias("n_present"),
        F.coalesce(F.sum(F.when(present, F.col(value))), F.lit(0.0)).alias("_sum"),
    )
    status = F.when(F.col("n_applicable") == 0, NOT_APPLICABLE)
    if propagate:
        status = status.when(F.col("n_present") < F.col("n_applicable"), MISSING)
    if reduction == "mean":
        status = status.when(F.col("n_present") == 0, ZERO)
    reduced = F.col("_sum") if reduction == "sum" else F.try_divide("_sum", "n_present")
    out = out.withColumn("status", status.otherwise(OK))
    return out.withColumn("value", F.when(F.col("status") == OK, reduced)).drop("_sum")


def plan_expand(candidates: DataFrame, tasks: DataFrame, repeats: int) -> DataFrame:
    """The planned matrix: every candidate by every task by seeds 0..repeats-1. It is the result asked for, so its size is no waste."""
    return candidates.crossJoin(tasks).withColumn("seed_index", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(repeats - 1).cast("long"))))


def fill_missing(plan: DataFrame, observed: DataFrame) -> DataFrame:
    """Planned trials with what was observed; an unobserved trial is missing."""
    keys = ["candidate_id", "task_id", "seed_index"]
    return plan.join(observed.select(*keys, "state", "score"), keys, "left").withColumn("state", F.coalesce("state", F.lit("missing")))


def task_mean(rows: DataFrame, propagate: bool = True, max_skip: float | None = None) -> DataFrame:
    """Candidates' unweighted mean of task means, with status and the four row counts.

    Invalid rows aren't applicable; missing and failed rows are applicable without value. A task that isn't ok counts as an
    applicable task without value, one that isn't applicable is left out. With `max_skip`, a candidate whose share of
    rows that aren't scored is larger has missing data.
    """
    states = {s: count_if(F.col("state") == s).alias(f"n_{s}") for s in ("scored", "missing", "failed", "invalid")}
    per_task = with_status(rows, ["candidate_id", "task_id"], "score", F.col("state") != "invalid", propagate=propagate)
    over = with_status(per_task, ["candidate_id"], "value", F.col("status") != NOT_APPLICABLE, propagate=propagate)
    out = over.join(rows.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n_planned"), *states.values()), "candidate_id")
    if max_skip is not None:
        skipped = F.try_divide(F.col("n_missing") + F.col("n_failed") + F.col("n_invalid"), F.col("n_planned")) > max_skip
        out = out.withColumn("status", F.when(skipped, MISSING).otherwise(F.col("status"))).withColumn("value", F.when(~F.coalesce(skipped, F.lit(False)), F.col("value")))
    return out.select("candidate_id", F.round("value", 9).alias("value"), "status", "n_planned", "n_scored", "n_missing", "n_failed", "n_invalid")


def row_accounting(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Planned rows and rows by state of each group."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("planned"), *(count_if(F.col("state") == s).alias(s) for s in ("scored", "missing", "failed", "invalid")))


def per_task_dense(rows: DataFrame, repeats: int) -> DataFrame:
    """Each task's score with rows that aren't scored as 0, over all repeats: not the status-aware mean."""
    return rows.groupBy("candidate_id", "task_id").agg(F.round(F.sum(F.coalesce("score", F.lit(0.0))) / repeats, 9).alias("score"), F.count(F.lit(1)).alias("n"))


def finite(x: Column) -> Column:
    """The number, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def reward(aggregates: DataFrame, terms: DataFrame, policy: str, worst: float = 0.0) -> DataFrame:
    """Each candidate's sum of weight * sign * value over the reward terms (metric, weight, sign), of which there are few.

    A missing value: `fail` makes the reward null, `worst_value` counts as `worst`, `skip` as 0. Only terms that a candidate
    has are joined to it; what its missing ones would add follows from the sums over all terms.
    """
    n, total = terms.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("weight") * F.col("sign")), F.lit(0.0))).first()
    own = F.col("weight") * F.col("sign")
    value = F.when(own.isNotNull(), finite(F.col("value")))
    by = aggregates.select("candidate_id", "metric", "value").join(terms, "metric", "left").groupBy("candidate_id").agg(
        F.coalesce(F.sum(own * value), F.lit(0.0)).alias("_sum"), F.count(value).alias("_n"), F.coalesce(F.sum(F.when(value.isNotNull(), own)), F.lit(0.0)).alias("_held"),
    )
    filled = {"fail": F.when(F.col("_n") == n, F.col("_sum")), "worst_value": F.col("_sum") + (F.lit(float(total)) - F.col("_held")) * worst, "skip": F.col("_sum")}[policy]
    return by.select("candidate_id", F.round(filled, 9).alias("reward"), (F.lit(n) - F.col("_n")).cast("long").alias("n_missing_terms"))
