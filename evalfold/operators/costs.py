"""Spend and call accounting where an unknown amount is null, never zero.

Sums are null-strict: one unknown part makes the whole unknown. All are partial aggregations; nothing but counts and sums moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalfold.operators.aggregates import count_if


def strict_sum(x: Column, digits: int | None = None) -> Column:
    """The sum of a group if every row has a value and there is one at least, else null."""
    total = F.sum(x) if digits is None else F.round(F.sum(x), digits)
    return F.when((F.count(x) == F.count(F.lit(1))) & (F.count(F.lit(1)) > 0), total)


def classified(rows: DataFrame) -> DataFrame:
    """Cost rows with `use`: cached, dropped or billable.

    A cache hit is cached whatever else it is. A row without any telemetry is dropped if it is missing, or if it failed
    without an answer of the provider. Every other row is billable.
    """
    bare = F.col("prompt_tokens").isNull() & F.col("completion_tokens").isNull() & F.col("provider_cost").isNull()
    return rows.withColumn("use", F.when(F.col("cache_hit"), "cached").when(bare & F.col("missing"), "dropped").when(bare & F.col("failed") & ~F.col("response_rejected"), "dropped").otherwise("billable"))


def role_cost(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Calls, tokens, priced and unpriced calls, cached rows; usd is null unless every billable call (one at least) is priced."""
    billable = F.col("use") == "billable"
    cost = F.when(billable, F.col("provider_cost"))
    both = F.col("prompt_tokens").isNotNull() & F.col("completion_tokens").isNotNull()
    out = rows.groupBy(*keys).agg(
        count_if(billable).alias("calls"), count_if(F.col("use") == "cached").alias("cached"), count_if(billable & F.col("provider_cost").isNotNull()).alias("priced"),
        count_if(billable & ~both).alias("missing_breakdown"), F.sum(F.when(billable & both, F.col("prompt_tokens"))).alias("prompt_tokens"),
        F.sum(F.when(billable & both, F.col("completion_tokens"))).alias("completion_tokens"), F.round(F.sum(cost), 2).alias("_usd"),
    )
    out = out.withColumn("unpriced", F.col("calls") - F.col("priced"))
    return out.withColumn("usd", F.when((F.col("unpriced") == 0) & (F.col("calls") > 0), F.col("_usd"))).drop("_usd")


def call_telemetry(attempts: DataFrame) -> DataFrame:
    """Each call's attempts, billed tokens and cost (accepted and rejected answers only), and the accepted attempt's latency.

    Latency is that of the first accepted attempt, else of the last one, and never negative.
    """
    billed = attempts.filter(F.col("outcome").isin("accepted", "rejected")).groupBy("logical_call_id").agg(
        strict_sum(F.col("prompt_tokens")).alias("prompt_tokens"), strict_sum(F.col("completion_tokens")).alias("completion_tokens"), strict_sum(F.col("cost"), 2).alias("cost"),
    )
    latency = F.col("ended_at") - F.col("started_at")
    every = attempts.groupBy("logical_call_id").agg(
        F.count(F.lit(1)).alias("n_attempts"), F.min_by(latency, F.when(F.col("outcome") == "accepted", F.col("attempt_number"))).alias("_accepted"),
        F.max_by(latency, F.col("attempt_number")).alias("_last"), F.max(F.col("outcome") == "accepted").alias("_any"),
    )
    out = every.withColumn("latency", F.round(F.greatest(F.lit(0.0), F.when(F.col("_any"), F.col("_accepted")).otherwise(F.col("_last"))), 9)).drop("_accepted", "_last", "_any")
    return out.join(billed, "logical_call_id", "left")


def retry_summary(attempts: DataFrame, retryable: list[str], most: int) -> DataFrame:
    """Each call's attempts up to the first that ends it: accepted, not to be retried, or the last allowed."""
    w = Window.partitionBy("logical_call_id").orderBy("attempt_number")
    ends = ~F.col("outcome").isin(*retryable) | (F.col("attempt_number") >= most)
    cut = attempts.withColumn("_before", F.coalesce(F.sum(ends.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter("_before = 0")
    return cut.groupBy("logical_call_id").agg(
        F.count(F.lit(1)).alias("n_used"), F.max_by("outcome", "attempt_number").alias("final_outcome"), F.max(F.col("outcome") == "rate-limit").alias("rate_limited"),
    )
