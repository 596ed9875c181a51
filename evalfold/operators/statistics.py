"""Bootstrap intervals, multiple comparisons, variance split and power, by column arithmetic.

Random draws are hashes of their keys, so every engine and partitioning agrees; resampling itself is in `resampling`.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalfold.operators.logs import join_null_safe, numbered
from evalfold.sources.staging import free_name


def hex_number(hash_: Column, digits: int = 8) -> Column:
    """The first `digits` hexadecimal digits of a hash as a number."""
    return F.conv(F.substring(hash_, 1, digits), 16, 10).cast("long")


def draw(n: Column, *key: Column) -> Column:
    """A number from 0 to n - 1 that depends on the key only."""
    return F.pmod(hex_number(F.md5(F.concat_ws("|", *(k.cast("string") for k in key)).cast("binary"))), n)


def holm(rows: DataFrame, p: str, order: str, within: list[str]) -> DataFrame:
    """`rows` with `rank`, and `adjusted`: Holm's step-down p-values within each family; ties keep the order given.

    A value that is null, NaN or outside [0, 1] fails. A large family is ranked, and its running maximum taken, over ranges of p.
    """
    m, scaled = free_name(rows, "family_size"), free_name(rows, "scaled")
    known = F.when(F.col(p).between(0, 1), F.col(p)).otherwise(F.raise_error(F.concat(F.lit("not a p-value: "), F.coalesce(F.col(p).cast("string"), F.lit("null")))).cast("double"))
    ranked = numbered(rows.withColumn(p, known), within, None, [p, order], "rank")
    sizes = ranked.groupBy(*within).agg(F.count(F.lit(1)).alias(m))
    ranked = join_null_safe(ranked, sizes, within).withColumn(scaled, F.least(F.lit(1.0), F.col(p) * (F.col(m) - F.col("rank") + 1)))
    return numbered(ranked, within, F.floor(F.col("rank") / 10_000), ["rank"], "adjusted", scaled, F.max).drop(m, scaled)


def interval(means: DataFrame, points: DataFrame, keys: list[str], resamples: int, level: float = 0.95) -> DataFrame:
    """keys, point, low, high, p, excludes_zero: order statistics without interpolation; one value alone is degenerate (p = 1)."""
    tail = (1 - level) / 2
    low, high = int(tail * resamples), min(resamples - 1, int((1 - tail) * resamples))
    sorted_ = means.withColumn("mean", F.round("mean", 9)).withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy("mean", "resample")) - 1)
    by = sorted_.groupBy(*keys).agg(
        F.max(F.when(F.col("at") == low, F.col("mean"))).alias("low"), F.max(F.when(F.col("at") == high, F.col("mean"))).alias("high"),
        (F.count_if(F.col("mean") <= 0) / resamples).alias("below"), (F.count_if(F.col("mean") >= 0) / resamples).alias("above"),
    )
    p = F.least(F.lit(1.0), F.greatest(F.lit(1.0 / resamples), 2 * F.least("below", "above")))
    out = by.join(points, keys).withColumn("p", F.when(F.col("n") == 1, 1.0).otherwise(F.round(p, 9)))
    out = out.withColumn("low", F.when(F.col("n") == 1, F.col("point")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("n") == 1, F.col("point")).otherwise(F.col("high")))
    return out.select(*keys, "n", F.round("point", 9).alias("point"), F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), "p", ((F.col("low") > 0) | (F.col("high") < 0)).alias("excludes_zero"))


def decompose_variance(pairs: DataFrame, keys: list[str], repeats: int) -> DataFrame:
    """Variance of paired task scores (naive, ceiling): base rate, within, between and interaction, and whether noise dominates."""
    rate = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.avg("naive")))
    noise = (F.avg(F.col("naive") * (1 - F.col("naive"))) + F.avg(F.col("ceiling") * (1 - F.col("ceiling")))) / 2
    var = lambda x: F.coalesce(F.var_samp(x), F.lit(0.0))
    by = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), rate.alias("base_rate"), noise.alias("noise"), var(F.col("naive")).alias("v"), var(F.col("ceiling") - F.col("naive")).alias("d"))
    within = F.col("base_rate") * (1 - F.col("base_rate"))
    between = F.greatest(F.lit(0.0), F.col("v") - F.col("noise") / repeats)
    interaction = F.greatest(F.lit(0.0), F.col("d") - 2 * F.col("noise") / repeats)
    return by.select(*keys, "n", F.round("base_rate", 9).alias("base_rate"), F.round(within, 9).alias("within"), F.round(between, 9).alias("between"), F.round(interaction, 9).alias("interaction"), (within > between).alias("noisy"))


def multiplier(alpha: float = 0.05, power: float = 0.80, two_sided: bool = True) -> float:
    """The sum of normal quantiles that a detectable difference is measured in."""
    z = NormalDist().inv_cdf
    return z(1 - alpha / 2 if two_sided else 1 - alpha) + z(power)


def detectable(tasks: Column, repeats: Column, within: Column, interaction: Column, factor: float) -> Column:
    """The least difference that `tasks` tasks of `repeats` repeats detect."""
    return factor * F.sqrt(F.greatest(F.lit(0.0), interaction + 2 * within / repeats) / tasks)
