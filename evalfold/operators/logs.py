"""Ordered logs: latest events, transitions, admission, barriers, and totals along a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalfold.sources.staging import free_name, staged


def latest(log: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Each key's last event, by aggregation: one partial row for each key and task is shuffled, not the log."""
    return log.groupBy(*keys).agg(F.max(F.struct(order, *columns)).alias("l")).select(*keys, "l.*")


def admitted(ledger: DataFrame, capacity: int) -> DataFrame:
    """Calls with `accepted` and, if so, their one-based `capacity_ordinal` within the scope."""
    ok = F.col("arrival") <= capacity
    return ledger.withColumn("accepted", ok).withColumn("capacity_ordinal", F.when(ok, F.col("arrival")))


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The inner join on columns of both, where a null meets a null, with the columns of `left` and the others of `right`."""
    renamed = {c: free_name(left, f"{c}_of") for c in on}
    condition = F.lit(True)
    for c, other in renamed.items():
        condition = condition & F.col(c).eqNullSafe(F.col(other))
    return left.join(right.withColumnsRenamed(renamed), condition).drop(*renamed.values())


def raised(before, own):
    """A running sum: what came before, and the sum from there; null as long as both are."""
    return F.when(before.isNull(), own).when(own.isNull(), before).otherwise(before + own)


def numbered(rows: DataFrame, keys: list[str], chunk, order: list, name: str, value: str | None = None, combine=F.sum) -> DataFrame:
    """`rows` with `name`: their number from 1 within `keys` by `order` (or, with `value`, the running sum of it, or what `combine`
    makes of it: F.sum or F.max).

    chunk: a column that never falls along `order`, such as a day or a range of ids. Rows are numbered within (keys, chunk)
    and raised by what the key's earlier chunks hold, so a key with a third of all rows is spread over its chunks. None
    cuts the rows, sorted by keys and order, into ranges of about one size. No keys: all rows are one group. Every row comes
    back: null keys are one group, a null chunk comes first (as nulls do in an ascending order), and null values add nothing.
    """
    amount = F.lit(1).cast("long") if value is None else F.col(value)
    c, total, own, start = (free_name(rows, x) for x in ("chunk", "total_of", "own", "start"))
    if chunk is None:
        r = staged(rows.repartitionByRange(*keys, *order).withColumn(c, F.spark_partition_id()), "ranges")
    else:
        r = rows.withColumn(c, chunk)
    sums = r.groupBy(*keys, c).agg(combine(amount).alias(total))
    earlier = combine(total).over(Window.partitionBy(*keys).orderBy(c).rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(*keys, c, earlier.alias(start))
    here = combine(amount).over(Window.partitionBy(*keys, c).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    up = raised(F.col(start), F.col(own)) if combine is F.sum else F.greatest(start, own)
    return join_null_safe(r.withColumn(own, here), starts, [*keys, c]).withColumn(name, up).drop(c, start, own)


def fan_in(rows: DataFrame, keys: list[str], expected: int) -> DataFrame:
    """The barrier's resolution for each key: waiting, rejected, failed or complete."""
    n = F.count(F.lit(1))
    resolution = F.when(n < expected, "waiting").when(F.max("invalid"), "rejected").when(F.max("failed"), "failed").otherwise("complete")
    return rows.groupBy(*keys).agg(resolution.alias("resolution"), n.alias("n_rows"))


def running_total(rows: DataFrame, order: str, value: str, step: int = 10_000) -> DataFrame:
    """`rows` with `total`, the sum of `value` up to each row by the integer column `order`, without one task for all rows.

    Rows are dealt to ranges of `step` numbers; ranges are summed (a small table), and each range starts from the sum of
    those before it. Rows of equal order share their total; those without an order are a range of their own, before all others.
    Null values add nothing.
    """
    range_, sum_, coarse_, all_, inside_, from_, own = (free_name(rows, x) for x in ("range", "sum", "coarse", "all", "inside", "from", "own"))
    r = rows.withColumn(range_, F.floor(F.col(order) / step))
    sums = r.groupBy(range_).agg(F.sum(value).alias(sum_))
    coarse = sums.withColumn(coarse_, F.floor(F.col(range_) / step))
    above = coarse.groupBy(coarse_).agg(F.sum(sum_).alias(all_))
    start_above = above.select(coarse_, F.sum(all_).over(Window.orderBy(coarse_).rowsBetween(Window.unboundedPreceding, -1)).alias(from_))
    inside = F.sum(sum_).over(Window.partitionBy(coarse_).orderBy(range_).rowsBetween(Window.unboundedPreceding, -1))
    starts = join_null_safe(coarse.withColumn(inside_, inside), start_above, [coarse_]).select(range_, raised(F.col(from_), F.col(inside_)).alias(from_))
    here = r.withColumn(own, F.sum(value).over(Window.partitionBy(range_).orderBy(order)))
    return join_null_safe(here, starts, [range_]).withColumn("total", raised(F.col(from_), F.col(own))).drop(range_, from_, own)
