"""Scans along the order of a key without one task for a key: ranges of a key are summed up, and the sums are passed on.

What a range does to what comes after it is a small map from the state at its entry to the state at its exit: add a number, raise a
maximum, replace the last row, merge a list of the best. Such maps compose, so each range's entry state is the composition
of the ranges before it; a second pass over the rows starts from there. A key with a third of all rows is many ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalfold.operators.logs import raised
from evalfold.sources.staging import free_name, staged


def scanned(rows: DataFrame, keys: list[str], order: list[str], number: str | None = None, sums: dict[str, Column] | None = None, most: dict[str, Column] | None = None, before: dict[str, str] | None = None, chunk: Column | None = None) -> DataFrame:
    """`rows` with, along `order` within `keys`: `number` (from 1), running `sums` and maxima (`most`; each with the row itself), and
    `before` (new column: column) of the row before (null at the first).

    chunk: a column that never falls along `order`, of groups of many rows (such as a dense number by ten thousands). None cuts the
    rows, sorted, into ranges of about one size and writes them. `order` must be total. Null keys are a group; a null order
    comes first; null amounts add nothing.
    """
    sums, most, before = dict(sums or {}), dict(most or {}), dict(before or {})
    if number is not None:
        sums[number] = F.lit(1).cast("long")
    part, last, starts_ = (free_name(rows, x) for x in ("part", "last", "starts"))
    amounts = {n: free_name(rows, f"{n}_amount") for n in [*sums, *most]}
    r = rows.withColumns({amounts[n]: x for n, x in (sums | most).items()})
    r = staged(r.repartitionByRange(*keys, *order).withColumn(part, F.spark_partition_id()), "scan") if chunk is None else r.withColumn(part, chunk)
    row = F.struct(F.lit(True).alias("is_row"), *(F.col(c).alias(n) for n, c in before.items()))
    totals = r.groupBy(*keys, part).agg(*(F.sum(amounts[n]).alias(n) for n in sums), *(F.max(amounts[n]).alias(n) for n in most), F.max_by(row, F.struct(*order)).alias(last))
    along = Window.partitionBy(*keys).orderBy(part)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    entry = totals.select(*keys, part, F.struct(*(F.sum(n).over(earlier).alias(n) for n in sums), *(F.max(n).over(earlier).alias(n) for n in most), F.lag(last).over(along).alias(last)).alias(starts_))
    entry = entry.filter(F.col(f"{starts_}.{last}").isNotNull())  # ranges that go on with a key: without `chunk`, one a range at most
    entry = entry if chunk is not None else F.broadcast(entry)
    here = Window.partitionBy(*keys, part).orderBy(*order)
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    own = {n: F.sum(amounts[n]).over(upto) for n in sums} | {n: F.max(amounts[n]).over(upto) for n in most}
    held = {n: free_name(rows, f"{n}_own") for n in own}
    lagged = free_name(rows, "lagged")
    r = r.withColumns({held[n]: x for n, x in own.items()} | ({lagged: F.lag(row).over(here)} if before else {}))
    renamed = {c: free_name(r, f"{c}_of") for c in [*keys, part]}
    on = F.lit(True)
    for c, other in renamed.items():
        on = on & F.col(c).eqNullSafe(F.col(other))
    out = r.join(entry.withColumnsRenamed(renamed), on, "left")
    start = lambda n: F.col(f"{starts_}.{n}")
    new = {n: raised(start(n), F.col(held[n])) for n in sums} | {n: F.greatest(start(n), held[n]) for n in most}
    new |= {n: F.coalesce(F.col(lagged), start(last))[n] for n in before}
    return out.withColumns(new).drop(part, starts_, lagged, *renamed.values(), *held.values(), *amounts.values())


def best_before(states: DataFrame, node: str, by: list[str], most: int, fan: int = 8, keys: list[str] | None = None) -> DataFrame:
    """For each node (a number from 0, within `keys`), the `most` best of all nodes before it: rows (*keys, node, item, *by), by the highest `by`.

    states: keys, node, item and by, the best of each node itself, one row for an item; a node of no rows is simply not there. An item's
    best row counts. Up a tree of `fan` nodes to one, states are merged; down it, a node gets its parent's entry state and those of
    its elder siblings. So a state goes to `fan` nodes a level, whatever the number of nodes.
    """
    at, order = [*(keys or []), node], [F.col(c).desc() for c in by]
    columns = [*at, "item", *by]

    def top(rows: DataFrame) -> DataFrame:
        best = rows.groupBy(*at, "item").agg(F.max(F.struct(*by)).alias("b")).select(*at, "item", "b.*")
        nth = free_name(rows, "nth")
        return best.withColumn(nth, F.row_number().over(Window.partitionBy(*at).orderBy(*order, "item"))).filter(F.col(nth) <= most).select(*columns)

    levels = [staged(states.select(*columns), "states")]
    nodes = levels[0].agg(F.max(node)).first()[0]
    while nodes:
        levels.append(staged(top(levels[-1].withColumn(node, F.floor(F.col(node) / fan))), "merged"))
        nodes //= fan
    entry = None
    for own in reversed(levels[:-1]):
        to = free_name(own, "to")
        moved = lambda rows: rows.withColumn(node, F.col(to)).select(*columns)
        later = moved(own.withColumn(to, F.explode(F.expr(f"filter(sequence({node}, {node} - {node} % {fan} + {fan - 1}), t -> t > {node})"))))
        if entry is not None:
            later = later.unionByName(moved(entry.withColumn(to, F.explode(F.expr(f"sequence({node} * {fan}, {node} * {fan} + {fan - 1})")))))
        entry = staged(top(later), "entry")
    return entry if entry is not None else levels[0].limit(0)
