"""Running sums over a long ordered list, in two levels, so that no task orders all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_sums(rows: DataFrame, keys: list[str], group: str, order: str,
                 sums: dict[str, str]) -> DataFrame:
    """Add ``{new: column}`` sums over the rows of the same keys that come before.

    ``group`` must not decrease with ``order``; a group's rows, and a key's groups, are ordered
    in one task each.
    """
    above = Window.partitionBy(*keys).orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(*keys, group).orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, group).agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    totals = totals.select(*keys, group, *(
        F.coalesce(F.sum(f"_{n}").over(above), F.lit(0)).alias(f"_{n}") for n in sums))
    return rows.withColumns({
        n: F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()}).join(
        totals, [*keys, group]).withColumns(
        {n: F.col(n) + F.col(f"_{n}") for n in sums}).drop(*(f"_{n}" for n in sums))
