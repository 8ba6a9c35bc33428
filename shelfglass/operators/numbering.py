"""Running numbers computed in two levels, so no window holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfglass.operators.joins import null_safe_join
from shelfglass.staging import stage


def running_number(distinct: DataFrame, keys: Sequence[str], column: str, bucket: Column,
                   name: str) -> DataFrame:
    """1-based number of each row in ascending ``column`` within ``keys``.

    Rows must be distinct in (keys, column) and ``bucket`` must be monotone in ``column``. Bucket
    sizes give the offsets; rows are numbered inside their bucket only.
    """
    keys = list(keys)
    bucketed = distinct.withColumn("_bucket", bucket)
    sizes = bucketed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_bucket")
    offsets = sizes.select(
        *keys, "_bucket", (F.sum("_size").over(before) - F.col("_size")).alias("_before")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(column)
    return (
        null_safe_join(bucketed, offsets, [*keys, "_bucket"])
        .withColumn(name, (F.row_number().over(inside) + F.col("_before")).cast("bigint"))
        .drop("_bucket", "_before")
    )


#: Bits of ``_at`` that hold a row's position in its range; the range's number is above them.
POSITION_BITS = 33


def sorted_ranges(rows: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """A staged copy in order, with ``_at``: rows are dealt to ranges of the order, one per task and
    file, and sorted there; ``_at`` grows with the order and is read like an index."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(ordered.withColumn("_at", F.monotonically_increasing_id()), "ordered")


def range_sizes(placed: DataFrame) -> DataFrame:
    """(_range, _size) of the ranges of ``sorted_ranges``: at most one row per task."""
    return placed.groupBy(F.shiftright("_at", POSITION_BITS).alias("_range")).agg(
        F.count(F.lit(1)).alias("_size"))


def number_in_order(rows: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """1-based position of every row in the order of the columns, for any number of rows.

    A row's number is its position in its range behind the rows of all ranges before. Only the sizes
    of the ranges are ordered in one place, and no range depends on how many rows share a prefix.
    """
    placed = sorted_ranges(rows, order)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = range_sizes(placed).select(
        "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    own = F.col("_at").bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    return placed.withColumn("_range", F.shiftright("_at", POSITION_BITS)).join(
        F.broadcast(offsets), "_range").withColumn(  # one row per task
        name, F.col("_before") + own + 1).drop("_range", "_before", "_at")


def id_bucket(column: str) -> Column:
    """Blocks of 65 536 consecutive ids."""
    return F.floor(F.col(column) / 65536)


def text_bucket(column: str, letters: int = 2) -> Column:
    """Leading letters; at most one bucket per prefix."""
    return F.substring(F.col(column), 1, letters)
