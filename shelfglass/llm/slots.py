"""A coarse filter whose size does not grow with the data, to spare rows a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots: the most rows that are broadcast.
SLOTS = 1 << 20


def slot(*key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(SLOTS))


def slots_of(rows: DataFrame, *key: Column) -> DataFrame:
    """The slots that hold a key of ``rows``: at most ``SLOTS`` rows, so they may be broadcast."""
    return F.broadcast(rows.select(slot(*key).alias("slot")).distinct())
