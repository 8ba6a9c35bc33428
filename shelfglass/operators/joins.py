"""Join helpers. No broadcast hints: sizes are judged by the planner and AQE at run time.

Computed arrays are the exception: before it runs, a plan counts one element for each, so a side of
token lists looks small enough for a broadcast when it fills the driver. Such joins shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfglass.staging import parallelism


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   how: str = "inner") -> DataFrame:
    """Join on equal keys where NULL equals NULL; keys come from the left side."""
    if not keys:
        return left.crossJoin(right) if how == "inner" else left.join(right, F.lit(True), how)
    renamed = right.select([F.col(c).alias(f"_r_{c}") if c in keys else F.col(c)
                            for c in right.columns])
    on = reduce(and_, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def join_prepared(rows: DataFrame, prepare: Callable[[DataFrame], DataFrame], others: DataFrame,
                  keys: Sequence[str] | str) -> DataFrame:
    """Inner join of ``prepare(rows)``, which adds computed arrays, with ``others``; neither side is
    broadcast, and AQE may split hot keys. The rows are dealt to all tasks before the costly
    preparation, since a small file is read by one or a few."""
    return prepare(rows.repartition(parallelism(rows.sparkSession))).hint("merge").join(others, keys)


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the greatest by ``order``; an aggregate, so hot keys combine map-side."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*df.columns)
