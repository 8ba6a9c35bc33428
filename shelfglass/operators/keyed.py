"""Keyed table changes as DataFrame -> DataFrame transitions (new state, nothing in place)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfglass.operators.numbering import number_in_order


def first_per_key(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key, the earliest in ``order``; an aggregate, so copies combine map-side."""
    rest = [c for c in rows.columns if c not in keys]
    kept = F.min_by(F.struct(*rest), F.col(order)).alias("_row")
    return rows.groupBy(*keys).agg(kept).select(*keys, "_row.*").select(*rows.columns)


def one_per_key(rows: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """One row per key: the last in ``order``, by default the greatest by its columns. Rows with a
    NULL in the key match nothing, so all of them stay."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        known = rows.na.drop(subset=list(keys))
        return known.distinct().unionByName(rows.filter(_unknown(keys)))
    row = F.struct(*rest)
    alone = F.when(_unknown(keys), F.monotonically_increasing_id())
    best = F.max_by(row, F.struct(order, row)) if order else F.max(row)
    return rows.withColumn("_alone", alone).groupBy(*keys, "_alone").agg(
        best.alias("_row")).select(*keys, "_row.*").select(*rows.columns)


def _unknown(keys: Sequence[str]) -> Column:
    return reduce(or_, [F.col(k).isNull() for k in keys])


def merge(base: DataFrame, rows: DataFrame, keys: Sequence[str],
          columns: Sequence[str] | None = None, *, update: bool = True, insert: bool = True,
          keep_on_null: Sequence[str] = (), order: str | None = None, unique: bool = False,
          flag: str | None = None) -> DataFrame:
    """Base rows with the same key updated in ``columns`` and the other rows inserted, in one join.

    ``columns`` (default: all of ``rows``) are overwritten, with NULL too unless they are among
    ``keep_on_null``. An inserted row takes all columns of ``rows``; those that ``base`` lacks are
    appended. NULL keys never match. Rows are
    first reduced to one per key, see ``one_per_key``, unless ``unique`` vouches for that. ``flag``
    names a column to add: ``inserted``, ``updated`` (matched) or ``kept``.

    A full outer join carries a mark of each side, so one shuffle serves update, insert and keep;
    without inserts it is a left join, which AQE may split on hot keys of the base.
    """
    keys = list(keys)
    columns = set(columns if columns is not None else [c for c in rows.columns if c not in keys])
    news = (rows if unique else one_per_key(rows, keys, order)).select(
        *[F.col(c).alias(f"_new_{c}") for c in rows.columns], F.lit(True).alias("_new"))
    old = base.withColumn("_old", F.lit(True))
    on = [F.col(k) == F.col(f"_new_{k}") for k in keys]
    both = old.join(news, on, "full" if insert else "left")
    hit, added = F.col("_new").isNotNull(), F.col("_old").isNull()

    def value(c: str) -> Column:
        if c not in rows.columns:
            return F.col(c)
        new = F.col(f"_new_{c}")
        if c not in base.columns:
            return F.when(added, new).alias(c)
        new = new.cast(base.schema[c].dataType)
        take = added | hit if update and c in columns and c not in keys else added
        if c in keep_on_null:
            take = take & (added | new.isNotNull())
        return F.when(take, new).otherwise(F.col(c)).alias(c)

    out = [value(c) for c in base.columns]
    if insert:
        out += [value(c) for c in rows.columns if c not in base.columns]
    if flag:
        out.append(F.when(added, "inserted").when(hit, "updated").otherwise("kept").alias(flag))
    return both.select(*out)


def apply_updates(base: DataFrame, updates: DataFrame, keys: Sequence[str],
                  columns: Sequence[str] | None = None, *, unique: bool = False,
                  keep_on_null: Sequence[str] = ()) -> DataFrame:
    """Overwrite ``columns`` of the rows whose key is in ``updates``, with NULL too.

    Of several updates of a key the greatest by its columns counts, unless ``unique`` says that
    there is one. NULL keys never match.
    """
    return merge(base, updates, keys, columns, insert=False, unique=unique,
                 keep_on_null=keep_on_null)


def set_where(base: DataFrame, where: Column, values: Mapping[str, Any]) -> DataFrame:
    """Set columns where the predicate is true; rows where it is NULL stay as they are."""
    def value(c: str) -> Column:
        v = values[c]
        new = v if isinstance(v, Column) else F.lit(v)
        return F.when(where, new.cast(base.schema[c].dataType)).otherwise(F.col(c))

    return base.withColumns({c: value(c) for c in values})


def delete_where(base: DataFrame, where: Column) -> DataFrame:
    """Rows for which the predicate is not true."""
    return base.filter(~F.coalesce(where, F.lit(False)))


def delete_keys(base: DataFrame, gone: DataFrame, keys: Sequence[str] | str) -> DataFrame:
    return base.join(gone, keys, "left_anti")


def marked(base: DataFrame, keys_frame: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Adds a boolean column: the row's key occurs in ``keys_frame``."""
    keys = list(keys)
    found = keys_frame.select(*keys).distinct().withColumn(name, F.lit(True))
    return base.join(found, keys, "left").select(
        *base.columns, F.coalesce(name, F.lit(False)).alias(name))


def insert_missing(base: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is absent from ``base``; NULL keys are always absent."""
    return rows.join(base.select(*keys).distinct(), list(keys), "left_anti").select(*rows.columns)


def upsert(base: DataFrame, rows: DataFrame, keys: Sequence[str],
           columns: Sequence[str] | None = None) -> DataFrame:
    """Update matching keys and append the others; of several rows of a key the greatest counts."""
    return merge(base, rows, keys, columns)


def with_new_ids(rows: DataFrame, base: DataFrame, id_column: str, order: Sequence[str]
                 ) -> DataFrame:
    """Rows with ids after the greatest one of ``base``, in ``order``; any number of rows."""
    highest = base.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("_highest"))
    kind = base.schema[id_column].dataType
    numbered = number_in_order(rows.drop(id_column), order, "_number")
    return numbered.crossJoin(highest).withColumn(  # one row by construction
        id_column, (F.col("_highest") + F.col("_number")).cast(kind)).drop("_highest", "_number")


def append_with_ids(base: DataFrame, rows: DataFrame, id_column: str, order: str) -> DataFrame:
    """Append rows with ids after the greatest present id, in ``order``."""
    return base.unionByName(with_new_ids(rows, base, id_column, [order]), allowMissingColumns=True)
