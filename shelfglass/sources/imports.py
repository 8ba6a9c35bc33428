"""Table import: profile, mapping checks, insert / update / upsert modes and report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfglass.functions.text import strip
from shelfglass.operators.keyed import first_per_key, marked, merge
from shelfglass.staging import stage

MODES = ("insert_direct", "insert_with_identity", "update", "insert_update")


def fetch_all(spark: SparkSession, query: str, params: Mapping[str, Any] | None = None
              ) -> DataFrame:
    """Rows of a SQL text with named parameters."""
    return spark.sql(query, args=dict(params or {}))


def fetch_row(spark: SparkSession, query: str, params: Mapping[str, Any] | None = None
              ) -> DataFrame:
    return fetch_all(spark, query, params).limit(1)


def fetch_one(spark: SparkSession, query: str, params: Mapping[str, Any] | None = None) -> Any:
    row = fetch_row(spark, query, params).first()
    return row[0] if row else None


def file_profile(raw: DataFrame) -> DataFrame:
    """Header names in order and the number of rows."""
    return raw.agg(F.count(F.lit(1)).alias("total_rows")).withColumn(
        "headers", F.lit(",".join(raw.columns)))


def tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def required_columns(schema: T.StructType, generated: Sequence[str] = ()) -> list[str]:
    """Columns that must be given: not nullable, without default, not generated."""
    return [f.name for f in schema.fields
            if not f.nullable and "CURRENT_DEFAULT" not in f.metadata and f.name not in generated]


def check_mapping(schema: T.StructType | None, mapping: Mapping[str, str] | None, mode: str | None,
                  identity: Sequence[str] = (), generated: Sequence[str] = ()) -> None:
    """Reject an incomplete import; one error names all missing columns."""
    if schema is None or not mapping or not mode:
        raise ValueError("file, table, mapping and mode are needed")
    if mode not in MODES:
        raise ValueError(f"unknown import mode {mode!r}")
    if mode != "insert_direct" and not identity:
        raise ValueError("identity columns are needed")
    missing = [c for c in required_columns(schema, generated) if c not in mapping.values()]
    if missing:
        raise ValueError(f"required columns not mapped: {', '.join(missing)}")


def _text(source: str) -> Column:
    return F.nullif(strip(F.col(f"`{source}`").cast("string")), F.lit(""))


def mapped_rows(raw: DataFrame, mapping: Mapping[str, str], schema: T.StructType,
                reject: bool = False) -> DataFrame:
    """File columns under their table names: stripped, empty to NULL, cast to the table type.

    ``reject`` leaves out rows with a value that does not fit, so that an update overwrites no good
    value; ``import_rows`` reports them and ``cast_errors`` lists the values. Otherwise such a value
    is NULL.
    """
    rows = checked_rows(raw, mapping, schema)
    return (rows.filter(F.size("errors") == 0) if reject else rows).drop("errors")


def checked_rows(raw: DataFrame, mapping: Mapping[str, str], schema: T.StructType) -> DataFrame:
    """Mapped rows with ``errors``: column, value and reason of every value that does not fit."""
    problems = [
        F.when(_text(s).isNotNull() & _text(s).try_cast(schema[t].dataType).isNull(), F.struct(
            F.lit(t).alias("column"), _text(s).alias("value"),
            F.lit(f"not a {schema[t].dataType.simpleString()}").alias("reason")))
        for s, t in mapping.items()]
    return raw.select(
        *[_text(s).try_cast(schema[t].dataType).alias(t) for s, t in mapping.items()],
        F.array_compact(F.array(*problems)).alias("errors"))


def _comparable(c: str) -> Column:
    """Identity values that read as whole numbers compare as numbers ('07' equals 7)."""
    text = strip(F.col(c).cast("string"))
    return F.coalesce(text.try_cast("bigint").cast("string"), text)


def _split(base: DataFrame, rows: DataFrame, identity: Sequence[str], order: str | None
           ) -> tuple[DataFrame, DataFrame, list[str]]:
    """Base and rows with comparable identity columns added; rows reduced to one per key.

    Rows with a NULL identity value match nothing and repeat nothing.
    """
    keys = [f"_k_{c}" for c in identity]
    as_keys = {k: _comparable(c) for k, c in zip(keys, identity, strict=True)}
    keyed_base, keyed = base.withColumns(as_keys), rows.withColumns(as_keys)
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    position = order or "_position"
    if order is None:
        keyed = keyed.withColumn(position, F.monotonically_increasing_id())
    # A row without an identity stands alone under its position, so one aggregate does both.
    keyed = keyed.withColumn("_alone", F.when(~known, F.col(position)))
    unique = first_per_key(keyed, [*keys, "_alone"], position)
    return keyed_base, unique.drop("_alone", "_position"), keys


def run_import(base: DataFrame, rows: DataFrame, mode: str, identity: Sequence[str] = (),
               order: str | None = None, flag: str | None = None) -> DataFrame:
    """The table after an import; ``order`` is the file order, the first row of a key wins.

    ``flag`` adds a column that tells inserted, updated and kept rows apart.
    """
    data = rows.drop(order) if order else rows
    if mode == "insert_direct":
        new, old = (F.lit("inserted"), F.lit("kept"))
        if flag:
            base, data = base.withColumn(flag, old), data.withColumn(flag, new)
        return base.unionByName(data, allowMissingColumns=True)
    keyed_base, unique, keys = _split(base, rows, identity, order)
    unique = unique.drop(order) if order else unique
    return merge(keyed_base, unique, keys, [c for c in data.columns if c not in identity],
                 update=mode in ("update", "insert_update"),
                 insert=mode in ("insert_with_identity", "insert_update"),
                 unique=True, flag=flag).drop(*keys)


class Import(NamedTuple):
    """What an import gives: the new table, the rejected values (the file's column ``order``, if
    any, with column, value and reason), and the counts."""

    table: DataFrame
    rejected: DataFrame
    report: DataFrame


def import_rows(base: DataFrame, raw: DataFrame, mapping: Mapping[str, str], schema: T.StructType,
                mode: str, identity: Sequence[str] = (), order: str | None = None) -> Import:
    """Run an import whose rows may hold bad values: these rows are rejected, with their values.

    The file is parsed once, to a staged table on which rows and rejected rows are counted while it
    is written; the new table is one merge. total = inserted + updated + duplicates + ignored +
    errors, errors being rejected rows and ignored rows that the mode does not use.
    """
    spark, seen = base.sparkSession, Observation()
    checked = stage(checked_rows(raw, mapping, schema).observe(
        seen, F.count(F.lit(1)).alias("total"),
        F.count_if(F.size("errors") > 0).alias("errors")), "import")
    good = checked.filter(F.size("errors") == 0).drop("errors")
    rejected = checked.filter(F.size("errors") > 0).select(
        *([order] if order else []), F.explode("errors").alias("e")).select(
        *([order] if order else []), "e.*")
    table = run_import(base, good.drop(order) if order and mode == "insert_direct" else good, mode,
                       identity, order)
    counts = import_report(base, good, mode, identity, order)
    errors = spark.createDataFrame([(seen.get["total"], seen.get["errors"])],
                                   "total bigint, errors bigint")
    report = counts.drop("total").crossJoin(errors).select(  # one row each
        "total", "inserted", "updated", "duplicates",
        (F.col("total") - F.col("errors") - F.col("inserted") - F.col("updated")
         - F.col("duplicates")).alias("ignored"), "errors")
    return Import(table, rejected, report)


def import_report(base: DataFrame, rows: DataFrame, mode: str, identity: Sequence[str] = (),
                  order: str | None = None) -> DataFrame:
    """Total, inserted, updated and rejected (repeated key) rows of an import."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    zero = F.lit(0).cast("bigint")
    if mode == "insert_direct":
        return total.select("total", F.col("total").alias("inserted"), zero.alias("updated"),
                            zero.alias("duplicates"))
    keyed_base, unique, keys = _split(base, rows, identity, order)
    split = marked(unique, keyed_base, keys, "_known").agg(
        F.count(F.lit(1)).alias("_unique"), F.count_if("_known").alias("_known"))
    both = total.crossJoin(split)  # one row each
    inserts = mode in ("insert_with_identity", "insert_update")
    updates = mode in ("update", "insert_update")
    return both.select(
        "total",
        (F.col("_unique") - F.col("_known") if inserts else zero).alias("inserted"),
        (F.col("_known") if updates else zero).alias("updated"),
        (F.col("total") - F.col("_unique")).alias("duplicates"))


def cast_errors(raw: DataFrame, mapping: Mapping[str, str], schema: T.StructType,
                first: int | None = None) -> DataFrame:
    """The values that do not fit their table column; with ``first`` only so many."""
    checks = F.explode(F.array(*[
        F.struct(F.lit(t).alias("column"), strip(F.col(f"`{s}`").cast("string")).alias("value"),
                 strip(F.col(f"`{s}`").cast("string")).try_cast(schema[t].dataType).isNull()
                 .alias("bad")) for s, t in mapping.items()]))
    bad = raw.select(checks.alias("e")).select("e.*").filter(
        F.col("bad") & (F.col("value") != "")).select("column", "value").orderBy("column", "value")
    return bad.limit(first) if first else bad
