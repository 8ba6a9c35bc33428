"""Registry of queries with their reference SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfglass.sources.derived import ATTRIBUTES, CONFIGS, DEFINITIONS, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Attribute access to the tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` and, where SQL can express it, its reference text."""

    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_tables(sql)
        return fn

    return keep


def _values(rows, names: str) -> str:
    text = ", ".join("(" + ", ".join(
        "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}E0"
        if isinstance(v, float) else str(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {text}) AS v({names})"


LITERALS = {
    "fx_attribute": _values(ATTRIBUTES, "attribute_id, attribute_name, default_weightage, "
                                        "attribute_type, competitor_attribute, data_type"),
    "fx_config": _values(CONFIGS, "eps, min_samples"),
}


def with_tables(sql: str) -> str:
    """Prefix the derived tables a text mentions as common table expressions."""
    sql = sql.strip()
    ctes = [f"{name} AS ({text.strip()})" for name, text in {**DEFINITIONS, **LITERALS}.items()
            if re.search(rf"\b{name}\b", sql)]
    if not ctes:
        return sql
    if sql.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + sql[len("WITH RECURSIVE"):]
    if sql.upper().startswith("WITH"):
        return "WITH " + ",\n".join(ctes) + ",\n" + sql[len("WITH"):]
    return "WITH " + ",\n".join(ctes) + "\n" + sql
