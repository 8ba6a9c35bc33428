"""Product files: listing, scan with flexible headers, option counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfglass.functions.display import to_number
from shelfglass.staging import stage

# Accepted header names and the column each one stands for.
HEADER_NAMES = {
    "web_id": "SKU", "product_id": "product_id", "brand": "Brand", "category": "Category",
    "product_type": "Type", "name": "Name", "height": "H", "width": "W", "depth": "D",
    "weight": "weight", "base_image_url": "imageUrl", "url_key": "url_key",
    "imageurl": "imageUrl", "sku": "SKU", "type": "Type", "h": "H", "w": "W", "d": "D",
}
DIMENSIONS = ("H", "W", "D")
MIN_ROWS = 4


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the CSV files of a folder, sorted."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.url_decode(name).alias("file")).distinct().orderBy("file")


def read_file(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """All columns as text, one record per line; files are split over the cluster.

    Pass ``multi_line=True`` for files whose quoted fields may span lines: Spark reads each of them
    in one task.
    """
    return spark.read.csv(path, header=True, multiLine=multi_line, escape='"')


def standardise(raw: DataFrame) -> DataFrame:
    """Known headers to their column names, numbers parsed, rows without a dimension dropped.

    Several headers of one name are merged, the first in file order winning. A file that lacks a
    dimension is an error.
    """
    sources: dict[str, list[str]] = {}
    for c in raw.columns:
        sources.setdefault(HEADER_NAMES.get(c.strip().lower(), c), []).append(c)
    df = raw.select(*[
        (F.coalesce(*[F.col(f"`{c}`") for c in cs]) if len(cs) > 1 else F.col(f"`{cs[0]}`")
         ).alias(target)
        for target, cs in sources.items()])
    numeric = [c for c in (*DIMENSIONS, "weight") if c in df.columns]
    df = df.withColumns({c: to_number(F.col(c)) for c in numeric})
    missing = [d for d in DIMENSIONS if d not in df.columns]
    if missing:
        raise ValueError(f"the file has no column for {', '.join(missing)}")
    return df.na.drop(subset=list(DIMENSIONS))


def load_products(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return standardise(read_file(spark, path, multi_line))


def with_row_order(rows: DataFrame, name: str = "row_order") -> DataFrame:
    """Rows with a unique number in file order, written out so that it stays the same."""
    return stage(rows.withColumn(name, F.monotonically_increasing_id()), "rows")


def filtered(rows: DataFrame, categories, brands=None, types=None) -> DataFrame:
    """Rows of the chosen categories, and brands and types where chosen; fewer than ``MIN_ROWS`` are
    an error, found by a look at the first ones."""
    if not categories:
        raise ValueError("categories must be selected")
    wanted = [categories] if isinstance(categories, str) else list(categories)
    where = F.col("Category").isin(wanted)
    for values, c in ((brands, "Brand"), (types, "Type")):
        if values:
            where = where & F.col(c).isin(list(values))
    picked = rows.filter(where)
    found = picked.limit(MIN_ROWS).count()
    if found < MIN_ROWS:
        raise ValueError(f"{found} rows are too few: an analysis needs {MIN_ROWS}")
    return picked


def preview(labelled: DataFrame, sku: str, column: str = "SKU") -> DataFrame:
    """Rows of one product from a labelled frame."""
    return labelled.filter(F.col(column) == sku)
