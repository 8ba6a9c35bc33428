"""Export frames and file sinks; partitions write in parallel, nothing passes the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfglass.functions.display import yes_no
from shelfglass.operators.joins import null_safe_join
from shelfglass.operators.outliers import flags_as_outlier_text

ANALYSIS_EXPORT = ["qb_code", "brand", "category", "product_type", "name", "height", "width",
                   "depth"]
# Short column names and the names a result file uses.
FILE_NAMES = {"SKU": "web_id", "Brand": "brand", "Category": "category", "Type": "product_type",
              "Name": "name", "H": "height", "W": "width", "D": "depth",
              "imageUrl": "base_image_url"}


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = (),
              rows_per_file: int = 0) -> None:
    """CSV files with a header; ``rows_per_file`` bounds the rows of a file, 0 does not."""
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"').option(
        "maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def sized_by_key(df: DataFrame, keys: Sequence[str], rows_per_file: int) -> DataFrame:
    """Rows dealt out so that a key with many rows is written by several tasks, of about
    ``rows_per_file`` rows each, and one with few rows by one task: files per key follow its size."""
    files = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows_per_file).alias("_files"))
    share = F.pmod(F.xxhash64(*df.columns), F.col("_files"))
    return null_safe_join(df, files, keys).withColumn("_file", share).repartition(
        *keys, "_file").select(*df.columns)


def append_rows(df: DataFrame, path: str) -> None:
    """Bulk append of items or any other rows."""
    df.write.mode("append").parquet(path)


def analysis_export(labelled: DataFrame, kind: str = "all") -> DataFrame:
    """All, normal or outlier rows with a status text."""
    flag = F.coalesce(F.col("is_outlier_combined"), F.lit(False))
    rows = {"all": labelled, "normal": labelled.filter(~flag), "outlier": labelled.filter(flag)}[
        kind]
    return rows.select(*[c for c in ANALYSIS_EXPORT if c in rows.columns],
                       F.when(flag, "Outlier").otherwise("Normal").alias("Status"))


def labelled_export(labelled: DataFrame, algorithms: Sequence[str]) -> DataFrame:
    """Rows with Yes/No columns per algorithm.

    iqr_status and dbscan_status say Yes for normal, the per-dimension columns Yes for outlier.
    """
    out = [F.col(c) for c in ("brand", "category", "product_type", "product_id", "qb_code",
                              "url_key", "height", "width", "depth") if c in labelled.columns]
    if "IQR" in algorithms:
        labelled = flags_as_outlier_text(labelled)
        out += [yes_no(~F.col("iqr_is_outlier")).alias("iqr_status"),
                *[F.col(f"iqr_o_{d}").alias(f"iqr_{d}") for d in ("height", "width", "depth")]]
    if "DBSCAN" in algorithms:
        noise = F.coalesce("dbscan_is_outlier", F.lit(False))
        out += [yes_no(~noise).alias("dbscan_status"),
                *[yes_no(noise).alias(f"dbscan_{d}") for d in ("height", "width", "depth")],
                F.col("dbscan_cluster")]
    return labelled.select(*out)


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without the columns that are NULL in every row; one aggregate over the frame."""
    filled = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if filled[c]])


def split_export(export: DataFrame, kind: str = "all") -> DataFrame:
    """normal: Yes by either algorithm; outliers: No by all present ones."""
    present = [c for c in ("iqr_status", "dbscan_status") if c in export.columns]
    if kind == "all" or not present:
        return export
    good = F.lit(False)
    for c in present:
        good = good | (F.col(c) == "Yes")
    return export.filter(good if kind == "normal" else ~good)


def file_result(analysed: DataFrame) -> DataFrame:
    """Labelled file rows under their file column names."""
    return analysed.withColumnsRenamed(FILE_NAMES)


def write_by_status(analysed: DataFrame, path: str) -> None:
    """One folder for normal (Yes) and one for outlier (No) rows."""
    write_csv(file_result(analysed), path, ["final_status"])


#: Rows of one file of a result by brand, category and status.
FILE_ROWS = 1_000_000


def write_by_brand_category(analysed: DataFrame, path: str, rows_per_file: int = FILE_ROWS) -> None:
    """A folder for each brand, category and status, in files of about ``rows_per_file`` rows."""
    keys = ["brand", "category", "final_status"]
    write_csv(sized_by_key(file_result(analysed), keys, rows_per_file), path, keys, rows_per_file)


def slice_of(results: DataFrame, brand: str, category: str, final_status: str) -> DataFrame:
    """Rows of one brand, category and status; prunes partitions of a written result."""
    return results.filter((F.col("brand") == brand) & (F.col("category") == category)
                          & (F.col("final_status") == final_status))


# Descriptive columns of a sweep file and their titles, in file order.
SWEEP_FIXED = {
    "system_product_id": "System Product Id", "qb_code": "QB Code", "brand": "Brand",
    "category": "Category", "product_type": "Product Type", "name": "Name",
    "base_image_url": "Image URL", "product_url": "Product URL", "height": "Height",
    "width": "Width", "depth": "Depth",
}
SWEEP_COUNTS = ["Unique Group Key", "TOTAL ITEMS", "Analyzed Item Count", "Pending Item Count",
                "EXECUTED"]


def sweep_export(wide: DataFrame) -> DataFrame:
    """Sweep columns in file order, '-' where a setting did not run."""
    fixed = [F.col(c).alias(t) for c, t in SWEEP_FIXED.items() if c in wide.columns]
    runs = [c for c in wide.columns if " X " in c]
    dashed = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-")).alias(c)
              for c in [*runs, "Average Status %"]]
    return wide.select(*fixed, *SWEEP_COUNTS, *dashed, "Status Column Count")
