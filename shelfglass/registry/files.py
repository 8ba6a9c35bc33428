"""File scans, imports and sinks, over files that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfglass.plans import analysis as A
from shelfglass.registry.base import query
from shelfglass.registry.outliers import (
    DIMS, FILE_CATEGORIES, FILE_ROWS, MEASURED, bounds_sql, flag_sql,
)
from shelfglass.sources import exports as E
from shelfglass.sources import imports as I
from shelfglass.sources import product_files as P
from shelfglass.staging import scratch


def folder(t, name: str) -> str:
    return scratch(t.spark, name)


def written(t, df, name: str) -> str:
    path = folder(t, name)
    E.write_csv(df, path)
    return path


def product_file(t) -> str:
    """A product file with long headers, bad numbers, blanks and padding."""
    h = F.col("height").cast("string")
    height = (F.when(F.col("skip_status") == 1, "n/a").when(F.col("height") > 45, F.concat(F.lit(" "), h, F.lit(" ")))
              .otherwise(F.coalesce(h, F.lit(""))))
    rows = t.fx_product.select(
        F.col("qb_code").alias("Web_ID"), F.col("product_id").alias("Product_ID"), F.col("brand").alias("Brand"),
        F.col("category").alias("Category"), F.col("product_type").alias("Product_Type"),
        F.concat(F.lit('a "quoted", '), "name").alias("Name"), height.alias("HEIGHT"),
        F.col("width").alias("Width"), F.col("depth").alias("Depth"), F.lit("").alias("Weight"))
    return written(t, rows, "products")


@query("S01_product_file", f"""
SELECT qb_code AS "SKU", CAST(product_id AS VARCHAR) AS product_id, brand AS "Brand", category AS "Category", product_type AS "Type",
  concat('a "quoted", ', name) AS "Name", height AS "H", width AS "W", depth AS "D", CAST(NULL AS DOUBLE) AS weight
FROM fx_product WHERE {MEASURED} AND (skip_status IS NULL OR skip_status <> 1)""")
def load_product_file(t):
    return P.load_products(t.spark, product_file(t))


@query("S02_file_listing")
def file_listing(t):
    return P.list_files(t.spark, product_file(t))


@query("S03_parameterised_sql", "SELECT product_id, category FROM fx_product WHERE group_id = 2 AND height > 20")
def parameterised_sql(t):
    t.fx_product.createOrReplaceTempView("shelfglass_product")
    return I.fetch_all(t.spark, "SELECT product_id, category FROM shelfglass_product WHERE group_id = :g AND height > :h",
                       {"g": 2, "h": 20})


@query("S04_file_profile", """
SELECT count(*) AS total_rows, 'Web_ID,Product_ID,Brand,Category,Product_Type,Name,HEIGHT,Width,Depth,Weight' AS headers FROM fx_product""")
def file_profile(t):
    return I.file_profile(P.read_file(t.spark, product_file(t)))


MAPPING = {"Code": "qb_code", "Label": "name", "Tall": "height", "Line": "line"}


def import_file(t) -> str:
    """Import rows from the events: repeated and missing identities, blanks and padding."""
    rows = t.events.select(
        F.when(F.col("event_type") == "error", "").otherwise(F.concat(F.lit(" QB-"), F.col("user_id") * 5, F.lit(" "))).alias("Code"),
        F.when(F.col("event_type") == "click", " ").otherwise(F.col("event_type")).alias("Label"),
        F.col("value").alias("Tall"), F.col("event_id").alias("Line"))
    return written(t, rows, "import")


ROWS = """(SELECT CASE WHEN event_type = 'error' THEN NULL ELSE concat('QB-', CAST(user_id * 5 AS VARCHAR)) END AS qb_code,
  CASE WHEN event_type = 'click' THEN NULL ELSE event_type END AS name, value AS height, event_id AS line FROM events)"""
UNIQUE = f"""(SELECT qb_code, name, height FROM (SELECT *, row_number() OVER (PARTITION BY qb_code ORDER BY line) AS rn FROM {ROWS} r) x WHERE rn = 1 OR qb_code IS NULL)"""
BASE = "(SELECT product_id, qb_code, name, height FROM fx_product)"


def imported(t, mode: str):
    base = t.fx_product.select("product_id", "qb_code", "name", "height")
    schema = base.withColumn("line", F.lit(0).cast("bigint")).schema
    I.check_mapping(schema, MAPPING, mode, ["qb_code"], ["product_id"])
    rows = I.mapped_rows(P.read_file(t.spark, import_file(t)), MAPPING, schema, reject=True)
    return base, rows


def import_query(mode: str):
    def run(t):
        base, rows = imported(t, mode)
        if mode == "insert_direct":
            return I.run_import(base, rows.drop("line"), mode)
        return I.run_import(base, rows, mode, ["qb_code"], "line")
    return run


query("S07_insert_direct", f"SELECT * FROM {BASE} b UNION ALL SELECT NULL, qb_code, name, height FROM {ROWS} r")(
    import_query("insert_direct"))
FRESH = f"SELECT NULL, qb_code, name, height FROM {UNIQUE} u WHERE qb_code IS NULL OR qb_code NOT IN (SELECT qb_code FROM fx_product)"
UPDATED = f"""SELECT b.product_id, b.qb_code, CASE WHEN u.qb_code IS NULL THEN b.name ELSE u.name END AS name,
  CASE WHEN u.qb_code IS NULL THEN b.height ELSE u.height END AS height FROM {BASE} b LEFT JOIN {UNIQUE} u ON u.qb_code = b.qb_code"""
query("S08_insert_with_identity", f"SELECT * FROM {BASE} b UNION ALL {FRESH}")(import_query("insert_with_identity"))
query("S09_update", UPDATED)(import_query("update"))
query("S10_insert_update", f"{UPDATED} UNION ALL {FRESH}")(import_query("insert_update"))


@query("S11_import_report", f"""
SELECT (SELECT count(*) FROM events) AS total, (SELECT count(*) FROM ({FRESH}) f) AS inserted,
  (SELECT count(*) FROM {UNIQUE} u WHERE qb_code IN (SELECT qb_code FROM fx_product)) AS updated,
  (SELECT count(*) FROM events) - (SELECT count(*) FROM {UNIQUE} u) AS duplicates""")
def import_report(t):
    base, rows = imported(t, "insert_update")
    return I.import_report(base, rows, "insert_update", ["qb_code"], "line")


BAD = "event_id % 7 = 3"
BAD_ROWS = f"(SELECT * FROM {ROWS} r WHERE line % 7 <> 3)"
BAD_UNIQUE = f"(SELECT qb_code FROM (SELECT *, row_number() OVER (PARTITION BY qb_code ORDER BY line) AS rn FROM {BAD_ROWS} r) x WHERE rn = 1 OR qb_code IS NULL)"


def import_with_bad_values(t):
    """The import of a file in which every seventh row has a text as its height."""
    raw = P.read_file(t.spark, import_file(t))
    raw = raw.withColumn("Tall", F.when(F.col("Line").cast("bigint") % 7 == 3, F.lit(" n/a ")).otherwise(F.col("Tall")))
    raw = P.read_file(t.spark, written(t, raw, "bad-import"))
    base = t.fx_product.select("product_id", "qb_code", "name", "height")
    schema = base.withColumn("line", F.lit(0).cast("bigint")).schema
    return I.import_rows(base, raw, MAPPING, schema, "insert_update", ["qb_code"], "line")


@query("S11_report_with_rejects", f"""
SELECT (SELECT count(*) FROM events) AS total, (SELECT count(*) FROM {BAD_UNIQUE} u WHERE qb_code IS NULL OR qb_code NOT IN (SELECT qb_code FROM fx_product)) AS inserted,
  (SELECT count(*) FROM {BAD_UNIQUE} u WHERE qb_code IN (SELECT qb_code FROM fx_product)) AS updated,
  (SELECT count(*) FROM {BAD_ROWS} r) - (SELECT count(*) FROM {BAD_UNIQUE} u) AS duplicates, CAST(0 AS BIGINT) AS ignored,
  (SELECT count(*) FROM events WHERE {BAD}) AS errors""")
def report_with_rejects(t):
    return import_with_bad_values(t).report


@query("S11_rejected_values", f"SELECT event_id AS line, 'height' AS \"column\", 'n/a' AS value, 'not a double' AS reason FROM events WHERE {BAD}")
def rejected_values(t):
    return import_with_bad_values(t).rejected


@query("J15_known_identities", f"SELECT DISTINCT qb_code FROM {ROWS} r WHERE qb_code IN (SELECT qb_code FROM fx_product)")
def known_identities(t):
    base, rows = imported(t, "update")
    return rows.join(base, "qb_code", "left_semi").select("qb_code").distinct()


# --- sinks, read back ------------------------------------------------------------------------

ANY = "(" + " OR ".join(flag_sql(d) for d in DIMS) + ")"
RESULT = f"""SELECT p.product_id, p.brand, p.category, p.height, CASE WHEN {ANY} THEN 'No' ELSE 'Yes' END AS final_status
FROM ({FILE_ROWS}) p JOIN ({bounds_sql("category", FILE_ROWS)}) b ON b.category = p.category"""


def results(t):
    rows = t.fx_product.drop("final_status", "iqr_status")
    return A.analyse_file_rows(rows, FILE_CATEGORIES, algorithms=["IQR"]).select(
        "product_id", "brand", "category", "height", "final_status")


def typed(df):
    return df.select(F.col("product_id").cast("bigint").alias("product_id"), "brand", "category",
                     F.col("height").cast("double").alias("height"), "final_status")


@query("S15_file_result", RESULT)
def file_result(t):
    return typed(P.read_file(t.spark, written(t, E.file_result(results(t)), "result")))


@query("S16_files_by_status", RESULT)
def files_by_status(t):
    path = folder(t, "by-status")
    E.write_by_status(results(t), path)
    return typed(P.read_file(t.spark, path))


@query("S17_slice_of_results", f"SELECT * FROM ({RESULT}) r WHERE brand = 'Brand#11' AND category = 'SMALL' AND final_status = 'Yes'")
def slice_of_results(t):
    path = folder(t, "by-brand")
    E.write_by_brand_category(results(t), path)
    return typed(E.slice_of(P.read_file(t.spark, path), "Brand#11", "SMALL", "Yes"))


@query("S21_appended_items", """
SELECT id, iteration_id, status FROM fx_iteration_item WHERE status = 0 UNION ALL SELECT id, iteration_id, status FROM fx_iteration_item WHERE status = 1""")
def appended_items(t):
    path = folder(t, "items")
    items = t.fx_iteration_item.select("id", "iteration_id", "status")
    E.append_rows(items.filter("status = 0"), path)
    E.append_rows(items.filter("status = 1"), path)
    return t.spark.read.schema(items.schema).parquet(path)
