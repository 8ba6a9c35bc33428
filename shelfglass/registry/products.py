"""Selections, option lists and counts over products."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfglass.functions.predicates import condition, criteria
from shelfglass.operators.numbering import running_number, text_bucket
from shelfglass.plans import products as P
from shelfglass.registry.base import query

MEASURED = "height IS NOT NULL AND width IS NOT NULL AND depth IS NOT NULL"
KEPT = "(skip_status IS NULL OR skip_status <> 1)"
COLUMNS = "product_id, system_product_id, qb_code, brand, category, product_type, name, height, width, depth, outlier_mode"
BRANDS = ["Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22", "Brand#33", "Brand#44"]
IN_BRANDS = "brand IN (" + ", ".join(f"'{b}'" for b in BRANDS) + ")"
CATEGORIES = ["ECONOMY", "SMALL"]
IN_CATEGORIES = "category IN ('ECONOMY', 'SMALL')"


# --- filters ---------------------------------------------------------------------------------

@query("P01_condition_operators", """
SELECT product_id, p_eq, p_ne, p_gt, p_le, p_like, p_ilike, p_in, p_not_in, p_between, p_null FROM (
SELECT product_id, category = 'SMALL' AS p_eq, category <> 'SMALL' AS p_ne, height > 20 AS p_gt,
  height <= 20 AS p_le, name LIKE '%a%' AS p_like, category ILIKE 'sm%' AS p_ilike,
  group_id IN (1, 2) AS p_in, group_id NOT IN (1, 2) AS p_not_in,
  depth BETWEEN 5 AND 30 AS p_between, brand IS NULL AS p_null FROM fx_product) x""")
def condition_operators(t):
    tests = {"p_eq": ("category", "=", "SMALL"), "p_ne": ("category", "!=", "SMALL"),
             "p_gt": ("height", ">", 20), "p_le": ("height", "<=", 20),
             "p_like": ("name", "like", "%a%"), "p_ilike": ("category", "ilike", "sm%"),
             "p_in": ("group_id", "in", [1, 2]), "p_not_in": ("group_id", "not_in", [1, 2]),
             "p_between": ("depth", "between", (5, 30)), "p_null": ("brand", "is_null", True)}
    return t.fx_product.select("product_id", *[condition(*v).alias(k) for k, v in tests.items()])


@query("P02_and_or_criteria", """
SELECT product_id FROM fx_product
WHERE (category = 'SMALL' AND height >= 10) OR (group_id = 2 OR width < 5)""")
def and_or_criteria(t):
    return t.fx_product.filter(criteria({
        "and": [("category", "=", "SMALL"), ("height", ">=", 10)],
        "or": [("group_id", "=", 2), ("width", "<", 5)]})).select("product_id")


@query("P03_products_filtered", f"""
SELECT {COLUMNS} FROM fx_product WHERE group_id = 1 AND {MEASURED} AND {KEPT} AND {IN_BRANDS}""")
def products_filtered(t):
    return P.products_filtered(t.fx_product, 1, BRANDS)


@query("P04_analysis_rows", f"""
SELECT product_id, qb_code AS "SKU", brand AS "Brand", category AS "Category", product_type AS "Type", name AS "Name",
  height AS "H", width AS "W", depth AS "D"
FROM fx_product WHERE group_id = 1 AND {MEASURED} AND {KEPT}
  AND (iteration_closed = 2 OR (iteration_closed = 1 AND final_status = 1))""")
def analysis_rows(t):
    return P.analysis_rows(t.fx_product, 1, iteration=2).drop("system_product_id", "outlier_mode")


@query("P05_products_for_iteration", f"""
SELECT {COLUMNS} FROM fx_product WHERE group_id = 3 AND {MEASURED} AND {KEPT}
  AND (iteration_closed = 3 OR (iteration_closed = 2 AND final_status = 1))""")
def products_for_iteration(t):
    return P.products_for_iteration(t.fx_product, 3, 3)


@query("P06_products_by_ids", f"""
SELECT {COLUMNS} FROM fx_product WHERE system_product_id IN (SELECT CAST(l_partkey AS VARCHAR)
  FROM lineitem WHERE l_quantity >= 50)""")
def products_by_ids(t):
    ids = t.lineitem.filter("l_quantity >= 50").select(
        F.col("l_partkey").cast("string").alias("system_product_id"))
    return P.products_by_ids(t.fx_product, ids)


@query("P07_previous_outliers", f"""
SELECT product_id, category, iteration_closed, final_status FROM fx_product
WHERE group_id = 1 AND category = 'SMALL' AND {KEPT} AND iteration_closed < 3 AND final_status = 0""")
def previous_outliers(t):
    return P.previous_outliers(t.fx_product, 1, "SMALL", 3).select(
        "product_id", "category", "iteration_closed", "final_status")


@query("P08_saved_state", f"""
SELECT product_id, coalesce(final_status = 0, FALSE) AS is_outlier, coalesce(iqr_status = 0, FALSE) AS iqr_is_outlier,
  coalesce(dbs_status = 0, FALSE) AS dbscan_is_outlier, CAST(CASE WHEN dbs_status = 0 THEN -1 ELSE 0 END AS INT) AS dbscan_cluster
FROM fx_product WHERE group_id = 1 AND category = 'SMALL' AND {MEASURED} AND {KEPT}""")
def saved_state(t):
    return P.saved_state(t.fx_product, 1, "SMALL").select(
        "product_id", "is_outlier", "iqr_is_outlier", "dbscan_is_outlier", "dbscan_cluster")


@query("P09_products_for_sweep", f"""
SELECT {COLUMNS} FROM fx_product WHERE group_id = 2 AND {MEASURED} AND brand IS NOT NULL
  AND category IS NOT NULL AND product_type IS NOT NULL AND final_status IS NULL""")
def products_for_sweep(t):
    return P.products_for_sweep(t.fx_product, 2, "pending").select(
        *[c.strip() for c in COLUMNS.split(",")])


@query("P10_grid_filter", f"""
SELECT product_id, brand, category, skip_status, final_status FROM fx_product WHERE group_id = 1 AND {IN_CATEGORIES}
  AND (skip_status = 0 OR skip_status IS NULL) AND (final_status IS NULL OR final_status = 0)""")
def grid_filter(t):
    return t.fx_product.filter(P.grid_filter(
        1, categories=CATEGORIES, skip_status=["No"], final_status=["Pending to Analyze", "Outlier"]
    )).select("product_id", "brand", "category", "skip_status", "final_status")


@query("P15_first_by_code", """
SELECT product_id, qb_code, name FROM fx_product WHERE qb_code = 'QB-77' ORDER BY product_id LIMIT 1""")
def first_by_code(t):
    return P.by_code(t.fx_product, "QB-77").select("product_id", "qb_code", "name")


def groups(t):
    """Catalogue groups counted from the products."""
    return t.fx_product.groupBy("group_id").agg(F.count(F.lit(1)).alias("product_count")).select(
        "group_id", F.concat(F.lit("Group "), F.col("group_id").cast("string")).alias("name"),
        "product_count", (F.col("group_id") == 2).cast("int").alias("default_selected"))


@query("P24_group_options", """
SELECT group_id, concat('Group ', CAST(group_id AS VARCHAR)) AS name, count(*) AS product_count,
  CAST(group_id = 2 AS INT) AS default_selected,
  concat('Group ', CAST(group_id AS VARCHAR), ' (', CAST(count(*) AS VARCHAR), ')') AS label
FROM fx_product GROUP BY group_id""")
def group_options(t):
    return P.group_options(groups(t))


@query("P24_default_group", """
SELECT CAST(2 AS INT) AS group_id, 'Group 2' AS name, count(*) AS product_count, CAST(1 AS INT) AS default_selected
FROM fx_product WHERE group_id = 2""")
def default_group(t):
    return P.default_group(groups(t))


@query("J13_ids_of_codes", """
SELECT system_product_id FROM fx_product WHERE qb_code IN (SELECT concat('QB-', CAST(o_custkey AS VARCHAR)) FROM orders)""")
def ids_of_codes(t):
    codes = t.orders.select(F.concat(F.lit("QB-"), F.col("o_custkey").cast("string")).alias("qb_code"))
    return P.ids_of_codes(t.fx_product, codes)


@query("T01_distinct_filters", "SELECT DISTINCT brand, category FROM fx_product WHERE brand IS NOT NULL")
def distinct_filters(t):
    return t.fx_product.filter("brand IS NOT NULL").select("brand", "category").distinct()


# --- counts ----------------------------------------------------------------------------------

def counts_sql(field: str, where: str) -> str:
    return f"""
SELECT {field}, count(*) AS total, count(*) FILTER (final_status IN (0, 1)) AS analyzed,
  concat({field}, ' (', CAST(count(*) AS VARCHAR), ')') AS label
FROM fx_product WHERE group_id = 1 AND {MEASURED} AND {field} IS NOT NULL AND {where} GROUP BY {field}"""


@query("A01_brand_counts", counts_sql("brand", "TRUE"))
def brand_counts(t):
    return P.option_counts(t.fx_product, "brand", 1)


@query("A02_category_counts", counts_sql("category", IN_BRANDS))
def category_counts(t):
    return P.option_counts(t.fx_product, "category", 1, BRANDS)


@query("A03_type_counts", counts_sql("product_type", f"{IN_BRANDS} AND category = 'SMALL'"))
def type_counts(t):
    return P.option_counts(t.fx_product, "product_type", 1, BRANDS, "SMALL")


def values_sql(field: str, where: str) -> str:
    return f"""
SELECT {field}, count(*) AS n, concat({field}, ' (', CAST(count(*) AS VARCHAR), ')') AS label
FROM fx_product WHERE {field} IS NOT NULL AND {where} GROUP BY {field}"""


@query("A04_chart_brand_counts", values_sql("brand", f"group_id = 1 AND {MEASURED}"))
def chart_brand_counts(t):
    return P.chart_counts(t.fx_product, "brand", 1)


@query("A04_chart_category_counts", values_sql("category", f"group_id = 1 AND {MEASURED} AND {IN_BRANDS}"))
def chart_category_counts(t):
    return P.chart_counts(t.fx_product, "category", 1, BRANDS)


@query("A04_chart_type_counts", values_sql("product_type", f"group_id = 1 AND {MEASURED} AND {IN_BRANDS} AND category = 'SMALL'"))
def chart_type_counts(t):
    return P.chart_counts(t.fx_product, "product_type", 1, BRANDS, "SMALL")


@query("A05_status_brand_counts", values_sql("brand", f"group_id = 1 AND {MEASURED} AND (final_status = 0 OR final_status IS NULL)"))
def status_brand_counts(t):
    return P.status_counts(t.fx_product, "brand", 1, ["Outlier", "Pending to Analyze"])


@query("A05_status_category_counts", values_sql("category", f"group_id = 1 AND {MEASURED} AND final_status = 1 AND {IN_BRANDS}"))
def status_category_counts(t):
    return P.status_counts(t.fx_product, "category", 1, ["Normal"], BRANDS)


@query("A05_status_type_counts", values_sql("product_type", f"group_id = 1 AND {MEASURED} AND final_status IS NULL AND {IN_CATEGORIES}"))
def status_type_counts(t):
    return P.status_counts(t.fx_product, "product_type", 1, ["Pending to Analyze"], None, CATEGORIES)


def status_sql(field: str, where: str) -> str:
    return f"""SELECT '{field}' AS field, {field} AS value,
  CASE WHEN count(final_status) = count(*) THEN 'full' ELSE 'partial' END AS status
FROM fx_product WHERE group_id = 1 AND {MEASURED} AND {field} IS NOT NULL AND {where}
GROUP BY {field} HAVING count(final_status) > 0"""


@query("A06_analysed_status", " UNION ALL ".join([
    status_sql("brand", "TRUE"), status_sql("category", IN_BRANDS),
    status_sql("product_type", f"{IN_BRANDS} AND {IN_CATEGORIES}")]))
def analysed_status(t):
    return P.analysed_status(t.fx_product, 1, BRANDS, CATEGORIES)


@query("A07_basic_groups", f"""
SELECT brand, category, product_type, count(*) AS total_count FROM fx_product
WHERE group_id = 1 AND {MEASURED} AND {KEPT} GROUP BY brand, category, product_type""")
def basic_groups(t):
    return P.basic_groups(t.fx_product, 1)


PROGRESS = """count(system_product_id) AS total, count(final_status) AS analyzed,
  count(*) - count(final_status) AS pending"""


@query("A08_category_progress", f"""
SELECT category, {PROGRESS} FROM fx_product WHERE group_id = 1 AND category IS NOT NULL AND {MEASURED} GROUP BY category""")
def category_progress(t):
    return P.category_progress(t.fx_product, 1)


@query("A09_chosen_category_progress", f"""
SELECT category, {PROGRESS} FROM fx_product WHERE group_id = 1 AND {IN_CATEGORIES} AND {MEASURED} GROUP BY category""")
def chosen_category_progress(t):
    return P.category_progress(t.fx_product, 1, CATEGORIES)


@query("A10_header_counts", f"""
SELECT count(*) AS total_items, count(final_status) AS analyzed_items, count(*) - count(final_status) AS pending_items
FROM fx_product WHERE group_id = 1 AND category = 'SMALL' AND {MEASURED}""")
def header_counts(t):
    return P.header_counts(t.fx_product, 1, category="SMALL")


@query("W03_category_numbers", """
SELECT category, row_number() OVER (ORDER BY category) AS group_key
FROM (SELECT DISTINCT category FROM fx_product) x""")
def category_numbers(t):
    return running_number(t.fx_product.select("category").distinct(), [], "category",
                          text_bucket("category"), "group_key")


WORK_GROUPS = f"""
WITH b AS (SELECT brand, category, product_type, count(*) AS n FROM fx_product
  WHERE group_id = 1 AND {MEASURED} AND {KEPT} GROUP BY brand, category, product_type)
SELECT concat(coalesce(brand, 'None'), '_', category, '_', product_type) AS combination_key, brand, category, product_type,
  n AS total_count, TRUE AS is_valid FROM b WHERE n >= 4
UNION ALL
SELECT concat(coalesce(brand, 'None'), '_', category), brand, category, string_agg(product_type, '|' ORDER BY product_type),
  CAST(sum(n) AS BIGINT), sum(n) >= 3 FROM b WHERE n < 4 GROUP BY brand, category"""


@query("X18_work_groups", WORK_GROUPS)
def work_groups(t):
    return P.work_groups(P.basic_groups(t.fx_product, 1), 4, 3)


@query("T03_appended_groups", f"SELECT count(*) AS groups, CAST(sum(total_count) AS BIGINT) AS products FROM ({WORK_GROUPS.strip().replace('WITH b AS', 'WITH b AS')}) g")
def appended_groups(t):
    return P.work_groups(P.basic_groups(t.fx_product, 1), 4, 3).agg(
        F.count(F.lit(1)).alias("groups"), F.sum("total_count").alias("products"))
