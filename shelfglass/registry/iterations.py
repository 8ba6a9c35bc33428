"""Saved runs: loading, grids, votes, corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfglass.functions.predicates import condition
from shelfglass.operators.keyed import apply_updates, delete_where, set_where
from shelfglass.plans import analysis as A
from shelfglass.plans import grid as G
from shelfglass.plans import iterations as I
from shelfglass.plans import products as P
from shelfglass.registry import clusters_sql as C
from shelfglass.registry.base import query

MEASURED = "height IS NOT NULL AND width IS NOT NULL AND depth IS NOT NULL"
KEPT = "(p.skip_status IS NULL OR p.skip_status <> 1)"
STAMP = "2024-01-31 08:00:00"
STAMP_SQL = f"TIMESTAMP '{STAMP}'"


def stamp():
    return F.lit(STAMP).cast("timestamp_ntz")


# --- loading ---------------------------------------------------------------------------------

@query("J02_load_run", """
SELECT i.id, p.qb_code, nullif(p.height, 0) AS height, i.final_status, i.outlier_mode,
  coalesce(i.final_status = 0 OR (i.final_status IS NULL AND i.status = 0), FALSE) AS is_outlier_combined,
  CAST(CASE WHEN i.cluster LIKE 'Cluster %' THEN CAST(replace(i.cluster, 'Cluster ', '') AS INT) ELSE -1 END AS INT) AS dbscan_cluster
FROM fx_iteration_item i JOIN fx_product p ON i.system_product_id = p.system_product_id WHERE i.iteration_id = 3""")
def load_run(t):
    return I.load_run(t.fx_iteration_item, t.fx_product, 3).select(
        "id", "qb_code", "height", "final_status", "outlier_mode", "is_outlier_combined", "dbscan_cluster")


@query("A27_run_totals", """
SELECT count(*) AS total, count(*) FILTER (i.final_status = 1) AS normals, count(*) FILTER (i.final_status = 0) AS outliers
FROM fx_iteration_item i JOIN fx_product p ON i.system_product_id = p.system_product_id WHERE i.iteration_id = 3""")
def run_totals(t):
    return I.run_totals(I.load_run(t.fx_iteration_item, t.fx_product, 3))


@query("P16_ids_by_status", """
SELECT system_product_id FROM fx_iteration_item WHERE iteration_id = 4 AND status = 0 AND final_status IS NULL""")
def ids_by_status(t):
    return I.ids_by_status(t.fx_iteration_item, 4, "outlier")


@query("P17_ids_by_final_status", """
SELECT system_product_id, 'none' AS final FROM fx_iteration_item WHERE iteration_id = 4 AND final_status IS NULL
UNION ALL SELECT system_product_id, 'one' FROM fx_iteration_item WHERE iteration_id = 4 AND final_status = 1""")
def ids_by_final_status(t):
    return I.ids_by_final_status(t.fx_iteration_item, 4, None).withColumn("final", F.lit("none")).unionByName(
        I.ids_by_final_status(t.fx_iteration_item, 4, 1).withColumn("final", F.lit("one")))


@query("P18_run_filters", """
WITH r AS (SELECT * FROM fx_product WHERE system_product_id IN (SELECT system_product_id FROM fx_iteration_item WHERE iteration_id = 2))
SELECT DISTINCT 'brand' AS field, brand AS value FROM r WHERE brand IS NOT NULL UNION
SELECT 'category', category FROM r UNION SELECT 'group_id', CAST(group_id AS VARCHAR) FROM r""")
def run_filters(t):
    return I.run_filters(t.fx_iteration_item, t.fx_product, 2)


@query("P19_find_run", """
SELECT iteration_id, eps, sample FROM fx_iteration WHERE brand = 'Brand#11' AND category = 'ECONOMY' AND product_type = 'blue|red'
  AND eps = 0.5 AND sample = 2 AND algorithm = 'DBSCAN' AND product_group_id = 2 ORDER BY timestamp DESC LIMIT 1""")
def find_run(t):
    return I.find_run(t.fx_iteration, 2, "Brand#11", "ECONOMY", ["red", "blue"], 0.5, 2).select(
        "iteration_id", "eps", "sample")


@query("P20_run_is_saved", """
SELECT count(*) > 0 AS saved FROM fx_iteration_result WHERE category = 'SMALL' AND iteration_number = 3 AND brand = 'Brand#2'""")
def run_is_saved(t):
    return I.run_is_saved(t.fx_iteration_result, ["Brand#2"], "SMALL", 3)


@query("J10_previously_normal", """
SELECT product_id FROM fx_product WHERE system_product_id IN (SELECT system_product_id FROM fx_iteration_result
  WHERE category = 'SMALL' AND iteration_number = 2 GROUP BY system_product_id HAVING max(status) = 1)""")
def previously_normal(t):
    return I.products_for_mode(t.fx_product, t.fx_iteration_result, None, "SMALL", 3, "normal").select("product_id")


@query("J10_whole_category", f"SELECT product_id FROM fx_product WHERE category = 'SMALL' AND {MEASURED}")
def whole_category(t):
    return I.products_for_mode(t.fx_product, t.fx_iteration_result, None, "SMALL", 3, "all").select("product_id")


@query("W01_latest_item", """
SELECT system_product_id, iteration_id, id, cluster FROM (SELECT *, row_number() OVER
  (PARTITION BY system_product_id ORDER BY iteration_id DESC, id DESC) AS rn FROM fx_iteration_item) x WHERE rn = 1""")
def latest_item(t):
    return I.latest_items(t.fx_iteration_item).select("system_product_id", "iteration_id", "id", "cluster")


HISTORY = """SELECT i.system_product_id, i.id, r.eps, r.sample,
  CASE i.final_status WHEN 1 THEN 'Normal' WHEN 0 THEN 'Outlier' ELSE 'Unknown' END AS status,
  strftime(i.analyzed_date, '%Y-%m-%d %H:%M:%S') AS date, i.analyzed_date
FROM fx_iteration_item i JOIN fx_iteration r ON r.iteration_id = i.iteration_id WHERE i.analyzed_date IS NOT NULL"""


@query("J05_history", f"""
SELECT system_product_id, id, eps, sample, status, date FROM ({HISTORY}) h
WHERE system_product_id IN (SELECT system_product_id FROM fx_product WHERE group_id = 1)""")
def history(t):
    return I.history(t.fx_iteration_item, t.fx_iteration, t.fx_product.filter("group_id = 1")).drop("analyzed_date")


HISTORY_TEXT = f"""SELECT system_product_id, string_agg(concat('EPS: ', CAST(eps AS VARCHAR), ', Sample: ', CAST(sample AS VARCHAR), ', Status: ', status, ', ', date), ' | '
  ORDER BY analyzed_date DESC, id DESC) AS history FROM ({HISTORY}) h GROUP BY system_product_id"""


@query("W05_history_lists", HISTORY_TEXT)
def history_lists(t):
    lists = I.history_lists(I.history(t.fx_iteration_item, t.fx_iteration))
    return lists.select("system_product_id", I.history_text(F.col("history")).alias("history"))


# --- counts and votes ------------------------------------------------------------------------

@query("A11_counts_per_number", """
SELECT iteration_number AS iteration, count(DISTINCT system_product_id) AS total,
  count(DISTINCT system_product_id) - count(*) FILTER (status = 0) AS normal,
  count(*) FILTER (status = 0 AND outlier_mode = 0) AS outlier, count(*) FILTER (status = 0 AND outlier_mode = 1) AS manual_outlier
FROM fx_iteration_result WHERE category = 'SMALL' GROUP BY iteration_number""")
def counts_per_number(t):
    return I.counts_per_number(t.fx_iteration_result, "SMALL")


def summary_sql(normal: str, outlier: str, where: str) -> str:
    return f"""
SELECT r.iteration_id, r.eps, r.sample, count(*) FILTER (ok) AS total_count, count(*) FILTER (ok AND ({normal})) AS normal_count,
  count(*) FILTER (ok AND ({outlier})) AS outlier_count, count(*) FILTER (ok AND final_status = 0) AS manual_outlier_count,
  count(*) FILTER (ok AND final_status = 1) AS manual_normal_count
FROM (SELECT i.*, p.product_id IS NOT NULL AS ok FROM fx_iteration_item i LEFT JOIN fx_product p
  ON p.system_product_id = i.system_product_id AND {KEPT}) i JOIN fx_iteration r ON r.iteration_id = i.iteration_id
WHERE {where} GROUP BY r.iteration_id, r.eps, r.sample"""


@query("A12_run_summary_disjoint", summary_sql(
    "status = 1 AND final_status IS NULL", "status = 0 AND final_status IS NULL",
    "r.product_group_id = 2 AND r.category = 'ECONOMY'"))
def run_summary_disjoint(t):
    where = (F.col("product_group_id") == 2) & (F.col("category") == "ECONOMY")
    return I.run_summary(t.fx_iteration, t.fx_iteration_item, t.fx_product, where)


@query("A13_run_summary_overlapping", summary_sql(
    "final_status = 1 OR (final_status IS NULL AND status = 1)", "final_status = 0 OR (final_status IS NULL AND status = 0)",
    "r.brand = 'Brand#11' AND r.category = 'ECONOMY'"))
def run_summary_overlapping(t):
    where = (F.col("brand") == "Brand#11") & (F.col("category") == "ECONOMY")
    return I.run_summary(t.fx_iteration, t.fx_iteration_item, t.fx_product, where, overlapping=True)


AVERAGED = """SELECT system_product_id, CAST(avg(status) >= 0.5 AS INT) AS dbs_status,
  CAST(CASE WHEN coalesce(avg(outlier_mode), 0) >= 0.5 THEN 0 ELSE CAST(avg(status) >= 0.5 AS INT) END AS INT) AS final_status,
  CAST(CASE WHEN coalesce(avg(outlier_mode), 0) >= 0.5 THEN 1 END AS INT) AS outlier_mode
FROM fx_iteration_item GROUP BY system_product_id"""


@query("A14_averaged_status", AVERAGED)
def averaged_status(t):
    return I.averaged_status(t.fx_iteration_item)


def vote_sql(source: str, where: str) -> str:
    return f"""SELECT system_product_id, max(v) FILTER (algo_id = 'IQR') AS iqr_status, max(v) FILTER (algo_id = 'DBSCAN') AS dbs_status,
  min(v) AS final_status, CAST(CASE WHEN min(v) = 0 THEN max(CASE WHEN v = 0 AND manual > 0 THEN 1 ELSE 0 END) END AS INT) AS outlier_mode
FROM (SELECT system_product_id, algo_id, CAST(CASE WHEN avg(1.0E0 - status) >= 0.5 THEN 0 ELSE 1 END AS INT) AS v,
  count(*) FILTER (status = 0 AND outlier_mode = 1) AS manual FROM ({source}) s WHERE {where} GROUP BY system_product_id, algo_id) a
GROUP BY system_product_id"""


@query("A15_majority_vote", vote_sql("SELECT * FROM fx_iteration_result", "category = 'SMALL'"))
def majority_vote(t):
    return I.majority_vote(t.fx_iteration_result, "SMALL")


@query("A22_cluster_statistics", """
SELECT iteration_id, cluster, count(*) AS cluster_items,
  round(count(*) * 100.0E0 / sum(count(*)) OVER (PARTITION BY iteration_id), 2) AS cluster_items_per
FROM fx_iteration_item GROUP BY iteration_id, cluster""")
def cluster_statistics(t):
    return I.cluster_statistics(t.fx_iteration_item)


@query("W04_cluster_share", """
SELECT id, count(*) OVER (PARTITION BY iteration_id, cluster) AS cluster_items,
  round(count(*) OVER (PARTITION BY iteration_id, cluster) * 100.0E0 / count(*) OVER (PARTITION BY iteration_id), 2) AS cluster_items_per
FROM fx_iteration_item""")
def cluster_share(t):
    return items(t).select("id", "cluster_items", "cluster_items_per")


# --- grids -----------------------------------------------------------------------------------

def items(t):
    """Items with the size and share of their cluster."""
    rows = t.fx_iteration_item
    return rows.join(I.cluster_statistics(rows), ["iteration_id", "cluster"])


ITEM = """(SELECT *, count(*) OVER (PARTITION BY iteration_id, cluster) AS cluster_items,
  round(count(*) OVER (PARTITION BY iteration_id, cluster) * 100.0E0 / count(*) OVER (PARTITION BY iteration_id), 2) AS cluster_items_per
  FROM fx_iteration_item)"""
RUN_ROWS = f"""fx_product p JOIN {ITEM} i ON p.system_product_id = i.system_product_id JOIN fx_iteration r ON r.iteration_id = i.iteration_id"""
GRID_OUT = ["product_id", "qb_code", "brand", "category", "height", "eps", "sample", "final_status", "total_items",
            "outlier_items", "cluster_items", "cluster_items_per", "cluster"]


def shown_sql(final: str) -> str:
    return f"""p.product_id, coalesce(p.qb_code, '') AS qb_code, coalesce(p.brand, '') AS brand, coalesce(p.category, '') AS category,
  coalesce(p.height, 0) AS height, coalesce(CAST(r.eps AS VARCHAR), '-') AS eps, coalesce(CAST(r.sample AS VARCHAR), '-') AS sample,
  CASE {final} WHEN 1 THEN 'Normal' WHEN 0 THEN 'Outlier' ELSE 'Pending to Analyze' END AS final_status,
  coalesce(r.total_items, 0) AS total_items, coalesce(r.outlier_items, 0) AS outlier_items, coalesce(i.cluster_items, 0) AS cluster_items,
  coalesce(i.cluster_items_per, 0) AS cluster_items_per, coalesce(i.cluster, '') AS cluster"""


@query("J03_run_rows", f"""
SELECT p.product_id, i.id, p.category, i.status, i.final_status, r.eps, r.sample, i.cluster, i.cluster_items FROM {RUN_ROWS}""")
def run_rows(t):
    return G.run_rows(t.fx_product, items(t), t.fx_iteration).select(
        "product_id", F.col("_tie").alias("id"), "category", "status", "final_status", "eps", "sample", "cluster", "cluster_items")


@query("P11_run_filter", f"""
SELECT p.product_id, i.id, i.cluster, i.final_status FROM {RUN_ROWS} WHERE r.iteration_id = 5 AND p.category IN ('SMALL', 'LARGE')
  AND i.cluster IN ('Cluster 0', 'Cluster 2', 'Noise/Outlier') AND (i.final_status IS NULL OR i.final_status = 0) AND p.skip_status = 1""")
def run_filter(t):
    rows = G.run_rows(t.fx_product, items(t), t.fx_iteration).filter(G.run_filter(
        5, categories=["SMALL", "LARGE"], clusters=[0, 2, -1], final_status=["Pending to Analyze", "Outlier"], skip_status=["Yes"]))
    return rows.select("product_id", F.col("_tie").alias("id"), "cluster", "final_status")


RUN_PAGE = f"""
SELECT {shown_sql('i.final_status')} FROM {RUN_ROWS} WHERE r.iteration_id = 5
ORDER BY p.category NULLS FIRST, i.cluster_items NULLS FIRST, i.cluster NULLS FIRST, p.product_id, i.id LIMIT 50 OFFSET 50"""


@query("R02_run_page", RUN_PAGE)
def run_page(t):
    return G.run_page(t.fx_product, items(t), t.fx_iteration, 5, 2, 50).select(*GRID_OUT)


def grid_of_run(t):
    return G.run_rows(t.fx_product, items(t), t.fx_iteration).filter(G.run_filter(5))


@query("R02_page_by_index", RUN_PAGE)
def page_by_index(t):
    return G.displayed(G.page_index(grid_of_run(t)).page(2, 50)).select(*GRID_OUT)


@query("R02_page_after_the_last_row", RUN_PAGE)
def page_after_the_last_row(t):
    before = G.page_after(grid_of_run(t), 50).collect()
    return G.displayed(G.page_after(grid_of_run(t), 50, before[-1].asDict() if before else None)).select(*GRID_OUT)


LATEST = f"""fx_product p LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY system_product_id ORDER BY iteration_id DESC, id DESC) AS rn
  FROM {ITEM} y) x WHERE rn = 1) i ON p.system_product_id = i.system_product_id LEFT JOIN fx_iteration r ON r.iteration_id = i.iteration_id"""


@query("J04_latest_rows", f"SELECT p.product_id, i.iteration_id, r.eps, r.sample, i.cluster FROM {LATEST}")
def latest_rows(t):
    return G.latest_rows(t.fx_product, items(t), t.fx_iteration).select("product_id", "iteration_id", "eps", "sample", "cluster")


@query("R01_sorted_by_number", f"""
SELECT {shown_sql('p.final_status')} FROM {LATEST} ORDER BY CAST(p.system_product_id AS BIGINT) DESC, p.product_id LIMIT 40""")
def sorted_by_number(t):
    rows = G.latest_rows(t.fx_product, items(t), t.fx_iteration)
    return G.displayed(G.page(rows, 1, 40, "system_product_id", "desc")).select(*GRID_OUT)


@query("R06_main_page", f"""
SELECT {shown_sql('p.final_status')}, coalesce(h.history, '') AS history FROM {LATEST} LEFT JOIN ({HISTORY_TEXT}) h ON h.system_product_id = p.system_product_id
WHERE p.group_id = 1 AND (p.final_status IS NULL OR p.final_status = 1)
ORDER BY p.category NULLS FIRST, i.cluster_items NULLS FIRST, i.cluster NULLS FIRST, p.product_id LIMIT 100 OFFSET 100""")
def main_page(t):
    rows = G.main_page(t.fx_product, items(t), t.fx_iteration, 1, 2, 100, final_status=["Pending to Analyze", "Normal"])
    return rows.select(*GRID_OUT, F.coalesce(I.history_text(F.col("history")), F.lit("")).alias("history"))


@query("P10_newest_cluster_filter", f"""
SELECT p.product_id, i.cluster FROM {LATEST} WHERE p.group_id = 2 AND i.cluster IN ('Cluster 1', 'Noise/Outlier')""")
def newest_cluster_filter(t):
    return G.main_rows(t.fx_product, items(t), t.fx_iteration, 2, clusters=[1, -1]).select("product_id", "cluster")


@query("S18_grid_export", f"""
SELECT p.system_product_id AS "Product ID", p.qb_code AS "QB Code", coalesce(r.eps || '', '-') AS "EPS", coalesce(CAST(i.cluster_items AS BIGINT), 0) AS "Cluster Items",
  printf('%.2f%%', coalesce(i.cluster_items_per, 0)) AS "Cluster Items (%)", CASE p.skip_status WHEN 1 THEN 'Yes' WHEN 0 THEN 'No' ELSE '-' END AS "Skip Status",
  CASE p.final_status WHEN 1 THEN 'Normal' WHEN 0 THEN 'Outlier' ELSE 'Pending to Analyze' END AS "Final Status", coalesce(h.history, '') AS "Final Status History"
FROM {LATEST} LEFT JOIN ({HISTORY_TEXT}) h ON h.system_product_id = p.system_product_id WHERE p.group_id = 1""")
def grid_export(t):
    rows = G.export_rows(t.fx_product, items(t), t.fx_iteration, 1)
    return rows.select("Product ID", "QB Code", "EPS", "Cluster Items", F.col("`Cluster Items (%)`"), "Skip Status",
                       "Final Status", "Final Status History")


@query("S19_highlight_flags", """
SELECT product_id, coalesce(iqr_status = 0, FALSE) AS height_marked, coalesce(dbs_status = 0, FALSE) AS width_marked,
  coalesce(final_status = 0, FALSE) AS depth_marked FROM fx_product""")
def highlight_flags(t):
    rows = t.fx_product.withColumnsRenamed(
        {"iqr_status": "iqr_height_status", "dbs_status": "iqr_width_status"}).withColumn("iqr_depth_status", F.col("final_status"))
    return G.highlight_flags(rows).select("product_id", "height_marked", "width_marked", "depth_marked")


# --- keyed changes ---------------------------------------------------------------------------

def graded(t):
    """Products with the columns a correction writes."""
    return t.fx_product.select(
        "product_id", "system_product_id", "group_id", "qb_code", "category", "brand", "final_status", "dbs_status", "iqr_status",
        "outlier_mode", "iteration_closed", "skip_status", F.lit(None).cast("double").alias("eps"),
        F.lit(None).cast("int").alias("sample"), F.lit(None).cast("timestamp_ntz").alias("analyzed_date"))


STATE = ["product_id", "final_status", "dbs_status", "eps", "sample", "date"]


def state(df):
    return df.withColumn("date", F.date_format("analyzed_date", "yyyy-MM-dd HH:mm:ss"))


@query("U01_keyed_update", """
SELECT p.product_id, CASE WHEN l.l_partkey IS NOT NULL THEN l.q ELSE p.height END AS height,
  CASE WHEN l.l_partkey IS NOT NULL THEN NULL ELSE p.brand END AS brand
FROM fx_product p LEFT JOIN (SELECT l_partkey, max(l_quantity) AS q FROM lineitem WHERE l_shipdate < TIMESTAMP '1993-01-01' GROUP BY l_partkey) l
  ON l.l_partkey = p.product_id""")
def keyed_update(t):
    news = t.lineitem.filter("l_shipdate < timestamp '1993-01-01'").groupBy(F.col("l_partkey").alias("product_id")).agg(
        F.max("l_quantity").alias("height"), F.lit(None).cast("string").alias("brand"))
    return apply_updates(t.fx_product, news, ["product_id"]).select("product_id", "height", "brand")


@query("U01_keyed_delete", """
SELECT product_id FROM fx_product WHERE product_id NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)""")
def keyed_delete(t):
    gone = t.lineitem.filter("l_quantity > 49").select(F.col("l_partkey").alias("product_id"))
    return t.fx_product.join(gone, "product_id", "left_anti").select("product_id")


@query("U02_update_where", """
SELECT product_id, CASE WHEN final_status = 0 AND height > 20 THEN 1 ELSE skip_status END AS skip_status FROM fx_product""")
def update_where(t):
    where = condition("final_status", "=", 0) & condition("height", ">", 20)
    return set_where(t.fx_product, where, {"skip_status": 1}).select("product_id", "skip_status")


@query("U02_delete_where", "SELECT product_id FROM fx_product WHERE NOT coalesce(final_status = 0 AND height > 20, FALSE)")
def delete_rows_where(t):
    return delete_where(t.fx_product, (F.col("final_status") == 0) & (F.col("height") > 20)).select("product_id")


@query("U03_saved_header", """
SELECT iteration_id, category, eps, sample FROM fx_iteration UNION ALL
SELECT (SELECT max(iteration_id) FROM fx_iteration) + row_number() OVER (ORDER BY category), category, 1.0E0, CAST(4 AS INT)
FROM (SELECT DISTINCT category FROM fx_product) c""")
def saved_header(t):
    new = t.fx_product.select("category").distinct().withColumns({"eps": F.lit(1.0), "sample": F.lit(4)})
    return I.save_header(t.fx_iteration, new).select("iteration_id", "category", "eps", "sample")


@query("U04_cascade_delete", """
SELECT id, iteration_id FROM fx_iteration_item WHERE iteration_id NOT IN (SELECT iteration_id FROM fx_iteration WHERE eps = 2.0)""")
def cascade_delete(t):
    gone = t.fx_iteration.filter("eps = 2.0").select("iteration_id")
    return I.delete_runs(t.fx_iteration, t.fx_iteration_item, gone)[1].select("id", "iteration_id")


@query("U05_delete_by_filters", """
SELECT iteration_id, category, eps FROM fx_iteration WHERE NOT (category = 'SMALL' AND eps = 1.0 AND algorithm = 'DBSCAN')""")
def delete_by_filters(t):
    kept, _ = I.delete_matching_runs(t.fx_iteration, t.fx_iteration_item, category="SMALL", eps=1.0, algorithm="DBSCAN")
    return kept.select("iteration_id", "category", "eps")


@query("U06_reset_runs", """
SELECT product_id, CASE WHEN hit THEN NULL ELSE final_status END AS final_status, CASE WHEN hit THEN NULL ELSE dbs_status END AS dbs_status, iqr_status
FROM (SELECT *, system_product_id IN (SELECT system_product_id FROM fx_iteration_item WHERE iteration_id IN
  (SELECT iteration_id FROM fx_iteration WHERE product_group_id = 2 AND category = 'SMALL')) AS hit FROM fx_product) p""")
def reset_runs(t):
    _, _, products = I.reset_runs(t.fx_iteration, t.fx_iteration_item, graded(t), 2, "SMALL")
    return products.select("product_id", "final_status", "dbs_status", "iqr_status")


@query("U07_reset_fields", """
SELECT product_id, CASE WHEN hit THEN NULL ELSE iqr_status END AS iqr_status, CASE WHEN hit THEN NULL ELSE final_status END AS final_status,
  CASE WHEN hit THEN NULL ELSE outlier_mode END AS outlier_mode, CASE WHEN hit THEN NULL ELSE iteration_closed END AS iteration_closed
FROM (SELECT *, group_id = 1 AND category = 'SMALL' AS hit FROM fx_product) p""")
def reset_fields(t):
    return I.reset_fields(graded(t), 1, category="SMALL").select(
        "product_id", "iqr_status", "final_status", "outlier_mode", "iteration_closed")


@query("U07_deleted_results", "SELECT id FROM fx_iteration_result WHERE NOT (category = 'SMALL' AND brand = 'Brand#2')")
def deleted_results(t):
    return I.delete_results(t.fx_iteration_result, ["Brand#2"], "SMALL").select("id")


@query("U08_aggregated_update", f"""
SELECT p.product_id, p.iqr_status, CASE WHEN a.system_product_id IS NULL THEN p.dbs_status ELSE a.dbs_status END AS dbs_status,
  CASE WHEN a.system_product_id IS NULL THEN p.final_status ELSE a.final_status END AS final_status,
  CASE WHEN a.system_product_id IS NULL THEN p.outlier_mode ELSE a.outlier_mode END AS outlier_mode,
  CASE WHEN a.system_product_id IS NOT NULL THEN '{STAMP}' END AS date
FROM fx_product p LEFT JOIN ({AVERAGED}) a ON a.system_product_id = p.system_product_id""")
def aggregated_update(t):
    rows = I.update_status_fields(graded(t), I.averaged_status(t.fx_iteration_item), stamp())
    return state(rows).select("product_id", "iqr_status", "dbs_status", "final_status", "outlier_mode", "date")


@query("U09_iqr_fields", """
SELECT product_id, CAST(CASE WHEN height > 40 THEN 0 ELSE 1 END AS INT) AS iqr_status, CAST(CASE WHEN height > 40 THEN 0 ELSE 1 END AS INT) AS iqr_height_status FROM fx_product""")
def iqr_fields(t):
    base = graded(t).withColumn("iqr_height_status", F.lit(None).cast("int"))
    flag = F.when(F.col("height") > 40, 0).otherwise(1)
    news = t.fx_product.select("system_product_id", flag.alias("iqr_status"), flag.alias("iqr_height_status"))
    return I.update_status_fields(base, news).select("product_id", "iqr_status", "iqr_height_status")


@query("U10_eps_sample_update", f"""
SELECT product_id, CASE WHEN hit THEN f ELSE final_status END AS final_status, CASE WHEN hit THEN f ELSE dbs_status END AS dbs_status,
  CASE WHEN hit THEN 1.5E0 END AS eps, CAST(CASE WHEN hit THEN 3 END AS INT) AS sample, CASE WHEN hit AND f IS NOT NULL THEN '{STAMP}' END AS date
FROM (SELECT *, group_id = 1 AND depth > 20 AS hit, CAST(CASE WHEN height > 30 THEN 1 WHEN height > 10 THEN 0 END AS INT) AS f FROM fx_product) p""")
def eps_sample_update(t):
    h = F.col("height")
    news = t.fx_product.filter("depth > 20").select(
        "system_product_id", F.when(h > 30, 1).when(h > 10, 0).alias("final_status"),
        F.lit(1.5).alias("eps"), F.lit(3).alias("sample"))
    return state(I.update_eps_sample(graded(t), news, 1, stamp())).select(*STATE)


@query("U11_overwritten_results", """
SELECT product_id, CASE WHEN hit THEN f ELSE final_status END AS final_status, CASE WHEN hit THEN NULL ELSE iqr_status END AS iqr_status,
  CASE WHEN hit THEN CASE WHEN f = 1 THEN NULL WHEN f = 0 THEN CASE WHEN outlier_mode = 1 THEN 1 ELSE 0 END ELSE outlier_mode END ELSE outlier_mode END AS outlier_mode,
  CAST(CASE WHEN hit THEN 5 ELSE iteration_closed END AS INT) AS iteration_closed
FROM (SELECT *, skip_status IS NULL AS hit, CAST(CASE WHEN height > 30 THEN 1 WHEN height > 10 THEN 0 END AS INT) AS f FROM fx_product) p""")
def overwritten_results(t):
    h = F.col("height")
    news = t.fx_product.filter("skip_status IS NULL").select(
        "product_id", F.when(h > 30, 1).when(h > 10, 0).alias("final_status"), F.lit(5).alias("iteration_closed"))
    return I.overwrite_results(graded(t), news).select("product_id", "final_status", "iqr_status", "outlier_mode", "iteration_closed")


def codes(t, where: str):
    return t.fx_product.filter(where).select("qb_code")


@query("U12_final_status_by_code", """
SELECT product_id, CAST(CASE WHEN hit THEN 0 ELSE final_status END AS INT) AS final_status, CAST(CASE WHEN hit THEN 1 ELSE outlier_mode END AS INT) AS outlier_mode,
  CAST(CASE WHEN hit THEN 4 ELSE iteration_closed END AS INT) AS iteration_closed FROM (SELECT *, height > 35 AS hit FROM fx_product) p""")
def final_status_by_code(t):
    return I.set_final_status(graded(t), codes(t, "height > 35"), 0, 4).select(
        "product_id", "final_status", "outlier_mode", "iteration_closed")


MARKED = """SELECT r.* REPLACE (CAST(CASE WHEN hit THEN 0 ELSE status END AS INT) AS status, CAST(CASE WHEN hit THEN 1 ELSE outlier_mode END AS INT) AS outlier_mode)
FROM (SELECT *, category = 'SMALL' AND iteration_number = 2 AND system_product_id IN (SELECT system_product_id FROM fx_product WHERE height > 35) AS hit
  FROM fx_iteration_result) r"""


@query("U12_marked_outliers", f"""
SELECT p.product_id, coalesce(v.iqr_status, p.iqr_status) AS iqr_status, coalesce(v.dbs_status, p.dbs_status) AS dbs_status,
  CASE WHEN v.system_product_id IS NULL THEN p.final_status ELSE v.final_status END AS final_status,
  CASE WHEN v.system_product_id IS NULL THEN p.outlier_mode ELSE v.outlier_mode END AS outlier_mode
FROM fx_product p LEFT JOIN ({vote_sql(MARKED, "category = 'SMALL'")}) v ON v.system_product_id = p.system_product_id""")
def marked_outliers(t):
    products, _ = I.mark_outliers(graded(t), t.fx_iteration_result, codes(t, "height > 35"), None, "SMALL", 2)
    return products.select("product_id", "iqr_status", "dbs_status", "final_status", "outlier_mode")


@query("U13_skip_status", f"""
SELECT product_id, CAST(CASE WHEN width > 40 THEN 1 ELSE skip_status END AS INT) AS skip_status,
  CASE WHEN width > 40 THEN '{STAMP}' END AS date FROM fx_product""")
def skip_status(t):
    ids = t.fx_product.filter("width > 40").select("product_id")
    return state(I.set_skip(graded(t), ids, 1, stamp())).select("product_id", "skip_status", "date")


@query("U14_cluster_set_normal", f"""
SELECT product_id, CAST(CASE WHEN hit THEN 1 ELSE final_status END AS INT) AS final_status, CAST(CASE WHEN hit THEN 1 ELSE dbs_status END AS INT) AS dbs_status,
  CASE WHEN hit THEN 0.5E0 END AS eps, CAST(CASE WHEN hit THEN 2 END AS INT) AS sample, CASE WHEN hit THEN '{STAMP}' END AS date
FROM (SELECT *, group_id = 2 AND depth > 30 AS hit FROM fx_product) p""")
def cluster_set_normal(t):
    products, _ = I.correct_cluster(graded(t), t.fx_iteration_item, codes(t, "depth > 30"), 3, 1, 2,
                                    F.lit(0.5), F.lit(2), stamp())
    return state(products).select(*STATE)


@query("U14_cluster_removed", """
SELECT i.id, i.iteration_id, CASE WHEN hit THEN NULL ELSE final_status END AS final_status,
  CASE WHEN hit THEN NULL ELSE strftime(analyzed_date, '%Y-%m-%d %H:%M:%S') END AS date
FROM (SELECT *, iteration_id = 3 AND system_product_id IN (SELECT system_product_id FROM fx_product WHERE depth > 30) AS hit FROM fx_iteration_item) i""")
def cluster_removed(t):
    _, items_after = I.correct_cluster(graded(t), t.fx_iteration_item, codes(t, "depth > 30"), 3, None, 2,
                                       F.lit(1.0), F.lit(4), stamp())
    return state(items_after).select("id", "iteration_id", "final_status", "date")


@query("U15_item_status", """
SELECT id, CAST(CASE WHEN hit THEN 0 ELSE status END AS INT) AS status, CAST(CASE WHEN hit THEN 1 ELSE outlier_mode END AS INT) AS outlier_mode
FROM (SELECT *, iteration_id = 7 AND system_product_id IN (SELECT system_product_id FROM fx_product WHERE width > 25) AS hit FROM fx_iteration_item) i""")
def item_status(t):
    ids = t.fx_product.filter("width > 25").select("system_product_id")
    return I.set_item_status(t.fx_iteration_item, ids, 7, 0, 1).select("id", "status", "outlier_mode")


@query("U16_items_cleared", """
SELECT product_id, CASE WHEN hit THEN NULL ELSE final_status END AS final_status, CASE WHEN hit THEN NULL ELSE dbs_status END AS dbs_status,
  CAST(NULL AS DOUBLE) AS eps, CAST(NULL AS INT) AS sample, CAST(NULL AS VARCHAR) AS date
FROM (SELECT *, group_id = 1 AND height > 45 AS hit FROM fx_product) p""")
def items_cleared(t):
    none = F.lit(None)
    products, _ = I.correct_cluster(graded(t), t.fx_iteration_item, codes(t, "height > 45"), 3, None, 1,
                                    none.cast("double"), none.cast("int"), stamp())
    return state(products).select(*STATE)


@query("U17_marked_results", f"SELECT id, status, outlier_mode FROM ({MARKED}) m")
def marked_results(t):
    ids = P.ids_of_codes(t.fx_product, codes(t, "height > 35"))
    return I.mark_results(t.fx_iteration_result, ids, None, "SMALL", 2).select("id", "status", "outlier_mode")


SMALL_1 = f"SELECT * FROM fx_product p WHERE {MEASURED} AND {KEPT} AND group_id = 1 AND category = 'SMALL'"


@query("U18_result_rows", f"""
WITH RECURSIVE {C.points(SMALL_1, "category")}, {C.clusters()}
SELECT p.system_product_id, a.algo_id, 'Brand#11, Brand#12' AS brand, 'SMALL' AS category, CAST(CASE WHEN c.cluster = -1 THEN 0 ELSE 1 END AS INT) AS status,
  CASE WHEN a.algo_id = 'DBSCAN' THEN 1.0E0 END AS eps, CAST(CASE WHEN a.algo_id = 'DBSCAN' THEN 4 END AS INT) AS sample,
  CASE WHEN a.algo_id = 'DBSCAN' THEN CASE WHEN c.cluster = -1 THEN 'Noise/Outlier' ELSE concat('Cluster ', CAST(c.cluster AS VARCHAR)) END END AS cluster
FROM ({SMALL_1}) p LEFT JOIN clus c ON c.id = p.product_id CROSS JOIN (SELECT unnest(['IQR', 'DBSCAN']) AS algo_id) a""")
def result_rows(t):
    rows = P.products_filtered(t.fx_product, 1, category="SMALL")
    labelled = A.label_outliers(rows, [], ["DBSCAN"])
    return I.result_rows(labelled, ["IQR", "DBSCAN"], 3, ["Brand#11", "Brand#12"], "SMALL", 1.0, 4).drop(
        "iteration_number", "outlier_mode")


SMALL_3 = f"SELECT * FROM fx_product p WHERE {MEASURED} AND {KEPT} AND group_id = 3 AND category = 'SMALL'"
SAVED_ITEMS = f"""saved AS (SELECT system_product_id, iteration_id, status, outlier_mode FROM fx_iteration_item WHERE iteration_id NOT IN
    (SELECT iteration_id FROM fx_iteration WHERE product_group_id = 3 AND category = 'SMALL' AND eps = 1.0 AND sample = 4)
  UNION ALL SELECT p.system_product_id, (SELECT max(iteration_id) FROM fx_iteration WHERE NOT (product_group_id = 3 AND category = 'SMALL' AND eps = 1.0 AND sample = 4)) + 1,
    CAST(CASE WHEN n.noise THEN 0 ELSE 1 END AS INT), CAST(CASE WHEN n.noise THEN 0 END AS INT) FROM ({SMALL_3}) p JOIN noise n ON n.id = p.product_id),
vote AS (SELECT system_product_id, avg(status) AS s, avg(outlier_mode) AS m FROM saved WHERE system_product_id IN
  (SELECT p.system_product_id FROM ({SMALL_3}) p JOIN noise n ON n.id = p.product_id) GROUP BY system_product_id)"""


def saved_run(t):
    rows = A.population(t.fx_product, t.fx_iteration_item, 3, category="SMALL")
    labelled = A.label_outliers(rows, [], ["DBSCAN"])
    header = A.run_header(labelled, P.header_counts(t.fx_product, 3, category="SMALL"), 3, "SMALL", 1.0, 4, "run-9")
    found = A.run_items(labelled)
    _, after = I.save_run(t.fx_iteration, t.fx_iteration_item, header, found, group_id=3, category="SMALL", eps=1.0, sample=4)
    return found, after


@query("X12_saved_run_items", f"""
WITH {C.points(SMALL_3, "1")}, {C.noise()}, {SAVED_ITEMS} SELECT iteration_id, status, outlier_mode, count(*) AS n FROM saved GROUP BY iteration_id, status, outlier_mode""")
def saved_run_items(t):
    return saved_run(t)[1].groupBy("iteration_id", "status", "outlier_mode").agg(F.count(F.lit(1)).alias("n"))


@query("X20_refreshed_products", f"""
WITH {C.points(SMALL_3, "1")}, {C.noise()}, {SAVED_ITEMS}
SELECT p.product_id, CAST(CASE WHEN v.s IS NULL THEN p.dbs_status WHEN v.s >= 0.5 THEN 1 ELSE 0 END AS INT) AS dbs_status,
  CAST(CASE WHEN v.s IS NULL THEN p.final_status WHEN v.m >= 0.5 THEN 0 WHEN v.s >= 0.5 THEN 1 ELSE 0 END AS INT) AS final_status,
  CAST(CASE WHEN v.s IS NULL THEN p.outlier_mode WHEN v.m >= 0.5 THEN 1 END AS INT) AS outlier_mode
FROM fx_product p LEFT JOIN vote v ON v.system_product_id = p.system_product_id""")
def refreshed_products(t):
    found, after = saved_run(t)
    return I.refresh_products(graded(t), after, found.select("system_product_id"), stamp()).select(
        "product_id", "dbs_status", "final_status", "outlier_mode")


@query("U20_swapped_dimensions", """
SELECT product_id, CASE WHEN category = 'SMALL' THEN width ELSE height END AS height,
  CASE WHEN category = 'SMALL' THEN height ELSE width END AS width FROM fx_product""")
def swapped_dimensions(t):
    return I.swap_dimensions(t.fx_product, F.col("category") == "SMALL", "height", "width").select(
        "product_id", "height", "width")


@query("U21_restored_dimensions", """
SELECT product_id, CASE WHEN group_id = 1 THEN coalesce(ori_height, height) ELSE height END AS height,
  CASE WHEN group_id = 1 THEN coalesce(ori_width, width) ELSE width END AS width FROM fx_product""")
def restored_dimensions(t):
    return I.restore_dimensions(t.fx_product, F.col("group_id") == 1).select("product_id", "height", "width")
