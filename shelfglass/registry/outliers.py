"""Fences, flags, clustering and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfglass.functions import display as D
from shelfglass.functions.predicates import measured, not_skipped
from shelfglass.operators import outliers as O
from shelfglass.operators.dbscan import add_features, chosen_settings, dbscan
from shelfglass.plans import analysis as A
from shelfglass.plans import products as P
from shelfglass.registry import clusters_sql as C
from shelfglass.registry.base import query
from shelfglass.sources import exports, product_files
from shelfglass.staging import stage

DIMS = ("height", "width", "depth")
BOUNDS = ("q1", "q3", "iqr", "lower", "upper")
MEASURED = "height IS NOT NULL AND width IS NOT NULL AND depth IS NOT NULL"
ANALYSED = f"""SELECT * FROM fx_product WHERE {MEASURED} AND (skip_status IS NULL OR skip_status <> 1)"""
FILE_CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
IN_FILE = f"category IN ({', '.join(repr(c) for c in FILE_CATEGORIES)})"
GROUP_1 = ANALYSED + " AND group_id = 1"


def analysed(t, group_id: int | None = None):
    """Products that take part in an analysis."""
    rows = t.fx_product.filter(measured() & not_skipped())
    return rows if group_id is None else rows.filter(F.col("group_id") == group_id)


def bounds_sql(keys: str, source: str, m=1.5, clip: bool = False) -> str:
    """Reference text: fences per key group."""
    parts = []
    for i, d in enumerate(DIMS):
        k = m[i] if isinstance(m, tuple) else m
        q1, q3 = f"quantile_cont({d}, 0.25)", f"quantile_cont({d}, 0.75)"
        lower, upper = f"{q1} - {k}E0 * ({q3} - {q1})", f"{q3} + {k}E0 * ({q3} - {q1})"
        if clip:
            lower, upper = f"greatest({lower}, min({d}))", f"least({upper}, max({d}))"
        for n, e in zip(BOUNDS, (q1, q3, f"{q3} - {q1}", lower, upper), strict=True):
            parts.append(f"CASE WHEN count(*) >= 4 THEN {e} ELSE 0.0E0 END AS {d}_{n}")
    sel, grp = (f"{keys}, ", f" GROUP BY {keys}") if keys else ("", "")
    return f"SELECT {sel}count(*) AS n, {', '.join(parts)} FROM ({source}) s{grp}"


def flag_sql(d: str) -> str:
    return f"coalesce((p.{d} < b.{d}_lower OR p.{d} > b.{d}_upper) AND b.n >= 4, FALSE)"


ANY = "(" + " OR ".join(flag_sql(d) for d in DIMS) + ")"
ROUNDED = ", ".join(f"round({d}_{n}, 6) AS {d}_{n}" for d in DIMS for n in BOUNDS)
EDGES = ", ".join(f"round(b.{d}_lower, 6) AS {d}_lower, round(b.{d}_upper, 6) AS {d}_upper" for d in DIMS)
EDGE_NAMES = [f"{d}_{s}" for d in DIMS for s in ("lower", "upper")]


def typed_sql(source: str, m=1.5) -> str:
    """Rows p with the fences b of their type."""
    return f"({source}) p JOIN ({bounds_sql('product_type', source, m)}) b ON p.product_type = b.product_type"


def rounded(df, columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- fences ----------------------------------------------------------------------------------

@query("X01_bounds_clipped", f"SELECT category, n, {ROUNDED} FROM (" + bounds_sql("category", ANALYSED, clip=True) + ") b")
def bounds_clipped(t):
    return rounded(O.iqr_bounds(analysed(t), ["category"], clip=True), O.bound_columns())


MULTIPLIERS = {"height": 1.0, "width": 2.0, "depth": 2.5}


@query("X02_bounds_per_multiplier", f"SELECT category, n, {ROUNDED} FROM (" + bounds_sql("category", ANALYSED, (1.0, 2.0, 2.5)) + ") b")
def bounds_per_multiplier(t):
    return rounded(O.iqr_bounds(analysed(t), ["category"], multipliers=MULTIPLIERS), O.bound_columns())


@query("X03_type_bounds_per_population", f"""
SELECT p.product_id, coalesce(b.n, 0) AS n, {", ".join(f"round(coalesce(b.{d}_lower, 0), 6) AS {d}_lower, round(coalesce(b.{d}_upper, 0), 6) AS {d}_upper" for d in DIMS)}
FROM (SELECT *, CASE WHEN skip_status = 0 THEN NULL ELSE product_type END AS kind FROM ({ANALYSED}) q) p
LEFT JOIN ({bounds_sql('category, kind', f"SELECT *, CASE WHEN skip_status = 0 THEN NULL ELSE product_type END AS kind FROM ({ANALYSED}) q")}) b
  ON p.category = b.category AND p.kind = b.kind""")
def type_bounds_per_population(t):
    rows = analysed(t).withColumn(
        "kind", F.when(F.col("skip_status").isNull(), F.col("product_type")))
    return rounded(O.with_type_bounds(rows, "kind", ["category"]), EDGE_NAMES).select(
        "product_id", "n", *EDGE_NAMES)


@query("X04_type_iqr_flags", f"""
SELECT p.product_id, p.product_type, b.n, {EDGES}, {", ".join(f"{flag_sql(d)} AS iqr_{d}_outlier" for d in DIMS)}, {ANY} AS iqr_is_outlier
FROM {typed_sql(ANALYSED)}""")
def type_iqr_flags(t):
    flagged = O.flag_outside(O.with_type_bounds(analysed(t)))
    return rounded(flagged, EDGE_NAMES).select(
        "product_id", "product_type", "n", *EDGE_NAMES, *[f"iqr_{d}_outlier" for d in DIMS],
        "iqr_is_outlier")


@query("X05_outlier_texts", f"""
SELECT p.product_id, {", ".join(f"CASE WHEN {flag_sql(d)} THEN 'Yes' ELSE 'No' END AS iqr_o_{d}" for d in DIMS)} FROM {typed_sql(ANALYSED)}""")
def outlier_texts(t):
    flagged = O.flags_as_outlier_text(O.flag_outside(O.with_type_bounds(analysed(t))))
    return flagged.select("product_id", *[f"iqr_o_{d}" for d in DIMS])


@query("X06_status_numbers", f"""
SELECT p.product_id, {", ".join(f"CAST(CASE WHEN {flag_sql(d)} THEN 0 ELSE 1 END AS INT) AS iqr_{d}_status" for d in DIMS)},
  CAST(CASE WHEN {ANY} THEN 0 ELSE 1 END AS INT) AS iqr_status FROM {typed_sql(ANALYSED)}""")
def status_numbers(t):
    flagged = O.flags_as_status(O.flag_outside(O.with_type_bounds(analysed(t))))
    return flagged.select("product_id", *[f"iqr_{d}_status" for d in DIMS], "iqr_status")


@query("X07_valid_texts", f"""
SELECT p.product_id, {", ".join(f"CASE WHEN {flag_sql(d)} OR b.n < 4 THEN 'No' ELSE 'Yes' END AS iqr_{d}" for d in DIMS)},
  CASE WHEN {ANY} OR b.n < 4 THEN 'No' ELSE 'Yes' END AS iqr_status
FROM ({ANALYSED}) p JOIN ({bounds_sql("category", ANALYSED)}) b ON p.category = b.category""")
def valid_texts(t):
    flagged = O.flags_as_valid_text(O.flag_outside(O.with_type_bounds(analysed(t), None, ["category"])))
    return flagged.select("product_id", *[f"iqr_{d}" for d in DIMS], "iqr_status")


@query("A23_iqr_statistics", f"""
SELECT p.category, count(*) AS total, count(*) FILTER ({ANY}) AS outliers, count(*) FILTER (NOT {ANY}) AS normals,
  CAST(0 AS BIGINT) AS excluded, round(count(*) FILTER ({ANY}) * 100.0E0 / count(*), 2) AS outlier_pct
FROM {typed_sql(ANALYSED)} GROUP BY p.category""")
def iqr_statistics(t):
    return O.outlier_totals(O.flag_outside(O.with_type_bounds(analysed(t))), "iqr_is_outlier", ["category"])


DISTANCE = " + ".join(f"greatest(b.{d}_lower - p.{d}, 0) + greatest(p.{d} - b.{d}_upper, 0)" for d in DIMS)


@query("X16_top_outliers_by_fences", f"""
SELECT p.product_id, round({DISTANCE}, 6) AS outlier_score FROM {typed_sql(ANALYSED)} WHERE {ANY}
ORDER BY round({DISTANCE}, 9) DESC, p.product_id LIMIT 20""")
def top_outliers_by_fences(t):
    flagged = O.flag_outside(O.with_type_bounds(analysed(t)))
    return rounded(O.top_outliers(flagged, "iqr_is_outlier", "product_id", 20), ["outlier_score"]).select(
        "product_id", "outlier_score")


FAR = "sqrt((p.height - c.h) * (p.height - c.h) + (p.width - c.w) * (p.width - c.w) + (p.depth - c.d) * (p.depth - c.d))"


@query("X16_top_outliers_by_centroid", f"""
SELECT p.product_id, round({FAR}, 6) AS outlier_score FROM {typed_sql(ANALYSED)}
CROSS JOIN (SELECT avg(height) AS h, avg(width) AS w, avg(depth) AS d FROM ({ANALYSED}) a) c WHERE {ANY}
ORDER BY round({FAR}, 9) DESC, p.product_id LIMIT 20""")
def top_outliers_by_centroid(t):
    flagged = O.flag_outside(O.with_type_bounds(analysed(t)))
    top = O.top_outliers(flagged, "iqr_is_outlier", "product_id", 20, by_fences=False)
    return rounded(top, ["outlier_score"]).select("product_id", "outlier_score")


@query("A29_axis_extents", f"""SELECT {", ".join(f"round(min({d}) - greatest((max({d}) - min({d})) * 0.15E0, 5), 6) AS {d}_from, round(max({d}) + greatest((max({d}) - min({d})) * 0.15E0, 5), 6) AS {d}_to" for d in DIMS)}
FROM ({ANALYSED}) p""")
def axis_extents(t):
    out = O.axis_extents(analysed(t))
    return rounded(out, out.columns)


@query("F19_shown_lower_bounds", f"SELECT category, {', '.join(f'round(greatest({d}_lower, 0), 6) AS {d}_lower' for d in DIMS)} FROM ({bounds_sql('category', ANALYSED)}) b")
def shown_lower_bounds(t):
    return O.iqr_bounds(analysed(t), ["category"]).select(
        "category", *[F.round(D.at_least_zero(F.col(f"{d}_lower")), 6).alias(f"{d}_lower") for d in DIMS])


@query("X22_standardised", f"""
SELECT product_id, {", ".join(f"round(({d} - avg({d}) OVER w) / CASE WHEN stddev_pop({d}) OVER w = 0 THEN 1 ELSE stddev_pop({d}) OVER w END, 6) AS z_{d}" for d in DIMS)}
FROM ({ANALYSED}) p WINDOW w AS (PARTITION BY category)""")
def standardised(t):
    return rounded(O.standardized(analysed(t), ["category"], DIMS), [f"z_{d}" for d in DIMS]).select(
        "product_id", *[f"z_{d}" for d in DIMS])


@query("T04_chosen_features", """
SELECT product_id, round(height / (width + 1e-6), 6) AS hw, round(width / (depth + 1e-6), 6) AS wd,
  round(height / (depth + 1e-6), 6) AS hd, round(height * width * depth, 4) AS volume
FROM fx_product WHERE height > 0 AND width > 0 AND depth > 0""")
def chosen_features(t):
    rows = t.fx_product.filter("height > 0 AND width > 0 AND depth > 0")
    featured, _ = add_features(rows, chosen_settings(["Shape ", "VOLUME", "colour"]))
    return featured.select("product_id", F.round("f_hw", 6).alias("hw"), F.round("f_wd", 6).alias("wd"),
                           F.round("f_hd", 6).alias("hd"), F.round("f_volume", 4).alias("volume"))


# --- clustering ------------------------------------------------------------------------------

@query("X08_dbscan_clusters", f"""
WITH RECURSIVE {C.points(ANALYSED, "concat(category, '/', CAST(group_id AS VARCHAR))")}, {C.clusters()}
SELECT p.product_id, c.cluster FROM ({ANALYSED}) p LEFT JOIN clus c ON c.id = p.product_id""")
def dbscan_clusters(t):
    return dbscan(analysed(t), ["category", "group_id"], "product_id").select("product_id", "cluster")


@query("J14_neighbour_counts", f"""
WITH {C.points(ANALYSED, "concat(category, '/', CAST(group_id AS VARCHAR))", ("shape",))}, {C.noise(0.5, 3)}
SELECT g, count(*) FILTER (noise) AS noise, count(*) AS points FROM noise GROUP BY g""")
def neighbour_counts(t):
    rows = dbscan(analysed(t), ["category", "group_id"], "product_id", [(0.5, 3)], ["shape"])
    return rows.filter(F.col("cluster").isNotNull()).groupBy(
        F.concat_ws("/", "category", F.col("group_id").cast("string")).alias("g")).agg(
        F.count_if(F.col("cluster") == -1).alias("noise"), F.count(F.lit(1)).alias("points"))


@query("X09_dbscan_raw_dimensions", f"""
WITH RECURSIVE {C.points(ANALYSED, "concat(category, '/', CAST(group_id AS VARCHAR))", ("size",), False)}, {C.clusters()}
SELECT id AS product_id, cluster, CASE WHEN cluster = -1 THEN 'Yes' ELSE 'No' END AS dbscan_o_height FROM clus""")
def dbscan_raw_dimensions(t):
    rows = dbscan(analysed(t), ["category", "group_id"], "product_id", settings=["size"], drop_nonpositive=False)
    return rows.select("product_id", "cluster", D.yes_no(F.col("cluster") == -1).alias("dbscan_o_height"))


@query("X17_cluster_labels", """
SELECT id, cluster AS label, CAST(CASE WHEN cluster LIKE 'Cluster %' THEN CAST(replace(cluster, 'Cluster ', '') AS INT) ELSE -1 END AS INT) AS number
FROM fx_iteration_item""")
def cluster_labels(t):
    rows = t.fx_iteration_item.select("id", D.cluster_number(F.col("cluster")).alias("number"))
    return rows.select("id", D.cluster_label(F.col("number")).alias("label"), "number")


# --- analyses --------------------------------------------------------------------------------

def chart_rows(t, algorithms=("IQR", "DBSCAN")):
    """The chart analysis: one population, raw dimensions, fences per type."""
    return A.label_outliers(analysed(t), [], algorithms, settings=["size"], drop_nonpositive=False)


CHART = f"WITH {C.points(ANALYSED, '1', ('size',), False)}, {C.noise()}"
CHART_FROM = f"{typed_sql(ANALYSED)} JOIN noise n ON n.id = p.product_id"


@query("X10_combined_flags", f"""
{CHART} SELECT p.product_id, {ANY} AS iqr_is_outlier, n.noise AS dbscan_is_outlier, {ANY} AND n.noise AS is_outlier_combined FROM {CHART_FROM}""")
def combined_flags(t):
    return chart_rows(t).select("product_id", "iqr_is_outlier", "dbscan_is_outlier", "is_outlier_combined")


EXPORT = f"""
SELECT p.brand, p.category, p.product_type, p.product_id, p.qb_code, p.height, p.width, p.depth,
  CASE WHEN {ANY} THEN 'No' ELSE 'Yes' END AS iqr_status, {", ".join(f"CASE WHEN {flag_sql(d)} THEN 'Yes' ELSE 'No' END AS iqr_{d}" for d in DIMS)},
  CASE WHEN n.noise THEN 'No' ELSE 'Yes' END AS dbscan_status, {", ".join(f"CASE WHEN n.noise THEN 'Yes' ELSE 'No' END AS dbscan_{d}" for d in DIMS)}
FROM {CHART_FROM}"""


@query("S13_labelled_export", f"{CHART} {EXPORT}")
def labelled_export(t):
    export = exports.labelled_export(chart_rows(t), ["IQR", "DBSCAN"]).drop("dbscan_cluster")
    return exports.drop_empty_columns(export)


@query("S14_outlier_split", f"{CHART} SELECT * FROM ({EXPORT}) e WHERE iqr_status = 'No' AND dbscan_status = 'No'")
def outlier_split(t):
    return exports.split_export(exports.labelled_export(chart_rows(t), ["IQR", "DBSCAN"]), "outliers").drop("dbscan_cluster")


@query("S14_normal_split_iqr", f"""
SELECT p.product_id FROM {typed_sql(ANALYSED)} WHERE NOT {ANY}""")
def normal_split_iqr(t):
    return exports.split_export(exports.labelled_export(chart_rows(t, ("IQR",)), ["IQR"]), "normal").select("product_id")


@query("S12_analysis_export", f"""
SELECT p.qb_code, p.brand, p.category, p.product_type, p.name, p.height, p.width, p.depth, 'Outlier' AS "Status"
FROM {typed_sql(ANALYSED)} WHERE {ANY}""")
def analysis_export(t):
    return exports.analysis_export(A.label_outliers(analysed(t), [], ["IQR"]), "outlier")


@query("P25_product_preview", f"""
SELECT p.product_id, p.qb_code, {EDGES}, {ANY} AS is_outlier_combined FROM {typed_sql(ANALYSED)} WHERE p.qb_code = 'QB-41'""")
def product_preview(t):
    labelled = A.label_outliers(analysed(t), [], ["IQR"])
    return rounded(product_files.preview(labelled, "QB-41", "qb_code"), EDGE_NAMES).select(
        "product_id", "qb_code", *EDGE_NAMES, "is_outlier_combined")


@query("A28_chart_statistics", f"""
SELECT count(*) AS total, count(*) FILTER (NOT {ANY}) AS normal_count, count(*) FILTER ({ANY}) AS outlier_count,
  round(count(*) FILTER ({ANY}) * 100.0E0 / count(*), 1) AS outlier_pct FROM {typed_sql(ANALYSED)}""")
def chart_statistics(t):
    return A.chart_statistics(A.label_outliers(analysed(t), [], ["IQR"]))


@query("A28_top_options", f"""
SELECT CAST(v AS INT) AS value, CASE v WHEN 100 THEN 'Top 50+ Outliers' ELSE concat('Top ', CAST(v AS VARCHAR), ' Outliers') END AS label, n < v AS disabled
FROM (SELECT count(*) FILTER ({ANY}) AS n FROM {typed_sql(ANALYSED)}) c, unnest([5, 10, 20, 30, 50, 100]) AS u(v)""")
def top_options(t):
    return A.top_options(A.label_outliers(analysed(t), [], ["IQR"]))


RUN = f"WITH {C.points(GROUP_1, 'category')}, {C.noise()}"
RUN_BOUNDS = bounds_sql("category, product_type", GROUP_1)
RUN_FROM = f"({GROUP_1}) p JOIN ({RUN_BOUNDS}) b ON p.category = b.category AND p.product_type = b.product_type LEFT JOIN noise n ON n.id = p.product_id"
BOTH = f"({ANY} AND coalesce(n.noise, FALSE))"


@query("X11_analysis", f"""
{RUN} SELECT p.product_id, p.category, {ANY} AS iqr_is_outlier, n.noise AS dbscan_is_outlier, {BOTH} AS is_outlier_combined FROM {RUN_FROM}""")
def analysis(t):
    rows = P.products_filtered(t.fx_product, 1)
    return A.label_outliers(rows, ["category"]).select(
        "product_id", "category", "iqr_is_outlier", "dbscan_is_outlier", "is_outlier_combined")


@query("X11_analysis_statistics", f"""
{RUN} SELECT p.category, count(*) AS total, count(*) FILTER ({BOTH}) AS outliers, count(*) FILTER (NOT {BOTH}) AS normals,
  CAST(0 AS BIGINT) AS excluded, round(count(*) FILTER ({BOTH}) * 100.0E0 / count(*), 2) AS outlier_pct FROM {RUN_FROM} GROUP BY p.category""")
def analysis_statistics(t):
    return A.run_statistics(A.label_outliers(P.products_filtered(t.fx_product, 1), ["category"]), ["category"])


SMALL_1 = GROUP_1 + " AND category = 'SMALL'"


@query("X12_run_items", f"""
WITH RECURSIVE {C.points(SMALL_1, "category")}, {C.clusters()}
SELECT p.system_product_id, p.brand, p.category, p.product_type,
  CASE WHEN c.cluster = -1 THEN 'Noise/Outlier' ELSE concat('Cluster ', CAST(c.cluster AS VARCHAR)) END AS cluster,
  count(*) OVER (PARTITION BY c.cluster) AS cluster_items,
  round(count(*) OVER (PARTITION BY c.cluster) * 100.0E0 / count(*) OVER (), 2) AS cluster_items_per,
  CAST(CASE WHEN c.cluster = -1 THEN 0 ELSE 1 END AS INT) AS status, CAST(CASE WHEN c.cluster = -1 THEN 0 END AS INT) AS outlier_mode,
  CAST(NULL AS INT) AS final_status
FROM ({SMALL_1}) p JOIN clus c ON c.id = p.product_id""")
def run_items(t):
    labelled = A.label_outliers(analysed(t, 1).filter("category = 'SMALL'"), [], ["DBSCAN"])
    return A.run_items(labelled)


PENDING = """SELECT p.* FROM fx_product p WHERE p.system_product_id IN
  (SELECT system_product_id FROM fx_iteration_item WHERE iteration_id = 3 AND final_status IS NULL)"""


@query("X12_run_header_of_pending", f"""
WITH {C.points(PENDING, "1")}, {C.noise(1.5, 3)}
SELECT CAST(1 AS INT) AS product_group_id, 'DBSCAN' AS algorithm, CAST(NULL AS VARCHAR) AS brand, 'SMALL' AS category,
  CAST(NULL AS VARCHAR) AS product_type, 1.5E0 AS eps, CAST(3 AS INT) AS sample, 'run-9' AS unique_number,
  (SELECT count(*) FROM fx_product WHERE group_id = 1 AND category = 'SMALL' AND {MEASURED}) AS total_items,
  (SELECT count(final_status) FROM fx_product WHERE group_id = 1 AND category = 'SMALL' AND {MEASURED}) AS analyzed_items,
  (SELECT count(*) - count(final_status) FROM fx_product WHERE group_id = 1 AND category = 'SMALL' AND {MEASURED}) AS pending_items,
  count(*) FILTER (noise) AS outlier_items FROM noise""")
def run_header_of_pending(t):
    rows = A.population(t.fx_product, t.fx_iteration_item, 1, "pending", 3)
    labelled = A.label_outliers(rows, [], ["DBSCAN"], 1.5, 3)
    return A.run_header(labelled, P.header_counts(t.fx_product, 1, category="SMALL"), 1, "SMALL", 1.5, 3, "run-9")


COMBOS = f"""
b AS (SELECT brand, category, product_type, count(*) AS n FROM ({GROUP_1}) p GROUP BY brand, category, product_type),
k AS (SELECT brand, category, product_type, CASE WHEN n >= 4 THEN concat(coalesce(brand, 'None'), '_', category, '_', product_type) ELSE concat(coalesce(brand, 'None'), '_', category) END AS g, n FROM b),
v AS (SELECT g FROM k GROUP BY g HAVING sum(n) >= 4),
combo AS MATERIALIZED (SELECT p.*, k.g AS combination_key FROM ({GROUP_1}) p JOIN k ON k.brand IS NOT DISTINCT FROM p.brand AND k.category = p.category AND k.product_type = p.product_type JOIN v ON v.g = k.g)"""
COMBO_CTES = f"WITH {COMBOS}, {C.points('SELECT * FROM combo', 'combination_key')}, {C.noise(1.0, 2)}"
COMBO_BOUNDS = f"""({bounds_sql('combination_key, product_type', 'SELECT * FROM combo')}) b"""
COMBO_FROM = f"combo p JOIN {COMBO_BOUNDS} ON b.combination_key = p.combination_key AND b.product_type = p.product_type LEFT JOIN noise n ON n.id = p.product_id"


def combination_labels(t):
    rows = A.combination_rows(t.fx_product, 1, alone_from=4, valid_from=4)
    return A.label_outliers(rows, ["combination_key"], min_samples=2)


@query("X19_combination_population", f"""
WITH {COMBOS} SELECT p.product_id, k.g AS combination_key, v.g IS NOT NULL AS is_valid FROM ({GROUP_1}) p
JOIN k ON k.brand IS NOT DISTINCT FROM p.brand AND k.category = p.category AND k.product_type = p.product_type LEFT JOIN v ON v.g = k.g""")
def combination_population(t):
    rows = A.combination_population(t.fx_product, 1, alone_from=4, valid_from=4)
    return rows.select("product_id", "combination_key", "is_valid")


@query("X19_combination_statistics", f"""
{COMBO_CTES} SELECT p.combination_key, count(*) FILTER (NOT {BOTH}) AS normal_count, count(*) FILTER ({BOTH}) AS outlier_count,
  round(count(*) FILTER (NOT {BOTH}) * 100.0E0 / count(*), 2) AS normal_count_percent,
  round(count(*) FILTER ({BOTH}) * 100.0E0 / count(*), 2) AS outlier_count_percent FROM {COMBO_FROM} GROUP BY p.combination_key""")
def combination_statistics(t):
    return A.combination_statistics(combination_labels(t))


@query("X20_combination_items", f"""
{COMBO_CTES} SELECT p.product_id, p.combination_key, CAST(CASE WHEN {ANY} THEN 0 ELSE 1 END AS INT) AS iqr_status,
  {", ".join(f"CAST(CASE WHEN {flag_sql(d)} THEN 0 ELSE 1 END AS INT) AS iqr_{d}_status" for d in DIMS)},
  CAST(CASE WHEN n.noise THEN 0 WHEN NOT n.noise THEN 1 END AS INT) AS status, CAST(CASE WHEN n.noise THEN 0 END AS INT) AS outlier_mode
FROM {COMBO_FROM}""")
def combination_items(t):
    return A.combination_items(combination_labels(t))


WHOLE = bounds_sql("", GROUP_1 + " AND category = 'SMALL'", clip=True)
TYPED = bounds_sql("product_type", GROUP_1 + " AND category = 'SMALL'", clip=True)


@query("X21_previous_with_bounds", f"""
SELECT p.product_id, {", ".join(f"round(CASE WHEN p.iqr_status IS NOT NULL AND b.n >= 4 THEN b.{d}_{s} END, 6) AS {d}_{s}" for d in DIMS for s in ("lower", "upper"))},
  p.iqr_status = 0 AS iqr_is_outlier, coalesce(p.dbs_status = 0, TRUE) AS dbscan_is_outlier,
  CAST(CASE WHEN p.dbs_status <> 0 THEN 0 ELSE -1 END AS INT) AS dbscan_cluster, TRUE AS is_outlier_combined
FROM (SELECT * FROM fx_product WHERE group_id = 1 AND category = 'SMALL' AND (skip_status IS NULL OR skip_status <> 1)
  AND iteration_closed < 3 AND final_status = 0) p LEFT JOIN ({TYPED}) b ON p.product_type = b.product_type""")
def previous_with_bounds(t):
    previous = P.previous_outliers(t.fx_product, 1, "SMALL", 3)
    rows = A.with_recomputed_bounds(previous, analysed(t, 1).filter("category = 'SMALL'"))
    return rounded(rows, EDGE_NAMES).select("product_id", *EDGE_NAMES, "iqr_is_outlier",
                                            "dbscan_is_outlier", "dbscan_cluster", "is_outlier_combined")


# --- file mode -------------------------------------------------------------------------------

FILE_ROWS = f"SELECT * FROM fx_product WHERE {MEASURED} AND {IN_FILE}"
FILE = f"""{C.points(FILE_ROWS, "category", ("size",), False)}, {C.noise()},
done AS (SELECT p.product_id, p.brand, p.category, n.noise, {", ".join(f"CASE WHEN {flag_sql(d)} THEN 'No' ELSE 'Yes' END AS iqr_{d}" for d in DIMS)},
  CASE WHEN {ANY} THEN 'No' ELSE 'Yes' END AS iqr_status, CASE WHEN n.noise THEN 'No' ELSE 'Yes' END AS dbscan_status,
  CASE WHEN {ANY} AND n.noise THEN 'No' ELSE 'Yes' END AS final
  FROM ({FILE_ROWS}) p JOIN ({bounds_sql("category", FILE_ROWS)}) b ON b.category = p.category JOIN noise n ON n.id = p.product_id)"""


def file_rows(t):
    rows = t.fx_product.drop("final_status", "iqr_status")
    return A.analyse_file_rows(rows, FILE_CATEGORIES)


@query("X15_file_analysis", f"""
WITH {FILE} SELECT product_id, iqr_height, iqr_width, iqr_depth, iqr_status, dbscan_status AS dbscan_height, dbscan_status, final AS final_status FROM done""")
def file_analysis(t):
    return file_rows(t).select("product_id", "iqr_height", "iqr_width", "iqr_depth", "iqr_status",
                               "dbscan_height", "dbscan_status", "final_status")


@query("A24_brand_category_summary", f"""
WITH {FILE} SELECT brand, category, count(*) AS total, count(*) FILTER (final = 'Yes') AS normal, count(*) FILTER (final = 'No') AS outlier,
  round(count(*) FILTER (final = 'Yes') * 100.0E0 / count(*), 2) AS normal_pct, round(count(*) FILTER (final = 'No') * 100.0E0 / count(*), 2) AS outlier_pct
FROM done WHERE brand IS NOT NULL GROUP BY brand, category""")
def brand_category_summary(t):
    return A.brand_category_summary(file_rows(t))


@query("A26_file_totals", f"""
WITH {FILE} SELECT count(*) AS analyzed, count(*) FILTER (final = 'Yes') AS valid, count(*) FILTER (final = 'No') AS invalid FROM done""")
def file_totals(t):
    return A.file_totals(file_rows(t))


@query("A30_category_profile", f"""
WITH RECURSIVE {C.points(FILE_ROWS, "category", ("size",), False)}, {C.clusters()}
SELECT p.category, count(*) AS "rows", count(*) FILTER (NOT {ANY}) AS iqr_normal, count(*) FILTER ({ANY}) AS iqr_outliers,
  count(*) FILTER (c.cluster <> -1) AS dbscan_normal, count(*) FILTER (c.cluster = -1) AS dbscan_outliers,
  count(DISTINCT CASE WHEN c.cluster >= 0 THEN c.cluster END) AS clusters,
  {", ".join(f"round(min(b.{d}_{n}), 2) AS {d}_{n}" for d in DIMS for n in BOUNDS)}
FROM ({FILE_ROWS}) p JOIN ({bounds_sql("category", FILE_ROWS)}) b ON b.category = p.category JOIN clus c ON c.id = p.product_id GROUP BY p.category""")
def category_profile(t):
    return A.category_profile(file_rows(t))


@query("A25_option_counts", f"""
SELECT category, count(*) AS n, concat(category, ' (', CAST(count(*) AS VARCHAR), ')') AS label
FROM fx_product WHERE brand IN ('Brand#11', 'Brand#12') AND category IS NOT NULL GROUP BY category""")
def option_counts(t):
    return P.value_counts(t.fx_product, "category", F.col("brand").isin("Brand#11", "Brand#12"))


@query("P21_file_filter", f"""
SELECT product_id, category, brand FROM fx_product WHERE category IN ('ECONOMY', 'SMALL') AND brand IN ('Brand#11', 'Brand#12')
  AND (SELECT count(*) FROM fx_product WHERE category IN ('ECONOMY', 'SMALL') AND brand IN ('Brand#11', 'Brand#12')) >= 4""")
def file_filter(t):
    rows = t.fx_product.withColumnsRenamed({"category": "Category", "brand": "Brand"})
    return product_files.filtered(rows, ["ECONOMY", "SMALL"], ["Brand#11", "Brand#12"]).select(
        "product_id", F.col("Category").alias("category"), F.col("Brand").alias("brand"))


# --- sweep -----------------------------------------------------------------------------------

SWEEP_ROWS = f"""SELECT * FROM fx_product WHERE group_id = 1 AND {MEASURED} AND brand IS NOT NULL AND category IS NOT NULL AND product_type IS NOT NULL"""
SWEEP = f"""WITH RECURSIVE {C.points(SWEEP_ROWS, "category")}, {C.clusters("SELECT eps, min_samples AS m FROM fx_config")},
sz AS (SELECT g, eps, m, cluster, count(*) AS n FROM clus GROUP BY g, eps, m, cluster),
tot AS (SELECT g, eps, m, sum(n) AS n, coalesce(sum(n) FILTER (cluster = -1), 0) AS noise FROM sz GROUP BY g, eps, m),
long AS (SELECT p.*, f.eps, f.min_samples, CAST(coalesce(t.noise, 0) AS BIGINT) AS outliers, CAST(CASE WHEN c.cluster = -1 THEN 0 WHEN c.cluster >= 0 THEN 1 END AS INT) AS status,
  CASE WHEN c.cluster = -1 THEN 'Noise/Outlier' WHEN c.cluster >= 0 THEN concat('Cluster ', CAST(c.cluster AS VARCHAR)) END AS cluster_name,
  s.n AS cluster_items, round(s.n * 100.0E0 / t.n, 2) AS cluster_items_per
  FROM ({SWEEP_ROWS}) p CROSS JOIN fx_config f LEFT JOIN clus c ON c.g = p.category AND c.eps = f.eps AND c.m = f.min_samples AND c.id = p.product_id
  LEFT JOIN sz s ON s.g = c.g AND s.eps = c.eps AND s.m = c.m AND s.cluster = c.cluster
  LEFT JOIN tot t ON t.g = p.category AND t.eps = f.eps AND t.m = f.min_samples)"""


def sweep_long(t):
    return A.sweep_long(P.products_for_sweep(t.fx_product, 1))


@query("X13_sweep_long", f"""
{SWEEP} SELECT product_id, category, eps, CAST(min_samples AS INT) AS min_samples, TRUE AS executed, outliers, status, cluster_name, cluster_items, cluster_items_per FROM long""")
def sweep_rows(t):
    return sweep_long(t).select("product_id", "category", "eps", "min_samples", "executed", "outliers",
                                "status", "cluster_name", "cluster_items", "cluster_items_per")


WIDE = ", ".join(
    f"max(CASE WHEN eps = {e}E0 AND min_samples = {m} THEN {c} END) AS \"{A.config_name(e, m)} {n}\""
    for e, m in A.SWEEP_CONFIGS
    for n, c in (("Outliers", "outliers"), ("Status", "status"), ("Cluster", "cluster_name"),
                 ("Cluster Item Count", "cluster_items"), ("Cluster Item Percentage", "cluster_items_per")))


WIDE_SQL = f"""SELECT l.product_id, l.category, l.system_product_id, l.qb_code, l.brand, l.product_type, l.name, l.height, l.width, l.depth,
  {WIDE}, round(avg(l.status) * 100, 2) AS "Average Status %", count(l.status) AS "Status Column Count",
  (SELECT count(DISTINCT x.category) FROM ({SWEEP_ROWS}) x WHERE x.category <= l.category) AS "Unique Group Key",
  (SELECT count(*) FROM fx_product x WHERE x.group_id = 1 AND {MEASURED} AND x.category = l.category) AS "TOTAL ITEMS",
  (SELECT count(final_status) FROM fx_product x WHERE x.group_id = 1 AND {MEASURED} AND x.category = l.category) AS "Analyzed Item Count",
  (SELECT count(*) - count(final_status) FROM fx_product x WHERE x.group_id = 1 AND {MEASURED} AND x.category = l.category) AS "Pending Item Count", 'Yes' AS "EXECUTED"
FROM long l GROUP BY l.product_id, l.category, l.system_product_id, l.qb_code, l.brand, l.product_type, l.name, l.height, l.width, l.depth"""


@query("X13_sweep_wide", f"{SWEEP} {WIDE_SQL}")
def sweep_wide(t):
    return A.sweep(t.fx_product, 1)


@query("X14_single_setting", f"""
WITH {C.points(SWEEP_ROWS, "category")}, {C.noise(0.5, 3)}
SELECT p.product_id, CAST(CASE WHEN n.noise THEN 0 WHEN NOT n.noise THEN 1 END AS INT) AS status,
  (SELECT count(*) FROM noise x WHERE x.g = p.category AND x.noise) AS outliers
FROM ({SWEEP_ROWS}) p LEFT JOIN noise n ON n.id = p.product_id""")
def single_setting(t):
    return A.sweep_long(P.products_for_sweep(t.fx_product, 1), [(0.5, 3)]).select(
        "product_id", "status", "outliers")


DASHED = ", ".join(f"""coalesce(CAST("{c}" AS VARCHAR), '-') AS "{c}\"""" for c in [
    *(f"{A.config_name(e, m)} {n}" for e, m in A.SWEEP_CONFIGS
      for n in ("Outliers", "Status", "Cluster", "Cluster Item Count", "Cluster Item Percentage")), "Average Status %"])
FIXED = ", ".join(f'{c} AS "{title}"' for c, title in exports.SWEEP_FIXED.items() if not c.endswith("_url"))


@query("S20_sweep_export", f"""
{SWEEP}, wide AS ({WIDE_SQL}) SELECT {FIXED}, {", ".join(f'"{c}"' for c in exports.SWEEP_COUNTS)}, {DASHED}, "Status Column Count" FROM wide""")
def sweep_export(t):
    return exports.sweep_export(A.sweep(t.fx_product, 1))


@query("D19_min_outlier_config", f"""
{SWEEP}, best AS (SELECT DISTINCT category, eps, CAST(min_samples AS INT) AS min_samples, outliers FROM long WHERE outliers > 0)
SELECT category, eps, min_samples, outliers FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY outliers, min_samples, eps DESC) AS r FROM best) b WHERE r = 1""")
def min_outlier_config(t):
    return A.min_outlier_config(sweep_long(t))


@query("U19_sweep_headers", f"""
{SWEEP} SELECT CAST(1 AS INT) AS product_group_id, 'DBSCAN' AS algorithm, l.category, l.eps, CAST(l.min_samples AS INT) AS sample, 'run-1' AS unique_number,
  c.total AS total_items, c.analyzed AS analyzed_items, c.total - c.analyzed AS pending_items, count(*) FILTER (l.status = 0) AS outlier_items
FROM long l JOIN (SELECT category, count(*) AS total, count(final_status) AS analyzed FROM fx_product WHERE group_id = 1 AND {MEASURED} GROUP BY category) c
  ON c.category = l.category GROUP BY l.category, l.eps, l.min_samples, c.total, c.analyzed""")
def sweep_headers(t):
    return A.sweep_headers(sweep_long(t), t.fx_product, 1, "run-1")


@query("U19_sweep_items", f"""
{SWEEP} SELECT category, eps, CAST(min_samples AS INT) AS sample, system_product_id, brand, product_type, cluster_name AS cluster, cluster_items, cluster_items_per,
  CAST(CASE WHEN status = 0 THEN 0 END AS INT) AS outlier_mode, status FROM long WHERE status IS NOT NULL""")
def sweep_items(t):
    return A.sweep_items(sweep_long(t))


@query("U19_saved_sweep", f"""
{SWEEP}, head AS (SELECT category, eps, min_samples, (SELECT max(iteration_id) FROM fx_iteration) + row_number() OVER (ORDER BY category, eps, min_samples) AS iteration_id
  FROM (SELECT DISTINCT category, eps, min_samples FROM long) d)
SELECT h.iteration_id, h.category, h.eps, CAST(h.min_samples AS INT) AS sample, count(l.status) AS items, count(*) FILTER (l.status = 0) AS outliers,
  CAST((SELECT max(id) FROM fx_iteration_item) + sum(count(l.status)) OVER (ORDER BY h.iteration_id) AS BIGINT) AS last_id
FROM head h JOIN long l ON l.category = h.category AND l.eps = h.eps AND l.min_samples = h.min_samples GROUP BY h.iteration_id, h.category, h.eps, h.min_samples""")
def saved_sweep(t):
    """A sweep saved with its items and read back: every item lies under exactly one header."""
    long = stage(sweep_long(t), "sweep")
    headers, items = A.save_sweep(t.fx_iteration, t.fx_iteration_item, long, t.fx_product, 1, "run-12")
    new = headers.filter("unique_number = 'run-12'").select("iteration_id", "category", "eps", "sample")
    counts = items.groupBy("iteration_id").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("status") == 0).alias("outliers"),
                                               F.max("id").alias("last_id"))
    return new.join(counts, "iteration_id").select("iteration_id", "category", F.col("eps").cast("double").alias("eps"), "sample",
                                                   "items", "outliers", "last_id")
