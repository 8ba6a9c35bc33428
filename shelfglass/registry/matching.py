"""Pair scores, match summaries, saved scores and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfglass.plans import grid as G
from shelfglass.plans import matching as M
from shelfglass.registry.base import Tables, query
from shelfglass.registry.scalars import (
    PRODUCT_PAIRS, sql_comparable, sql_gram_score, sql_grams, sql_price, sql_sku, sql_url,
)
from shelfglass.sources.derived import attributes

STAMP = "2024-01-31 08:00:00"
BRANDS = ["Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22"]
IN_BRANDS = "brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22')"


def stamp():
    return F.lit(STAMP).cast("timestamp_ntz")


def config(t: Tables, **options) -> M.MatchConfig:
    return M.config_from(attributes(t.spark), **{"algorithms": ("custom",), **options})


def run(t: Tables, c: M.MatchConfig, **filters):
    return M.run_pairs(t.fx_system, t.fx_competitor, c, **filters)


# --- reference text of the pair scores -------------------------------------------------------

def status_sql(score: str, matched: float = 85, review: float = 70) -> str:
    return f"CASE WHEN {score} >= {matched} THEN 'Matched' WHEN {score} >= {review} THEN 'Review' ELSE 'Not Matched' END"


CUSTOM_RAW = f"""SELECT s.system_product_id, s.product_id, c.competitor_product_id, c.competitor_id, s.name, s.brand, s.category, s.product_type,
  s.sku, coalesce(s.part_number, '') AS part_number,
  {sql_sku('s.sku', 'c.sku')} AS a_sku, {sql_sku("coalesce(s.part_number, '')", 'c.sku')} AS a_part,
  {sql_url('s.u', 'c.u')} AS a_url, {sql_price('s.price', 'c.price')} AS a_price
FROM (SELECT *, {sql_comparable('url')} AS u FROM fx_system) s JOIN (SELECT *, {sql_comparable('url')} AS u FROM fx_competitor) c
  ON s.system_product_id = c.system_product_id"""


def custom_sql(mode: str = "interactive") -> str:
    """Pairs with final score f and status under the custom algorithm."""
    group = "greatest(a_sku, a_part)"
    total = f"({group} * 35 + a_url * 40 + a_price * 25) / 100.0E0"
    if mode == "interactive":
        final = (f"CASE WHEN a_sku = 0 AND a_part = 0 AND a_url = 0 AND a_price = 0 THEN 0.0E0 "
                 f"WHEN {group} >= 100 OR a_url >= 100 OR a_price >= 100 THEN 100.0E0 ELSE round({total}, 2) END")
    elif mode == "bulk":
        final = total
    else:
        final = "round((a_sku * 35 + a_part * 35 + a_url * 40 + a_price * 25) / 135.0E0, 2)"
    matched = 89 if mode == "bulk" else 85
    return f"SELECT *, {status_sql('f', matched)} AS status FROM (SELECT *, {final} AS f FROM ({CUSTOM_RAW}) r) x"


@query("F13_custom_pair_score", f"""
SELECT competitor_product_id, round(a_sku, 2) AS sku_custom, round(a_part, 2) AS part_number_custom, round(a_url, 2) AS url_custom,
  round(a_price, 2) AS price_custom, f AS final_score, status FROM ({custom_sql()}) p""")
def custom_pair_score(t):
    return run(t, config(t)).select("competitor_product_id", "sku_custom", "part_number_custom", "url_custom",
                                    "price_custom", "final_score", "status")


@query("F14_ungrouped_pair_score", f"SELECT competitor_product_id, f AS final_score, status FROM ({custom_sql('ungrouped')}) p")
def ungrouped_pair_score(t):
    return run(t, M.ungrouped(config(t))).select("competitor_product_id", "final_score", "status")


@query("F15_bulk_pair_score", f"SELECT competitor_product_id, round(f, 4) AS final_score, status FROM ({custom_sql('bulk')}) p")
def bulk_pair_score(t):
    return run(t, M.bulk(config(t))).select("competitor_product_id", F.round("final_score", 4).alias("final_score"), "status")


@query("F11_single_algorithms", f"""
SELECT competitor_product_id, round(a_sku, 2) AS sku_sku, round({sql_url('sku', "''")}, 2) AS no_score FROM ({CUSTOM_RAW}) r""")
def single_algorithms(t):
    # 'unknown' names no registered algorithm and is skipped.
    c = config(t, algorithms=("sku", "unknown"), selected=("sku",))
    return run(t, c).select("competitor_product_id", "sku_sku", F.lit(0.0).alias("no_score"))


TFIDF_A = f"""a_src AS (SELECT system_product_id, {sql_comparable('url')} AS u FROM fx_system),
b_src AS (SELECT competitor_product_id, {sql_comparable('url')} AS u FROM fx_competitor)"""


@query("F10_tfidf_price_urls", f"""
WITH {TFIDF_A}, {sql_grams('a_src', 'system_product_id', 'u', 'ga')}, {sql_grams('b_src', 'competitor_product_id', 'u', 'gb')},
{PRODUCT_PAIRS}, {sql_gram_score('pr')}
SELECT kb AS competitor_product_id, round(score, 2) AS url_tfidf_price,
  CASE WHEN round(score, 2) = 0 THEN 0.0E0 WHEN score >= 100 THEN 100.0E0 ELSE round(score * 40 / 40.0E0, 2) END AS final_score FROM cosine""")
def tfidf_price_urls(t):
    c = config(t, algorithms=("tfidf_price",), selected=("url",), perfect=False, zero_rule=False)
    pairs = run(t, c)
    capped = F.when(F.col("final_score") >= 100, 100.0).otherwise(F.col("final_score"))
    return pairs.select("competitor_product_id", "url_tfidf_price", capped.alias("final_score"))


# --- joins and summaries ---------------------------------------------------------------------

@query("P12_matching_filter", f"""
SELECT product_id, brand, category FROM fx_system WHERE {IN_BRANDS} AND category IN ('ECONOMY', 'SMALL')""")
def matching_filter(t):
    return M.selected_products(t.fx_system, BRANDS, ["ECONOMY", "SMALL"]).select("product_id", "brand", "category")


@query("P12_matching_filter_by_ids", "SELECT product_id FROM fx_system WHERE product_id IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)")
def matching_filter_by_ids(t):
    ids = t.lineitem.filter("l_quantity >= 50").select(F.col("l_partkey").alias("product_id"))
    return M.selected_products(t.fx_system, ["no such brand"], product_ids=ids).select("product_id")


@query("P13_product_inputs", f"""
SELECT product_id, system_product_id, brand, sku, coalesce(part_number, '') AS part_number, url AS url_display, {sql_comparable('url')} AS url FROM fx_system""")
def product_inputs(t):
    return M.product_inputs(t.fx_system, ["sku", "part_number", "url"]).select(
        "product_id", "system_product_id", "brand", "sku", "part_number", "url_display", "url")


@query("P14_competitor_inputs", f"""
SELECT competitor_product_id, system_product_id, competitor_id, sku AS competitor_sku, {sql_comparable('url')} AS competitor_url, url AS competitor_url_display
FROM fx_competitor WHERE system_product_id IN (SELECT system_product_id FROM fx_system WHERE {IN_BRANDS})""")
def competitor_inputs(t):
    return M.competitor_inputs(t.fx_competitor, M.selected_products(t.fx_system, BRANDS), ["sku", "url"])


@query("J01_product_offers", """
SELECT s.product_id, c.competitor_product_id FROM fx_system s JOIN fx_competitor c ON s.system_product_id = c.system_product_id""")
def product_offers(t):
    return t.fx_system.join(t.fx_competitor.select("system_product_id", "competitor_product_id"), "system_product_id").select(
        "product_id", "competitor_product_id")


SUMMARY = f"""SELECT system_product_id, round(max(f), 2) AS max_score, count(*) AS total_items, min(sku) AS sku, min(part_number) AS part_number,
  min(brand) AS brand, min(category) AS category, min(product_type) AS product_type, min(name) AS name,
  count(*) FILTER (status = 'Matched') AS matched_count, count(*) FILTER (status = 'Review') AS review_count,
  count(*) FILTER (status = 'Not Matched') AS not_matched_count, {status_sql('max(f)')} AS status FROM ({custom_sql()}) p GROUP BY system_product_id"""


@query("A16_match_summary", SUMMARY)
def match_summary(t):
    c = config(t)
    return M.match_summary(run(t, c), c)


@query("A17_match_statistics", f"""
SELECT count(*) AS total, count(*) FILTER (status = 'Matched') AS matched, count(*) FILTER (status = 'Review') AS review,
  count(*) FILTER (status = 'Not Matched') AS not_matched FROM ({SUMMARY}) s""")
def match_statistics(t):
    c = config(t)
    return M.match_statistics(M.match_summary(run(t, c), c))


@query("U26_filtered_analysis", f"SELECT system_product_id, max_score, total_items, status FROM ({SUMMARY}) s WHERE {IN_BRANDS}")
def filtered_analysis(t):
    c = config(t)
    return M.match_summary(run(t, c, brands=BRANDS), c).select("system_product_id", "max_score", "total_items", "status")


BEST = f"""SELECT system_product_id, competitor_product_id, f AS final_score, status FROM (SELECT *, row_number() OVER
  (PARTITION BY system_product_id ORDER BY f DESC, competitor_product_id) AS rn FROM ({custom_sql()}) p) q WHERE rn = 1"""


@query("W02_best_offers", BEST)
def best_offers(t):
    return M.best_offers(run(t, config(t)))


def option_sql(f: str, where: str) -> str:
    return f"""SELECT '{f}' AS field, {f} AS value, count(DISTINCT product_id) AS total_count, count(DISTINCT CASE WHEN scored THEN product_id END) AS scored_count,
  CASE WHEN count(DISTINCT CASE WHEN scored THEN product_id END) = count(DISTINCT product_id) THEN 'complete'
    WHEN count(DISTINCT CASE WHEN scored THEN product_id END) > 0 THEN 'partial' ELSE 'none' END AS status
FROM (SELECT *, system_product_id IN (SELECT system_product_id FROM fx_score WHERE total_score IS NOT NULL) AS scored FROM fx_system
  WHERE system_product_id IN (SELECT system_product_id FROM fx_competitor)) s WHERE {f} <> '' AND {where} GROUP BY {f}"""


@query("A18_filter_options", " UNION ALL ".join([
    option_sql("brand", "TRUE"), option_sql("category", IN_BRANDS),
    option_sql("product_type", f"{IN_BRANDS} AND category IN ('ECONOMY', 'SMALL')")]))
def filter_options(t):
    return M.filter_options(t.fx_system, t.fx_competitor, t.fx_score, BRANDS, ["ECONOMY", "SMALL"])


@query("A19_products_with_offers", f"""
SELECT count(*) AS count FROM fx_system WHERE {IN_BRANDS} AND system_product_id IN (SELECT system_product_id FROM fx_competitor)""")
def products_with_offers(t):
    return M.count_with_offers(t.fx_system, t.fx_competitor, brands=BRANDS)


@query("A20_grid_total", f"SELECT count(*) AS count FROM fx_system WHERE {IN_BRANDS}")
def grid_total(t):
    return M.selected_products(t.fx_system, BRANDS).agg(F.count(F.lit(1)).alias("count"))


@query("A21_score_distribution", f"""
SELECT CAST(r.i AS INT) AS position, concat(CAST(r.i * 10 AS VARCHAR), '-', CAST(r.i * 10 + 10 AS VARCHAR)) AS range, count(s.score_id) AS count
FROM range(10) r(i) LEFT JOIN (SELECT *, CASE WHEN total_score < 90 THEN CAST(floor(total_score / 10) AS INT) ELSE 9 END AS b FROM fx_score
  WHERE system_product_id IN (SELECT system_product_id FROM fx_system WHERE {IN_BRANDS})) s ON s.b = r.i GROUP BY r.i""")
def score_distribution(t):
    return M.score_distribution(t.fx_system, t.fx_score, brands=BRANDS)


# --- saved scores ----------------------------------------------------------------------------

TOP = """SELECT s.product_id, s.system_product_id, s.name, s.part_number, b.total_score AS max_score, b.score_status AS status,
  b.competitor_product_id AS top_competitor_product_id, c.competitor_id AS top_competitor_id, coalesce(o.n, 0) AS competitor_count
FROM fx_system s LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY system_product_id ORDER BY total_score DESC, competitor_product_id) AS rn
  FROM fx_score WHERE total_score IS NOT NULL) x WHERE rn = 1) b ON b.system_product_id = s.system_product_id
LEFT JOIN (SELECT system_product_id, count(*) AS n FROM fx_competitor GROUP BY system_product_id) o ON o.system_product_id = s.system_product_id
LEFT JOIN fx_competitor c ON c.competitor_product_id = b.competitor_product_id"""
TOP_COLUMNS = ["product_id", "system_product_id", "name", "part_number", "max_score", "status",
               "top_competitor_product_id", "top_competitor_id", "competitor_count"]


@query("J09_top_scores", TOP)
def top_scores(t):
    return M.top_scores(t.fx_system, t.fx_score, t.fx_competitor).select(*TOP_COLUMNS)


@query("J09_top_scores_by_status", f"SELECT product_id, max_score, status FROM ({TOP}) x WHERE status IN ('Review', 'Matched')")
def top_scores_by_status(t):
    return M.top_scores(t.fx_system, t.fx_score, t.fx_competitor, ["Review", "Matched"]).select("product_id", "max_score", "status")


@query("R03_matching_chunk", f"SELECT * FROM ({TOP}) x ORDER BY product_id DESC LIMIT 60 OFFSET 120")
def matching_chunk(t):
    return G.matching_page(M.top_scores(t.fx_system, t.fx_score, t.fx_competitor), 120, 60).select(*TOP_COLUMNS)


@query("R04_matching_grid", f"SELECT * FROM ({TOP}) x")
def matching_grid(t):
    return G.matching_page(M.top_scores(t.fx_system, t.fx_score, t.fx_competitor)).select(*TOP_COLUMNS)


@query("R07_client_page", f"""
SELECT product_id, name, max_score FROM ({TOP}) x ORDER BY lower(name) NULLS FIRST, product_id LIMIT 25 OFFSET 50""")
def client_page(t):
    return G.client_page(M.top_scores(t.fx_system, t.fx_score, t.fx_competitor), "name", "asc", 3, 25).select(
        "product_id", "name", "max_score")


def parts_sql(names: dict[str, int]) -> str:
    return ", ".join(f"max(score) FILTER (attribute_id = {i}) AS {n}_score" for n, i in names.items())


NAMES = {"sku": 1, "url": 3, "price": 4}
COMPARISON = f"""SELECT c.system_product_id, c.competitor_product_id, c.sku, s.total_score AS score, s.score_status AS status, a.sku_score, a.url_score, a.price_score
FROM fx_competitor c LEFT JOIN fx_score s ON s.competitor_product_id = c.competitor_product_id AND s.system_product_id = c.system_product_id
LEFT JOIN (SELECT competitor_product_id, system_product_id, {parts_sql(NAMES)} FROM fx_score_attribute GROUP BY competitor_product_id, system_product_id) a
  ON a.competitor_product_id = c.competitor_product_id AND a.system_product_id = c.system_product_id"""
COMPARED = ["system_product_id", "competitor_product_id", "sku", "score", "status", "sku_score", "url_score", "price_score"]


def compared(t, **options):
    return M.comparison(t.fx_competitor, t.fx_score, t.fx_score_attribute, attributes(t.spark), list(NAMES), **options)


@query("J06_offers_with_scores", """
SELECT c.competitor_product_id, s.total_score AS score, s.score_status AS status FROM fx_competitor c LEFT JOIN fx_score s
  ON s.competitor_product_id = c.competitor_product_id AND s.system_product_id = c.system_product_id""")
def offers_with_scores(t):
    return compared(t).select("competitor_product_id", "score", "status")


@query("J07_pivoted_attribute_scores", f"""
SELECT x.*, x.competitor_product_id = b.competitor_product_id AS is_matched, CAST(CASE WHEN x.competitor_product_id = b.competitor_product_id THEN 1 ELSE 0 END AS INT) AS review_status
FROM ({COMPARISON}) x JOIN (SELECT system_product_id, min(competitor_product_id) AS competitor_product_id FROM fx_competitor GROUP BY system_product_id) b ON b.system_product_id = x.system_product_id""")
def pivoted_attribute_scores(t):
    chosen = t.fx_competitor.groupBy("system_product_id").agg(
        F.min("competitor_product_id").alias("chosen_competitor_id"), F.lit(1).alias("review_status"))
    return compared(t, chosen=chosen).select(*COMPARED, "is_matched", "review_status")


@query("R08_comparison_dialog", f"""
SELECT * FROM ({COMPARISON}) x WHERE system_product_id = (SELECT min(system_product_id) FROM fx_score)""")
def comparison_dialog(t):
    product = t.fx_score.agg(F.min("system_product_id").alias("system_product_id"))
    return compared(t, product=product).select(*COMPARED)


@query("U32_stored_comparison", f"SELECT * FROM ({COMPARISON}) x")
def stored_comparison(t):
    return compared(t).select(*COMPARED)


SAVED = f"""SELECT p.system_product_id, p.competitor_product_id, p.f AS final_score, p.status, round(p.a_sku, 2) AS sku_score, round(p.a_url, 2) AS url_score,
  s.total_score AS saved_score, s.score_status AS saved_status, a.sku_score AS saved_sku, a.url_score AS saved_url
FROM ({custom_sql()}) p LEFT JOIN fx_score s ON s.competitor_product_id = p.competitor_product_id AND s.system_product_id = p.system_product_id
LEFT JOIN (SELECT score_id, {parts_sql(NAMES)} FROM fx_score_attribute GROUP BY score_id) a ON a.score_id = s.score_id"""
SAVED_COLUMNS = ["system_product_id", "competitor_product_id", "final_score", "status", "sku_score", "url_score",
                 "saved_score", "saved_status", "saved_sku", "saved_url"]


@query("J08_saved_next_to_fresh", SAVED)
def saved_next_to_fresh(t):
    c = config(t)
    return M.saved_next_to(run(t, c), t.fx_score, t.fx_score_attribute, c).select(*SAVED_COLUMNS)


@query("U30_item_comparison", f"SELECT * FROM ({SAVED}) x WHERE system_product_id = (SELECT min(system_product_id) FROM fx_score)")
def item_comparison(t):
    c = config(t)
    one = t.fx_score.agg(F.min("system_product_id").alias("system_product_id"))
    product = t.fx_system.join(one, "system_product_id", "left_semi").select("product_id")
    return M.saved_next_to(run(t, c, product_ids=product), t.fx_score, t.fx_score_attribute, c).select(*SAVED_COLUMNS)


@query("J11_scored_products", f"""
SELECT DISTINCT system_product_id FROM fx_system WHERE {IN_BRANDS} AND system_product_id IN
  (SELECT s.system_product_id FROM fx_score s JOIN fx_score_attribute a ON a.score_id = s.score_id WHERE a.algorithm_id = 'custom')""")
def scored_products(t):
    return M.scored_products(t.fx_system, t.fx_score, t.fx_score_attribute, "custom", brands=BRANDS)


@query("J12_deleted_scores", f"""
SELECT score_id FROM fx_score WHERE system_product_id NOT IN (SELECT system_product_id FROM fx_system WHERE {IN_BRANDS})""")
def deleted_scores(t):
    return M.delete_scores(t.fx_score, t.fx_system, brands=BRANDS).select("score_id")


@query("U23_scores_of_products", f"""
SELECT s.score_id, s.total_score, a.attribute_id, a.score FROM fx_score s LEFT JOIN fx_score_attribute a ON a.score_id = s.score_id
WHERE s.system_product_id IN (SELECT system_product_id FROM fx_system WHERE {IN_BRANDS})""")
def scores_of_products(t):
    chosen = t.fx_score.join(M.selected_products(t.fx_system, BRANDS), "system_product_id", "left_semi")
    parts = t.fx_score_attribute.select("score_id", "attribute_id", "score")
    return chosen.join(parts, "score_id", "left").select("score_id", "total_score", "attribute_id", "score")


def saved(t):
    c = config(t)
    pairs = M.scored_once(run(t, c, brands=BRANDS), c)
    return M.save_scores(t.fx_score, t.fx_score_attribute, M.score_rows(pairs, "custom"),
                         M.score_attribute_rows(pairs, c, "custom"))


PART_ROWS = " UNION ALL ".join(
    f"SELECT system_product_id, competitor_product_id, CAST({i} AS INT) AS attribute_id, 'custom' AS algorithm_id, round({c}, 2) AS score FROM fresh"
    for i, c in ((1, "a_sku"), (2, "a_part"), (3, "a_url"), (4, "a_price")))
PAIR = "system_product_id, competitor_product_id"
# Scores and parts after the save; new rows are numbered after the greatest id.
SAVED = f"""fresh AS MATERIALIZED (SELECT * FROM ({custom_sql()}) p WHERE {IN_BRANDS}),
merged AS (SELECT s.score_id AS old, coalesce(s.system_product_id, p.system_product_id) AS system_product_id, coalesce(s.competitor_product_id, p.competitor_product_id) AS competitor_product_id,
  CASE WHEN p.system_product_id IS NULL THEN s.algorithm_id ELSE 'custom' END AS algorithm_id,
  CASE WHEN p.system_product_id IS NULL THEN s.total_score ELSE p.f END AS total_score, CASE WHEN p.system_product_id IS NULL THEN s.score_status ELSE p.status END AS score_status
  FROM fx_score s FULL JOIN fresh p ON p.system_product_id = s.system_product_id AND p.competitor_product_id = s.competitor_product_id),
saved AS MATERIALIZED (SELECT CASE WHEN old IS NULL THEN (SELECT max(score_id) FROM fx_score) + row_number() OVER (PARTITION BY old IS NULL ORDER BY {PAIR}) ELSE old END AS score_id, {PAIR}, algorithm_id, total_score, score_status FROM merged),
n AS ({PART_ROWS}),
merged_parts AS (SELECT a.score_attribute_id AS old, a.score_id AS old_score, coalesce(a.system_product_id, n.system_product_id) AS system_product_id, coalesce(a.competitor_product_id, n.competitor_product_id) AS competitor_product_id,
  coalesce(a.attribute_id, n.attribute_id) AS attribute_id, coalesce(a.algorithm_id, n.algorithm_id) AS algorithm_id, CASE WHEN n.attribute_id IS NULL THEN a.score ELSE n.score END AS score
  FROM fx_score_attribute a FULL JOIN n ON n.system_product_id = a.system_product_id AND n.competitor_product_id = a.competitor_product_id AND n.attribute_id = a.attribute_id AND n.algorithm_id = a.algorithm_id),
saved_parts AS MATERIALIZED (SELECT CASE WHEN m.old IS NULL THEN (SELECT max(score_attribute_id) FROM fx_score_attribute) + row_number() OVER (PARTITION BY m.old IS NULL ORDER BY m.system_product_id, m.competitor_product_id, attribute_id, m.algorithm_id) ELSE m.old END AS score_attribute_id,
  coalesce(m.old_score, s.score_id) AS score_id, m.competitor_product_id, attribute_id, m.algorithm_id, score
  FROM merged_parts m LEFT JOIN saved s ON s.system_product_id = m.system_product_id AND s.competitor_product_id = m.competitor_product_id)"""


@query("U22_upserted_scores", f"WITH {SAVED} SELECT * FROM saved")
def upserted_scores(t):
    return saved(t)[0].select("score_id", "system_product_id", "competitor_product_id", "algorithm_id", "total_score", "score_status")


@query("U24_upserted_attribute_scores", f"WITH {SAVED} SELECT * FROM saved_parts")
def upserted_attribute_scores(t):
    return saved(t)[1].select("score_attribute_id", "score_id", "competitor_product_id", "attribute_id", "algorithm_id", "score")


@query("U31_rows_per_algorithm", f"""
SELECT competitor_product_id, CAST(1 AS INT) AS attribute_id, 'custom' AS algorithm_id, round(a_sku, 2) AS score FROM ({CUSTOM_RAW}) r UNION ALL
SELECT competitor_product_id, CAST(1 AS INT), 'sku', round(a_sku, 2) FROM ({CUSTOM_RAW}) r""")
def rows_per_algorithm(t):
    c = M.ungrouped(config(t, algorithms=("custom", "sku"), selected=("sku",)))
    return M.score_attribute_rows(run(t, c), c, "custom", per_algorithm=True).drop("system_product_id")


def bulk(t):
    c = M.bulk(config(t))
    return M.save_bulk(t.fx_system, t.fx_score, t.fx_score_attribute, run(t, c, brands=BRANDS), c, "custom", brands=BRANDS)


OUTSIDE = f"system_product_id NOT IN (SELECT system_product_id FROM fx_system WHERE {IN_BRANDS})"
BULK = f"""bulk AS MATERIALIZED (SELECT *, (SELECT max(score_id) FROM fx_score) + row_number() OVER (ORDER BY {PAIR}) AS score_id FROM ({custom_sql('bulk')}) p WHERE {IN_BRANDS})"""


@query("U27_bulk_scores", f"""
WITH {BULK} SELECT score_id, competitor_product_id, algorithm_id, round(total_score, 4) AS total_score, score_status FROM fx_score WHERE {OUTSIDE}
UNION ALL SELECT score_id, competitor_product_id, 'custom', round(f, 4), status FROM bulk""")
def bulk_scores(t):
    return bulk(t)[0].select("score_id", "competitor_product_id", "algorithm_id", F.round("total_score", 4).alias("total_score"), "score_status")


@query("U27_bulk_attribute_scores", f"""
WITH {BULK}, r AS (SELECT b.score_id, r.* FROM ({CUSTOM_RAW}) r JOIN bulk b ON b.system_product_id = r.system_product_id AND b.competitor_product_id = r.competitor_product_id),
parts AS (SELECT score_id, {PAIR}, CAST(1 AS INT) AS attribute_id, greatest(a_sku, a_part) AS score FROM r UNION ALL
  SELECT score_id, {PAIR}, 3, a_url FROM r UNION ALL SELECT score_id, {PAIR}, 4, a_price FROM r)
SELECT score_attribute_id, score_id, competitor_product_id, attribute_id, round(score, 4) AS score FROM fx_score_attribute WHERE {OUTSIDE}
UNION ALL SELECT (SELECT max(score_attribute_id) FROM fx_score_attribute) + row_number() OVER (ORDER BY {PAIR}, attribute_id), score_id, competitor_product_id, attribute_id, round(score, 4) FROM parts""")
def bulk_attribute_scores(t):
    return bulk(t)[1].select("score_attribute_id", "score_id", "competitor_product_id", "attribute_id", F.round("score", 4).alias("score"))


WEIGHTS = {"sku": 50, "url": 30, "price": 20}
WEIGHT_SQL = "CASE attribute_id WHEN 1 THEN 50.0E0 WHEN 3 THEN 30.0E0 WHEN 4 THEN 20.0E0 END"


def recalculated_sql(scores: str = "fx_score", parts: str = "fx_score_attribute") -> str:
    return f"""SELECT score_id, system_product_id, competitor_product_id, 'custom' AS algorithm_id, f AS total_score, {status_sql('f', 80, 50)} AS score_status FROM (
  SELECT s.score_id, s.system_product_id, s.competitor_product_id, round(sum(a.score * {WEIGHT_SQL}) / sum({WEIGHT_SQL}), 2) AS f
  FROM {scores} s JOIN {parts} a ON a.score_id = s.score_id WHERE a.algorithm_id = 'custom'
    AND s.system_product_id IN (SELECT system_product_id FROM fx_system WHERE {IN_BRANDS}) GROUP BY s.score_id, s.system_product_id, s.competitor_product_id) x"""


RECALCULATED = recalculated_sql()


def recalculated(t, scores=None, parts=None):
    scores, parts = scores or t.fx_score, parts or t.fx_score_attribute
    products = M.scored_products(t.fx_system, scores, parts, "custom", brands=BRANDS)
    return M.recalculated(scores, parts, attributes(t.spark), WEIGHTS, "custom",
                          {"matched": 80, "review": 50}, products=products)


@query("U28_recalculated_scores", RECALCULATED)
def recalculated_scores(t):
    return recalculated(t)


@query("U28_recalculated_after_save", f"WITH {SAVED} {recalculated_sql('saved', 'saved_parts')}")
def recalculated_after_save(t):
    return recalculated(t, *saved(t))


@query("U28_applied_recalculation", f"""
SELECT s.score_id, coalesce(r.algorithm_id, s.algorithm_id) AS algorithm_id, CASE WHEN r.score_id IS NULL THEN s.total_score ELSE r.total_score END AS total_score,
  coalesce(r.score_status, s.score_status) AS score_status FROM fx_score s LEFT JOIN ({RECALCULATED}) r ON r.score_id = s.score_id""")
def applied_recalculation(t):
    return M.apply_recalculation(t.fx_score, recalculated(t)).select("score_id", "algorithm_id", "total_score", "score_status")


# --- decisions and configuration -------------------------------------------------------------

def reviewed(t):
    """Products with empty review fields."""
    return t.fx_system.select("product_id", "system_product_id", "brand", F.lit(None).cast("bigint").alias("competitor_product_id"),
                              F.lit(2).alias("review_status"), F.lit(None).cast("timestamp_ntz").alias("matched_date"))


def shown(df):
    return df.select("product_id", "competitor_product_id", "review_status", F.date_format("matched_date", "yyyy-MM-dd HH:mm:ss").alias("date"))


@query("U24_stored_best_offer", f"""
SELECT s.product_id, b.competitor_product_id, CAST(CASE WHEN {IN_BRANDS} THEN 0 ELSE 2 END AS INT) AS review_status, CASE WHEN b.competitor_product_id IS NOT NULL THEN '{STAMP}' END AS date
FROM fx_system s LEFT JOIN ({BEST}) b ON b.system_product_id = s.system_product_id AND {IN_BRANDS}""")
def stored_best_offer(t):
    pairs = run(t, config(t), brands=BRANDS)
    cleared = M.reset_review(reviewed(t), M.selected_products(t.fx_system, BRANDS))
    return shown(M.choose_best(cleared, pairs, stamp()))


DECIDED = """SELECT system_product_id, min(competitor_product_id) AS c, CASE WHEN min(price) > 1500 THEN 'approved' WHEN min(price) > 1200 THEN 'rejected' ELSE 'pending' END AS d
FROM fx_competitor GROUP BY system_product_id"""


@query("U29_review_decisions", f"""
SELECT s.product_id, CASE WHEN d <> 'pending' THEN c END AS competitor_product_id,
  CAST(CASE d WHEN 'approved' THEN 1 WHEN 'rejected' THEN 2 WHEN 'pending' THEN 0 ELSE 2 END AS INT) AS review_status, CASE WHEN d <> 'pending' THEN '{STAMP}' END AS date
FROM fx_system s LEFT JOIN ({DECIDED}) x ON x.system_product_id = s.system_product_id""")
def review_decisions(t):
    price = F.min("price")
    decisions = t.fx_competitor.groupBy("system_product_id").agg(
        F.min("competitor_product_id").alias("competitor_product_id"),
        F.when(price > 1500, "approved").when(price > 1200, "rejected").otherwise("pending").alias("decision")
    ).drop("system_product_id")
    return shown(M.apply_decisions(reviewed(t), t.fx_competitor, decisions, stamp()))



@query("P22_scoring_attributes", """
SELECT CAST(a.attribute_id AS INT) AS attribute_id, a.attribute_name, a.default_weightage, count(s.score_id) AS scores
FROM fx_attribute a LEFT JOIN fx_score_attribute s ON s.attribute_id = a.attribute_id WHERE a.attribute_type = 'default'
GROUP BY a.attribute_id, a.attribute_name, a.default_weightage""")
def scoring_attributes(t):
    counts = t.fx_score_attribute.groupBy("attribute_id").agg(F.count("score_id").alias("scores"))
    return M.attributes_of_type(attributes(t.spark), "default").join(counts, "attribute_id", "left").select(
        "attribute_id", "attribute_name", "default_weightage", F.coalesce("scores", F.lit(0)).alias("scores"))


@query("P23_attributes_by_type", """
SELECT attribute_type, count(*) AS n, string_agg(upper(attribute_name), ',' ORDER BY attribute_id) AS labels,
  (SELECT count(DISTINCT attribute_id) FROM fx_score_attribute) AS scored FROM fx_attribute GROUP BY attribute_type""")
def attributes_by_type(t):
    grouped = M.attributes_by_type(attributes(t.spark))
    scored = t.fx_score_attribute.agg(F.countDistinct("attribute_id").alias("scored"))
    return grouped.crossJoin(scored).select(
        "attribute_type", F.size("options").cast("bigint").alias("n"),
        F.array_join(F.transform("options", lambda o: o["label"]), ",").alias("labels"), "scored")


@query("U25_updated_configuration", """
SELECT algorithm_id, CAST(attribute_id AS INT) AS attribute_id, CASE WHEN algorithm_id = 'custom' AND attribute_id = 1 THEN 50.0E0 WHEN algorithm_id = 'custom' AND attribute_id = 3 THEN 30.0E0 ELSE v END AS attribute_value
FROM (SELECT algorithm_id, attribute_id, round(avg(score), 4) AS v FROM fx_score_attribute GROUP BY algorithm_id, attribute_id) x
UNION ALL SELECT 'custom', CAST(8 AS INT), 80.0E0""")
def updated_configuration(t):
    present = t.fx_score_attribute.groupBy("algorithm_id", "attribute_id").agg(F.round(F.avg("score"), 4).alias("attribute_value"))
    return M.update_configuration(present, attributes(t.spark), "custom",
                                  {"sku": 50, "url": 30, "matched": 80, "no such name": 1})


@query("R05_latest_algorithm", """
SELECT (SELECT algorithm_id FROM fx_score ORDER BY score_id DESC LIMIT 1) AS latest_algorithm, attribute_name, default_weightage AS weight, competitor_attribute
FROM fx_attribute WHERE attribute_type = 'default'""")
def latest_algorithm(t):
    scores = t.fx_score.withColumn("created_at", F.col("score_id"))
    return M.algorithm_weights(scores, attributes(t.spark))


@query("U29_saved_matches", f"""
SELECT s.product_id, b.competitor_product_id, CAST(2 AS INT) AS review_status, CASE WHEN b.competitor_product_id IS NOT NULL THEN '{STAMP}' END AS date
FROM fx_system s LEFT JOIN (SELECT system_product_id, max(competitor_product_id) AS competitor_product_id FROM fx_competitor GROUP BY system_product_id) b
  ON b.system_product_id = s.system_product_id""")
def saved_matches(t):
    return shown(M.store_choices(reviewed(t), t.fx_competitor.select("system_product_id", "competitor_product_id"), stamp()))
