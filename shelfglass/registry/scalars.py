"""Scalar functions over whole columns of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfglass.functions import display as D
from shelfglass.functions import scores as S
from shelfglass.functions import text as T
from shelfglass.operators.joins import join_prepared
from shelfglass.registry.base import query

STOP = "('products', 'product', 'item', 'items', 'furniture', 'pdp', 'p', 'catalog', 'shop', 'buy', 'detail', 'details', 'view', 'page')"


def sql_normal(x: str) -> str:
    """Reference text of the text normalisation."""
    c = f"lower(coalesce({x}, ''))"
    c = f"regexp_replace({c}, 'https?://(www\\.)?', '', 'g')"
    c = f"regexp_replace({c}, '\\.com|\\.org|\\.net', '', 'g')"
    c = f"regexp_replace({c}, '[^a-z0-9\\s\\-]', ' ', 'g')"
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def sql_path(x: str) -> str:
    c = f"regexp_replace(coalesce({x}, ''), 'https?://[^/]+/', '', 'g')"
    c = f"regexp_replace({c}, '\\?.*$', '')"
    return f"regexp_replace({c}, '\\.(html|htm|php|asp|aspx)$', '')"


def sql_words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def sql_identifying(x: str) -> str:
    return (f"list_filter({sql_words(x)}, lambda w: w NOT IN {STOP} AND "
            "((regexp_matches(w, '[a-z]') AND regexp_matches(w, '[0-9]')) OR length(w) >= 3))")


def sql_comparable(x: str) -> str:
    c = f"regexp_replace(lower({sql_path(x)}), '[-_/]', ' ', 'g')"
    return f"array_to_string({sql_identifying(f'regexp_replace({c}, {chr(39)}[^a-z0-9 ]{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')}, ' ')"


def sql_parts(x: str) -> str:
    return f"list_filter(regexp_split_to_array({sql_normal(x)}, '[\\-_\\s]+'), lambda w: w <> '')"


def sql_items(x: str) -> str:
    return f"list_filter(list_transform(string_split(trim(coalesce({x}, '')), ';'), lambda s: lower(trim(s))), lambda s: s <> '')"


@query("F01_normalize_text", f"SELECT doc_id, md5({sql_normal('text')}) AS normal FROM documents")
def normalize_text(t):
    return t.documents.select("doc_id", F.md5(T.normalize_text(F.col("text"))).alias("normal"))


URLS = "(SELECT page_id, url FROM pages UNION ALL SELECT product_id + 10000000, url FROM fx_system UNION ALL SELECT competitor_product_id + 100000000, url FROM fx_competitor)"


def urls(t):
    return (t.pages.select("page_id", "url")
            .unionByName(t.fx_system.select((F.col("product_id") + 10000000).alias("page_id"), "url"))
            .unionByName(t.fx_competitor.select(
                (F.col("competitor_product_id") + 100000000).alias("page_id"), "url")))


@query("F02_url_path_text", f"""
SELECT page_id, {sql_normal("regexp_replace(" + sql_path("url") + ", '[-_/]', ' ', 'g')")} AS path FROM {URLS} u""")
def url_path_text(t):
    return urls(t).select("page_id", T.url_path_text(F.col("url")).alias("path"))


@query("F03_product_tokens", f"""
SELECT page_id, array_to_string(list_sort(list_distinct({sql_identifying("regexp_replace(lower(" + sql_path("url") + "), '[^a-z0-9\\-]', ' ', 'g')")})), ' ') AS tokens
FROM {URLS} u""")
def product_tokens(t):
    return urls(t).select("page_id", F.array_join(T.product_tokens(F.col("url")), " ").alias("tokens"))


@query("F04_comparable_url", f"SELECT page_id, {sql_comparable('url')} AS words FROM {URLS} u")
def comparable_url(t):
    return urls(t).select("page_id", T.comparable_url(F.col("url")).alias("words"))


@query("F05_sku_components", f"""
SELECT competitor_product_id, array_to_string({sql_parts('sku')}, ' ') AS parts FROM fx_competitor""")
def sku_components(t):
    return t.fx_competitor.select("competitor_product_id",
                                  F.array_join(T.sku_components(F.col("sku")), " ").alias("parts"))


def pairs(t):
    """Every product with its own offers."""
    own = t.fx_system.select("system_product_id", "sku", "price", "name",
                             T.comparable_url(F.col("url")).alias("url"))
    other = t.fx_competitor.select(
        "system_product_id", "competitor_product_id", F.col("sku").alias("c_sku"),
        F.col("price").alias("c_price"), T.comparable_url(F.col("url")).alias("c_url"))
    return own.join(other, "system_product_id")


PAIRS = f"""SELECT s.system_product_id, c.competitor_product_id, s.sku, s.price, s.name, {sql_comparable('s.url')} AS url,
  c.sku AS c_sku, c.price AS c_price, {sql_comparable('c.url')} AS c_url
FROM fx_system s JOIN fx_competitor c ON s.system_product_id = c.system_product_id"""


def letters(x: str) -> str:
    return f"length(array_to_string({x}, ''))"


def sql_sku(a: str, b: str) -> str:
    """Reference text of the SKU score; lists are unrolled with list functions."""
    pa, pb = f"list_distinct({sql_parts('ia')})", f"list_distinct({sql_parts('ib')})"
    share = (f"CASE WHEN len({pa}) > 0 AND len({pb}) > 0 THEN {letters(f'list_intersect({pa}, {pb})')} * 100.0E0 "
             f"/ {letters(pa)} ELSE 0.0E0 END")
    best = (f"list_max(list_transform({sql_items(a)}, lambda ia: "
            f"list_max(list_transform({sql_items(b)}, lambda ib: {share}))))")
    return (f"CASE WHEN len(list_intersect({sql_items(a)}, {sql_items(b)})) > 0 THEN 100.0E0 "
            f"ELSE coalesce({best}, 0.0E0) END")


@query("F06_sku_score", f"""
SELECT competitor_product_id, round({sql_sku('sku', 'c_sku')}, 4) AS score FROM ({PAIRS}) p""")
def sku_score(t):
    rows = pairs(t).withColumns({"a": S.sku_features(F.col("sku")), "b": S.sku_features(F.col("c_sku"))})
    return rows.select("competitor_product_id", F.round(S.sku_score(F.col("a"), F.col("b")), 4).alias("score"))


def sql_price(p: str, q: str, m: float = 25, lo: float = 10, up: float = 10) -> str:
    target = f"({p} + {p} * {m / 100}E0)"
    low, high = f"({target} - {p} * {lo / 100}E0)", f"({target} + {p} * {up / 100}E0)"
    return (f"CASE WHEN {p} IS NULL OR {q} IS NULL OR {p} <= 0 OR {q} <= 0 OR {q} < {low} OR {q} > {high} THEN 0.0E0 "
            f"WHEN {q} <= {target} THEN (CASE WHEN {target} = {low} THEN (CASE WHEN {q} = {target} THEN 100.0E0 ELSE 0.0E0 END) "
            f"ELSE (1 - ({target} - {q}) / ({target} - {low})) * 100 END) "
            f"ELSE (CASE WHEN {target} = {high} THEN 0.0E0 ELSE (1 - ({q} - {target}) / ({high} - {target})) * 100 END) END")


@query("F07_price_score", f"""
SELECT competitor_product_id, round({sql_price('price', 'c_price')}, 4) AS score,
  round({sql_price('price', 'c_price', 30, 20, 5)}, 4) AS custom_score FROM ({PAIRS}) p""")
def price_score(t):
    p, q = F.col("price"), F.col("c_price")
    limits = {"margin": 30, "margin_low_limit": 20, "margin_upper_limit": 5}
    return pairs(t).select("competitor_product_id", F.round(S.price_score(p, q), 4).alias("score"),
                           F.round(S.price_score(p, q, limits), 4).alias("custom_score"))


def sql_url(a: str, b: str) -> str:
    wa, wb = f"list_distinct({sql_words(a)})", f"list_distinct({sql_words(b)})"
    return (f"CASE WHEN len({wa}) > 0 AND len({wb}) > 0 THEN len(list_intersect({wa}, {wb})) * 100.0E0 / "
            f"len(list_distinct(list_concat({wa}, {wb}))) ELSE 0.0E0 END")


@query("F08_url_score", f"SELECT competitor_product_id, round({sql_url('url', 'c_url')}, 4) AS score FROM ({PAIRS}) p")
def url_score(t):
    rows = pairs(t).withColumns({"a": S.url_features(F.col("url")), "b": S.url_features(F.col("c_url"))})
    return rows.select("competitor_product_id", F.round(S.url_score(F.col("a"), F.col("b")), 4).alias("score"))


def sql_grams(rows: str, key: str, text: str, name: str) -> str:
    """CTEs of gram counts per row: <name>(key, gram, n)."""
    return f"""
{name}_w AS MATERIALIZED (SELECT DISTINCT {key} AS k, i, list_extract(ws, i) AS w FROM (
  SELECT {key}, {sql_words(sql_normal(text))} AS ws, length({sql_normal(text)}) AS len FROM {rows}) x,
  unnest(range(1, len(ws) + 1)) AS u(i) WHERE len >= 2),
{name} AS MATERIALIZED (SELECT k, substr(concat(' ', w, ' '), p, n) AS gram, count(*) AS n
  FROM {name}_w, unnest([2, 3, 4]) AS s(n), unnest(range(1, length(w) + 4 - n)) AS q(p)
  WHERE n <= length(w) + 2 GROUP BY k, gram)"""


KAPPA2 = "((ln(1.5E0) + 1) * (ln(1.5E0) + 1))"


def sql_gram_score(pairs_cte: str) -> str:
    """CTE text: cosine per pair (ka, kb) of the gram tables ga and gb."""
    return f"""
sq AS (SELECT 'a' AS side, k, sum(n * n) AS s FROM ga GROUP BY k UNION ALL SELECT 'b', k, sum(n * n) FROM gb GROUP BY k),
pa AS MATERIALIZED (SELECT p.ka, p.kb, ga.gram, ga.n FROM {pairs_cte} p JOIN ga ON ga.k = p.ka),
common AS MATERIALIZED (SELECT pa.ka, pa.kb, sum(pa.n * gb.n) AS dot, sum(pa.n * pa.n) AS ca, sum(gb.n * gb.n) AS cb
  FROM pa JOIN gb ON gb.k = pa.kb AND gb.gram = pa.gram GROUP BY pa.ka, pa.kb),
cosine AS (SELECT p.ka, p.kb, coalesce(c.dot * 100.0E0 / sqrt((c.ca + {KAPPA2} * (a.s - c.ca)) * (c.cb + {KAPPA2} * (b.s - c.cb))), 0.0E0) AS score
  FROM {pairs_cte} p LEFT JOIN common c ON c.ka = p.ka AND c.kb = p.kb
  LEFT JOIN sq a ON a.side = 'a' AND a.k = p.ka LEFT JOIN sq b ON b.side = 'b' AND b.k = p.kb)"""


PRODUCT_PAIRS = "pr AS (SELECT s.system_product_id AS ka, c.competitor_product_id AS kb FROM fx_system s JOIN fx_competitor c ON s.system_product_id = c.system_product_id)"


def gram_scores(t, text):
    """Gram score of every product with its offers; an offer's grams are counted behind the join."""
    other = t.fx_competitor.select("system_product_id", "competitor_product_id", text.alias("text"))
    rows = join_prepared(
        t.fx_system, lambda own: own.select("system_product_id", S.gram_features(text).alias("a")),
        other, "system_product_id").withColumn("b", S.gram_features(F.col("text")))
    return rows.select("competitor_product_id",
                       F.round(S.gram_score(F.col("a"), F.col("b")), 4).alias("score"))


@query("F09_gram_score", f"""
WITH {sql_grams('fx_system', 'system_product_id', 'sku', 'ga')}, {sql_grams('fx_competitor', 'competitor_product_id', 'sku', 'gb')},
{PRODUCT_PAIRS}, {sql_gram_score('pr')}
SELECT kb AS competitor_product_id, round(score, 4) AS score FROM cosine""")
def gram_score(t):
    return gram_scores(t, F.col("sku"))


@query("F09_gram_score_urls", f"""
WITH a_src AS (SELECT system_product_id, {sql_comparable('url')} AS u FROM fx_system),
b_src AS (SELECT competitor_product_id, {sql_comparable('url')} AS u FROM fx_competitor),
{sql_grams('a_src', 'system_product_id', 'u', 'ga')}, {sql_grams('b_src', 'competitor_product_id', 'u', 'gb')},
{PRODUCT_PAIRS}, {sql_gram_score('pr')}
SELECT kb AS competitor_product_id, round(score, 4) AS score FROM cosine""")
def gram_score_urls(t):
    return gram_scores(t, T.comparable_url(F.col("url")))


@query("F10_custom_dispatch", f"""
SELECT competitor_product_id, round({sql_sku('sku', 'c_sku')}, 4) AS string_score,
  round({sql_url('url', 'c_url')}, 4) AS url_score, round({sql_price('price', 'c_price')}, 4) AS number_score
FROM ({PAIRS}) p""")
def custom_dispatch(t):
    columns = {"string": F.col("sku"), "url": T.comparable_url(F.col("url")), "number": F.col("price")}
    scores = {kind: S.algorithm("custom", kind) for kind in columns}
    other = t.fx_competitor.select("system_product_id", "competitor_product_id", *[
        c.alias(kind) for kind, c in columns.items()])
    rows = join_prepared(
        t.fx_system, lambda own: own.select("system_product_id", *[
            s.features(columns[kind]).alias(f"_a_{kind}") for kind, s in scores.items()]),
        other, "system_product_id").withColumns({f"_b_{kind}": s.features(F.col(kind)) for kind, s in scores.items()})
    return rows.select("competitor_product_id", *[
        F.round(s.pair(F.col(f"_a_{kind}"), F.col(f"_b_{kind}")), 4).alias(f"{kind}_score")
        for kind, s in scores.items()])


@query("F12_status_text", """
SELECT score_id, CASE WHEN total_score >= 85 THEN 'Matched' WHEN total_score >= 70 THEN 'Review' ELSE 'Not Matched' END AS status,
  CASE WHEN total_score >= 89 THEN 'Matched' WHEN total_score >= 70 THEN 'Review' ELSE 'Not Matched' END AS bulk_status,
  CASE WHEN total_score >= 85 THEN 'Matched' WHEN total_score >= 60 THEN 'Review' ELSE 'Not Matched' END AS custom_status
FROM fx_score""")
def status_text(t):
    s = F.col("total_score")
    return t.fx_score.select("score_id", S.match_status(s).alias("status"),
                             S.match_status(s, S.BULK_THRESHOLDS).alias("bulk_status"),
                             S.match_status(s, {"matched": 0, "review": 60}).alias("custom_status"))


@query("F16_status_words", """
SELECT id, CASE final_status WHEN 1 THEN 'Normal' WHEN 0 THEN 'Outlier' ELSE 'Pending to Analyze' END AS word,
  CASE final_status WHEN 1 THEN 'Normal' WHEN 0 THEN 'Outlier' ELSE 'Unknown' END AS history_word FROM fx_iteration_item""")
def status_words(t):
    f = F.col("final_status")
    return t.fx_iteration_item.select("id", D.status_text(f).alias("word"),
                                      D.status_text(f, "Unknown").alias("history_word"))


@query("F17_type_lists", """
SELECT brand, string_agg(DISTINCT product_type, '|' ORDER BY product_type) AS types,
  count(DISTINCT product_type) AS n FROM fx_product WHERE brand IS NOT NULL GROUP BY brand""")
def type_lists(t):
    joined = t.fx_product.filter("brand IS NOT NULL").groupBy("brand").agg(
        D.join_types(F.collect_set("product_type")).alias("types"))
    return joined.withColumn("n", F.size(D.split_types(F.col("types"))).cast("bigint"))


@query("F18_number_coercion", """
SELECT event_id, TRY_CAST(trim(raw) AS DOUBLE) AS number FROM (SELECT event_id,
  CASE event_id % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN '' WHEN 2 THEN concat(' ', CAST(user_id AS VARCHAR), ' ') ELSE CAST(user_id AS VARCHAR) END AS raw FROM events) x""")
def number_coercion(t):
    k, u = F.col("event_id") % 4, F.col("user_id").cast("string")
    raw = (F.when(k == 0, "n/a").when(k == 1, "").when(k == 2, F.concat(F.lit(" "), u, F.lit(" ")))
           .otherwise(u))
    return t.events.select("event_id", D.to_number(raw).alias("number"))


@query("F20_date_text", "SELECT id, strftime(analyzed_date, '%Y-%m-%d %H:%M:%S') AS date FROM fx_iteration_item WHERE analyzed_date IS NOT NULL")
def date_text(t):
    return t.fx_iteration_item.filter("analyzed_date IS NOT NULL").select(
        "id", D.stamp_text(F.col("analyzed_date")).alias("date"))


@query("F21_sql_expressions", """
SELECT brand, coalesce(min(CAST(system_product_id AS BIGINT)), 0) AS low_id,
  count(DISTINCT CASE WHEN final_status = 0 THEN category END) AS outlier_categories,
  min(split_part(qb_code, '-', 1)) AS prefix FROM fx_product GROUP BY brand""")
def sql_expressions(t):
    return t.fx_product.groupBy("brand").agg(
        F.coalesce(F.min(F.col("system_product_id").try_cast("bigint")), F.lit(0)).alias("low_id"),
        F.countDistinct(F.when(F.col("final_status") == 0, F.col("category"))).alias("outlier_categories"),
        F.min(F.substring_index("qb_code", "-", 1)).alias("prefix"))


@query("F22_rounding", "SELECT score_id, round(total_score, 1) AS one, round(total_score, 2) AS two FROM fx_score")
def rounding(t):
    return t.fx_score.select("score_id", F.round("total_score", 1).alias("one"),
                             F.round("total_score", 2).alias("two"))


@query("T02_token_sets", f"""
SELECT competitor_product_id, len(list_intersect({sql_words('url')}, {sql_words('c_url')})) AS shared,
  len(list_distinct(list_concat({sql_words('url')}, {sql_words('c_url')}))) AS either FROM ({PAIRS}) p""")
def token_sets(t):
    a, b = S.url_features(F.col("url")), S.url_features(F.col("c_url"))
    return pairs(t).select("competitor_product_id",
                           F.size(F.array_intersect(a, b)).cast("bigint").alias("shared"),
                           F.size(F.array_union(a, b)).cast("bigint").alias("either"))
