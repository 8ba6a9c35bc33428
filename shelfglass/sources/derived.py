"""Catalogue tables derived from the given base tables; one SQL text for Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = {
    "fx_product": ("part", "lineitem"),
    "fx_system": ("part",),
    "fx_competitor": ("part", "lineitem"),
    "fx_iteration_item": ("events", "part"),
    "fx_iteration_result": ("events", "part"),
    "fx_score": ("lineitem",),
    "fx_score_attribute": ("lineitem",),
    "fx_iteration": ("events",),
}

DEFINITIONS = {
    "fx_product": """
SELECT p.p_partkey AS product_id, CAST(1 + p.p_partkey % 3 AS INT) AS group_id,
  CAST(p.p_partkey AS STRING) AS system_product_id,
  CASE WHEN p.p_partkey % 97 = 0 THEN NULL ELSE p.p_brand END AS brand,
  p.p_type AS category, split_part(p.p_name, ' ', 2) AS product_type,
  concat('QB-', CAST(p.p_partkey AS STRING)) AS qb_code, p.p_name AS name,
  CASE WHEN p.p_partkey % 53 = 0 THEN NULL WHEN p.p_partkey % 41 = 0 THEN p.p_size * 10.0E0 ELSE p.p_size * 1.0E0 END AS height,
  CASE WHEN p.p_partkey % 59 = 0 THEN 0.0E0 ELSE l.w END AS width, l.d AS depth,
  CASE WHEN p.p_partkey % 17 = 0 THEN 1 WHEN p.p_partkey % 5 = 0 THEN 0 ELSE NULL END AS skip_status,
  CASE p.p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE NULL END AS final_status,
  CASE WHEN p.p_partkey % 8 = 0 THEN 1 WHEN p.p_partkey % 4 = 0 THEN 0 ELSE NULL END AS outlier_mode,
  CASE WHEN p.p_partkey % 4 <= 1 THEN CAST(1 + p.p_partkey % 3 AS INT) ELSE NULL END AS iteration_closed,
  CASE WHEN p.p_partkey % 4 <= 1 THEN CAST(p.p_partkey % 2 AS INT) ELSE NULL END AS iqr_status,
  CASE WHEN p.p_partkey % 12 = 0 THEN NULL WHEN p.p_partkey % 4 <= 1 THEN CAST(p.p_partkey % 4 AS INT) ELSE NULL END AS dbs_status,
  CASE WHEN p.p_partkey % 13 = 0 THEN NULL ELSE p.p_size * 1.0E0 END AS ori_height, l.w AS ori_width, l.d AS ori_depth
FROM part p LEFT JOIN (SELECT l_partkey, avg(l_quantity) AS w, max(l_quantity) - min(l_quantity) + 1 AS d
  FROM lineitem GROUP BY l_partkey) l ON p.p_partkey = l.l_partkey
""",
    "fx_system": """
SELECT p_partkey AS product_id, p_partkey + 1000000 AS system_product_id, p_name AS name,
  concat(replace(p_brand, '#', '-'), '-', CAST(p_partkey AS STRING), CASE WHEN p_partkey % 5 = 0 THEN concat(';ALT-', CAST(p_partkey % 11 AS STRING)) ELSE '' END) AS sku,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE concat('PN ', CAST(p_partkey AS STRING)) END AS part_number,
  p_retailprice AS price,
  concat('https://www.system.com/products/', replace(p_name, ' ', '-'), '-', CAST(p_partkey AS STRING), '.html?ref=x') AS url,
  p_type AS category, p_brand AS brand, split_part(p_name, ' ', 2) AS product_type
FROM part
""",
    "fx_competitor": """
SELECT l_partkey * 100000 + l_suppkey AS competitor_product_id, l_partkey + 1000000 AS system_product_id,
  l_suppkey AS competitor_id,
  CASE WHEN l_suppkey % 3 = 0 THEN concat(replace(p_brand, '#', '-'), '-', CAST(l_partkey AS STRING))
       ELSE concat(replace(p_brand, '#', '_'), ' ', CAST(l_partkey + l_suppkey % 2 AS STRING)) END AS sku,
  CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE concat('PN ', CAST(l_partkey AS STRING)) END AS part_number,
  p_retailprice * (1.0E0 + (l_suppkey * 13 % 60) / 100.0E0) AS price,
  concat('http://shop', CAST(l_suppkey % 5 AS STRING), '.net/p/', replace(p_name, ' ', '_'), '/', CAST(l_partkey AS STRING)) AS url
FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) l JOIN part ON l_partkey = p_partkey
""",
    "fx_iteration_item": """
SELECT event_id AS id, 1 + user_id % 12 AS iteration_id, CAST(event_id % (SELECT count(*) FROM part) AS STRING) AS system_product_id,
  CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS status,
  CASE WHEN event_type = 'error' THEN CAST(event_id % 2 AS INT) ELSE NULL END AS outlier_mode,
  CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE NULL END AS final_status,
  CASE WHEN event_id % 5 <= 1 THEN ts ELSE NULL END AS analyzed_date,
  CASE WHEN event_type = 'error' THEN 'Noise/Outlier' ELSE concat('Cluster ', CAST(user_id % 3 AS STRING)) END AS cluster
FROM events
""",
    "fx_score": """
SELECT l_partkey * 100000 + l_suppkey AS score_id, l_partkey + 1000000 AS system_product_id,
  l_partkey * 100000 + l_suppkey AS competitor_product_id,
  CASE l_suppkey % 3 WHEN 0 THEN 'tfidf' WHEN 1 THEN 'custom' ELSE 'tfidf_price' END AS algorithm_id,
  t AS total_score, CASE WHEN t >= 85 THEN 'Matched' WHEN t >= 70 THEN 'Review' ELSE 'Not Matched' END AS score_status
FROM (SELECT DISTINCT l_partkey, l_suppkey, CASE WHEN (l_partkey + l_suppkey) % 50 = 0 THEN NULL ELSE (l_partkey * 37 + l_suppkey * 101) % 10001 / 100.0E0 END AS t
  FROM lineitem WHERE l_partkey % 6 <> 0) x
""",
    "fx_score_attribute": """
SELECT (l_partkey * 100000 + l_suppkey) * 10 + a AS score_attribute_id, l_partkey * 100000 + l_suppkey AS score_id,
  a AS attribute_id, l_partkey + 1000000 AS system_product_id, l_partkey * 100000 + l_suppkey AS competitor_product_id,
  CASE l_suppkey % 3 WHEN 0 THEN 'tfidf' WHEN 1 THEN 'custom' ELSE 'tfidf_price' END AS algorithm_id,
  (l_partkey * 31 + l_suppkey * 17 + a * 1009) % 10001 / 100.0E0 AS score
FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_partkey % 6 <> 0) x
CROSS JOIN (SELECT 1 AS a UNION ALL SELECT 3 UNION ALL SELECT 4) y
""",
    "fx_iteration_result": """
SELECT event_id * 2 + k AS id, CAST(event_id % (SELECT count(*) FROM part) AS STRING) AS system_product_id,
  1 + user_id % 4 AS iteration_number, CASE k WHEN 0 THEN 'IQR' ELSE 'DBSCAN' END AS algo_id,
  concat('Brand#', CAST(1 + event_id % 5 AS STRING)) AS brand, CASE event_id % 2 WHEN 0 THEN 'ECONOMY' ELSE 'SMALL' END AS category,
  CASE WHEN event_type IN ('error', 'signup') THEN 0 ELSE k END AS status,
  CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS outlier_mode
FROM events CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) x
""",
    "fx_iteration": """
SELECT CAST(i AS BIGINT) AS iteration_id, CAST(1 + i % 3 AS INT) AS product_group_id,
  'DBSCAN' AS algorithm, CASE WHEN i % 2 = 0 THEN 'Brand#11' ELSE NULL END AS brand,
  CASE WHEN i % 2 = 0 THEN 'ECONOMY' ELSE 'SMALL' END AS category,
  CASE WHEN i % 4 = 0 THEN 'blue|red' ELSE NULL END AS product_type,
  CASE (i - 1) % 4 WHEN 0 THEN 2.0E0 WHEN 1 THEN 1.5E0 WHEN 2 THEN 1.0E0 ELSE 0.5E0 END AS eps,
  CAST(2 + (i - 1 - (i - 1) % 4) / 4 AS INT) AS sample,
  CAST(100 + i AS INT) AS total_items, CAST(60 + i AS INT) AS analyzed_items,
  CAST(40 AS INT) AS pending_items, CAST(i AS INT) AS outlier_items,
  concat('run-', CAST(i % 2 AS STRING)) AS unique_number, last_ts AS timestamp
FROM (SELECT 1 + user_id % 12 AS i, max(ts) AS last_ts FROM events GROUP BY 1 + user_id % 12) x
""",
}

# Scoring attributes, sweep settings and iteration headers used with the tables.
ATTRIBUTES = [
    (1, "sku", 35.0, "default", "sku", "string"),
    (2, "part_number", 35.0, "default", "sku", "string"),
    (3, "url", 40.0, "default", "url", "url"),
    (4, "price", 25.0, "default", "price", "number"),
    (5, "margin", 25.0, "price", "", "number"),
    (6, "margin_low_limit", 10.0, "price", "", "number"),
    (7, "margin_upper_limit", 10.0, "price", "", "number"),
    (8, "matched", 85.0, "status", "", "number"),
    (9, "review", 70.0, "status", "", "number"),
]
ATTRIBUTE_SCHEMA = (
    "attribute_id int, attribute_name string, default_weightage double, attribute_type string, "
    "competitor_attribute string, data_type string"
)
CONFIGS = [(e, m) for m in (2, 3, 4) for e in (2.0, 1.5, 1.0, 0.5)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table, or a derived one computed from the base tables."""
    if name not in DEFINITIONS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    base = {b: spark.read.parquet(f"{sf_dir}/{b}.parquet") for b in BASE_TABLES[name]}
    # The frames stand in for the table names; no view of the session is touched.
    text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(base)})\b", r"\1 {\2}", DEFINITIONS[name])
    return spark.sql(text, **base)


def attributes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ATTRIBUTES, ATTRIBUTE_SCHEMA)
