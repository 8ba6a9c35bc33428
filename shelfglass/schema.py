"""Tables the library works on. Columns a caller does not have may be left out."""

from __future__ import annotations

PRODUCT = """
  product_id bigint NOT NULL, group_id int NOT NULL, system_product_id string, qb_code string,
  brand string, category string, product_type string, name string, base_image_url string,
  product_url string, height double, width double, depth double, weight double,
  ori_height double, ori_width double, ori_depth double, iteration_closed int, iqr_status int,
  iqr_height_status int, iqr_width_status int, iqr_depth_status int, dbs_status int,
  final_status int, outlier_mode int, skip_status int, eps decimal(10,2), sample int,
  analyzed_date timestamp_ntz
"""
PRODUCT_GROUP = "group_id int NOT NULL, name string NOT NULL, product_count bigint, default_selected int"
ITERATION = """
  iteration_id bigint NOT NULL, product_group_id int, algorithm string, brand string,
  category string, product_type string, eps decimal(10,2), sample int, total_items int,
  analyzed_items int, pending_items int, outlier_items int, unique_number string,
  timestamp timestamp_ntz
"""
ITERATION_ITEM = """
  id bigint NOT NULL, iteration_id bigint NOT NULL, system_product_id string, brand string,
  category string, product_type string, cluster string, cluster_items int,
  cluster_items_per double, outlier_mode int, status int, final_status int,
  analyzed_date timestamp_ntz
"""
ITERATION_RESULT = """
  id bigint NOT NULL, system_product_id string, iteration_number int, algo_id string,
  brand string, category string, eps decimal(10,2), sample int, cluster string,
  outlier_mode int, status int
"""
SYSTEM_PRODUCT = """
  product_id bigint NOT NULL, system_product_id bigint NOT NULL, name string, sku string,
  part_number string, price double, url string, category string, brand string,
  product_type string, competitor_product_id bigint, review_status int,
  matched_date timestamp_ntz
"""
COMPETITOR_PRODUCT = """
  competitor_product_id bigint NOT NULL, system_product_id bigint, competitor_id bigint,
  sku string, part_number string, price double, url string
"""
ATTRIBUTE = """
  attribute_id int NOT NULL, attribute_name string NOT NULL, default_weightage double,
  attribute_type string, competitor_attribute string, data_type string
"""
CONFIGURATION = "algorithm_id string NOT NULL, attribute_id int NOT NULL, attribute_value double"
SCORE = """
  score_id bigint, system_product_id bigint NOT NULL, competitor_product_id bigint NOT NULL,
  algorithm_id string, total_score double, score_status string, created_at timestamp_ntz
"""
SCORE_ATTRIBUTE = """
  score_attribute_id bigint, score_id bigint, attribute_id int NOT NULL,
  system_product_id bigint, competitor_product_id bigint, algorithm_id string, score double
"""

ATTRIBUTE_TYPES = ("default", "price", "status")
