"""Selections and counts over the product table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfglass.functions.display import label_count, to_number
from shelfglass.functions.predicates import (
    all_of, any_of, equals, measured, not_skipped, skip_choice, status_choice,
)

DIMENSIONS = ("height", "width", "depth")

# Columns of an analysis row and their short names in analyses and files.
ANALYSIS_COLUMNS = ["product_id", "system_product_id", "qb_code", "brand", "category",
                    "product_type", "name", "height", "width", "depth", "weight",
                    "base_image_url", "product_url", "outlier_mode"]
SHORT_NAMES = {"qb_code": "SKU", "brand": "Brand", "category": "Category", "product_type": "Type",
               "name": "Name", "height": "H", "width": "W", "depth": "D",
               "base_image_url": "imageUrl", "product_url": "url_key"}


def present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def selection(group_id: int | None = None, brands=None, categories=None, types=None) -> Column:
    """Group, brand, category and type restrictions; a missing one restricts nothing."""
    if isinstance(categories, str):
        categories = [categories]
    return all_of(equals(group_id, "group_id"), any_of(brands, "brand"),
                  any_of(categories, "category"), any_of(types, "product_type"))


def products_filtered(products: DataFrame, group_id: int, brands=None, category=None,
                      types=None) -> DataFrame:
    """Measured products of a group that are not skipped, by product id."""
    return (
        products.filter(selection(group_id, brands, category, types) & measured() & not_skipped())
        .select(*present(products, ANALYSIS_COLUMNS)).orderBy("product_id")
    )


def products_for_iteration(products: DataFrame, group_id: int, iteration: int, brands=None,
                           category=None, types=None) -> DataFrame:
    """As ``products_filtered``; from run 2 on, products closed in this run or still normal."""
    if iteration > 1:
        closed = F.col("iteration_closed")
        products = products.filter(
            (closed == iteration)
            | ((closed == iteration - 1) & (F.col("final_status") == 1)))
    return products_filtered(products, group_id, brands, category, types)


def analysis_rows(products: DataFrame, group_id: int, brands=None, category=None, types=None,
                  iteration: int = 1, for_save: bool = False) -> DataFrame:
    """Short-named rows with numeric dimensions, ready for an analysis."""
    if iteration > 1 and not for_save:
        rows = products_for_iteration(products, group_id, iteration, brands, category, types)
    else:
        rows = products_filtered(products, group_id, brands, category, types)
    rows = rows.withColumnsRenamed(SHORT_NAMES)
    return rows.withColumns({c: to_number(F.col(c)) for c in ("H", "W", "D")}).na.drop(
        subset=["H", "W", "D"])


def products_by_ids(products: DataFrame, ids: DataFrame) -> DataFrame:
    """Products whose system_product_id occurs in ``ids``."""
    return products.join(ids, "system_product_id", "left_semi").select(
        *present(products, ANALYSIS_COLUMNS))


def previous_outliers(products: DataFrame, group_id: int, category: str, iteration: int,
                      brands=None, types=None) -> DataFrame:
    """Outliers closed before run ``iteration``; none before run 2."""
    earlier = F.lit(iteration > 1) & (F.col("iteration_closed") < iteration)
    return products.filter(
        selection(group_id, brands, category, types) & not_skipped() & earlier
        & (F.col("final_status") == 0)
    ).orderBy("product_id")


def saved_state(products: DataFrame, group_id: int, category: str, brands=None,
                types=None) -> DataFrame:
    """Category slice with saved statuses as flags; a missing status is not an outlier."""
    is_zero = lambda c: F.coalesce(F.col(c) == 0, F.lit(False))
    rows = products.filter(
        selection(group_id, brands, category, types) & measured() & not_skipped())
    return rows.withColumns({
        "is_outlier": is_zero("final_status"),
        "iqr_is_outlier": is_zero("iqr_status"),
        "dbscan_is_outlier": is_zero("dbs_status"),
        "dbscan_cluster": F.when(is_zero("dbs_status"), -1).otherwise(0),
    }).orderBy("product_id")


def products_for_sweep(products: DataFrame, group_id: int, record_type: str = "all", brands=None,
                       categories=None, types=None) -> DataFrame:
    """Fully described products of a group (skipped ones included), by brand, category, type."""
    where = selection(group_id, brands, categories, types) & measured(
        "height", "width", "depth", "brand", "category", "product_type")
    if record_type == "pending":
        where = where & F.col("final_status").isNull()
    return products.filter(where).orderBy("brand", "category", "product_type", "product_id")


def grid_filter(group_id: int, brands=None, categories=None, types=None, final_status=None,
                skip_status=None) -> Column:
    return all_of(selection(group_id, brands, categories, types), skip_choice(skip_status),
                  status_choice(final_status, "final_status"))


def by_code(products: DataFrame, qb_code: str) -> DataFrame:
    """First product with a code, in id order."""
    return products.filter(F.col("qb_code") == qb_code).orderBy("product_id").limit(1)


def ids_of_codes(products: DataFrame, codes: DataFrame) -> DataFrame:
    """system_product_id of the products whose qb_code occurs in ``codes``."""
    return products.join(codes, "qb_code", "left_semi").select("system_product_id")


def group_options(groups: DataFrame) -> DataFrame:
    """Groups by name with option label; the default marks the selected one."""
    return groups.withColumn("label", label_count(F.col("name"), F.col("product_count"))).orderBy(
        "name", "group_id")


def default_group(groups: DataFrame) -> DataFrame:
    return groups.filter(F.col("default_selected") == 1).orderBy("group_id").limit(1)


# --- counts ----------------------------------------------------------------------------------

def option_counts(products: DataFrame, field: str, group_id: int, brands=None, categories=None,
                  types=None) -> DataFrame:
    """Per value of ``field``: products and analysed products, with an option label.

    Brands come alphabetically, categories and types by size.
    """
    counted = products.filter(
        selection(group_id, brands, categories, types) & measured() & F.col(field).isNotNull()
    ).groupBy(field).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("final_status").isin(0, 1)).alias("analyzed"),
    ).withColumn("label", label_count(F.col(field), F.col("total")))
    return counted.orderBy(field) if field == "brand" else counted.orderBy(
        F.col("total").desc(), field)


def value_counts(products: DataFrame, field: str, where: Column | None = None) -> DataFrame:
    """Products per value, alphabetically, with an option label; NULL is no value."""
    rows = products.filter(where) if where is not None else products
    return (
        rows.filter(F.col(field).isNotNull()).groupBy(field)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("label", label_count(F.col(field), F.col("n"))).orderBy(field)
    )


def chart_counts(products: DataFrame, field: str, group_id: int, brands=None,
                 categories=None) -> DataFrame:
    return value_counts(products, field, selection(group_id, brands, categories) & measured())


def status_counts(products: DataFrame, field: str, group_id: int, final_status=None, brands=None,
                  categories=None) -> DataFrame:
    """Counts restricted by the Pending / Normal / Outlier choice."""
    where = all_of(selection(group_id, brands, categories), measured(),
                   status_choice(final_status, "final_status"))
    return value_counts(products, field, where)


def analysed_status(products: DataFrame, group_id: int, brands=None, categories=None) -> DataFrame:
    """full / partial per brand, category and type; values without analysis are left out.

    The brand list ignores the brand and category choice, the category list the category choice.
    """
    chosen = {"brand": selection(group_id), "category": selection(group_id, brands),
              "product_type": selection(group_id, brands, categories)}
    counted = field_values(products.filter(selection(group_id) & measured()), chosen).groupBy(
        "field", "value").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("final_status").isNotNull()).alias("analyzed"))
    status = F.when(F.col("analyzed") == F.col("total"), "full").otherwise("partial")
    return counted.filter("analyzed > 0").select("field", "value", status.alias("status"))


def field_values(rows: DataFrame, chosen: Mapping[str, Column]) -> DataFrame:
    """Rows once for each field with a value and a true condition, as (field, value, ...): one scan
    serves groupings by several fields."""
    entries = F.array_compact(F.array(*[
        F.when(where & F.col(f).isNotNull(), F.struct(F.lit(f).alias("field"), F.col(f).alias("value")))
        for f, where in chosen.items()]))
    return rows.select("*", F.explode(entries).alias("_entry")).select("_entry.*", *rows.columns)


def basic_groups(products: DataFrame, group_id: int, brands=None, category=None,
                 types=None) -> DataFrame:
    """Measured products per brand, category and type, skipped ones left out."""
    return (
        products.filter(selection(group_id, brands, category, types) & measured() & not_skipped())
        .groupBy("brand", "category", "product_type").agg(F.count(F.lit(1)).alias("total_count"))
        .orderBy("brand", "category", "product_type")
    )


def category_progress(products: DataFrame, group_id: int, categories=None) -> DataFrame:
    """Total, analysed and pending products per category."""
    final = F.col("final_status")
    return products.filter(
        selection(group_id, None, categories) & measured() & F.col("category").isNotNull()
    ).groupBy("category").agg(
        F.count("system_product_id").alias("total"),
        F.count_if(final.isNotNull()).alias("analyzed"),
        F.count_if(final.isNull()).alias("pending"),
    )


def header_counts(products: DataFrame, group_id: int, brands=None, category=None,
                  types=None) -> DataFrame:
    """Total, analysed and pending products of one selection, in one pass."""
    final = F.col("final_status")
    return products.filter(
        selection(group_id, brands, category, types) & measured()
    ).agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count_if(final.isNotNull()).alias("analyzed_items"),
        F.count_if(final.isNull()).alias("pending_items"),
    )


def work_groups(groups: DataFrame, alone_from: int = 50, valid_from: int = 10) -> DataFrame:
    """Groups large enough stand alone; smaller ones merge by brand and category."""
    brand = F.coalesce("brand", F.lit("None"))
    large = groups.filter(F.col("total_count") >= alone_from).select(
        F.concat_ws("_", brand, "category", "product_type").alias("combination_key"),
        "brand", "category", "product_type", "total_count", F.lit(True).alias("is_valid"))
    # One list entry per product type below the size limit, never one per product.
    merged = (
        groups.filter(F.col("total_count") < alone_from).groupBy("brand", "category").agg(
            F.sum("total_count").alias("total_count"),
            F.array_join(F.array_sort(F.collect_list("product_type")), "|").alias("product_type"))
        .select(F.concat_ws("_", brand, "category").alias("combination_key"), "brand",
                "category", "product_type", "total_count",
                (F.col("total_count") >= valid_from).alias("is_valid"))
    )
    return large.unionByName(merged)
