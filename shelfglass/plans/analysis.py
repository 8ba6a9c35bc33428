"""Outlier analyses: single runs, work groups, file mode and the parameter sweep."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfglass.functions.display import cluster_label, percent, yes_no
from shelfglass.functions.predicates import measured
from shelfglass.operators import outliers as O
from shelfglass.operators.dbscan import clustered_rows, dbscan
from shelfglass.operators.joins import null_safe_join
from shelfglass.operators.numbering import running_number, text_bucket
from shelfglass.plans.iterations import ids_by_final_status, save_run
from shelfglass.plans.products import (
    basic_groups, category_progress, products_by_ids, products_filtered, products_for_sweep,
    work_groups,
)
from shelfglass.staging import stage

IQR, DBSCAN = "IQR", "DBSCAN"
DIMS = O.DIMENSIONS


def combine_flags(flags: Sequence[str], combine: str = "all") -> Column:
    """One outlier flag of several: 'all' needs every algorithm, 'any' one of them."""
    if combine not in ("all", "any"):
        raise ValueError("combine is 'all' or 'any'")
    joined = F.lit(combine == "all")
    for f in flags:
        flag = F.coalesce(F.col(f), F.lit(False))
        joined = (joined & flag) if combine == "all" else (joined | flag)
    return joined if flags else F.lit(False)


def label_outliers(
    rows: DataFrame,
    population: Sequence[str] = (),
    algorithms: Sequence[str] = (IQR, DBSCAN),
    eps: float = 1.0,
    min_samples: int = 4,
    settings: Sequence[str] | None = None,
    multipliers: Mapping[str, float] | float | None = None,
    type_col: str | None = "product_type",
    order: str = "product_id",
    drop_nonpositive: bool = True,
    combine: str = "all",
) -> DataFrame:
    """Every row with its fences, flags, cluster and combined flag, all populations in one job.

    A population below four rows is not analysed: its rows stay, with NULL flags and clusters. A
    NULL key is a population of its own.
    """
    population = list(population)
    # Staged: sizes, fences and clusters are computed from the same rows in turn.
    rows = stage(rows.filter(measured(*DIMS)), "rows")
    sizes = rows.groupBy(*population).agg((F.count(F.lit(1)) < O.MIN_ROWS).alias("_small"))
    sized = null_safe_join(rows, sizes, population)
    small = sized.filter("_small").drop("_small")
    rows = sized.filter("NOT _small").drop("_small")
    flags = []
    if DBSCAN in algorithms:
        rows = dbscan(rows, population, order, [(eps, min_samples)], settings, DIMS,
                      drop_nonpositive).withColumnRenamed("cluster", "dbscan_cluster").drop(
            "eps", "min_samples")
        rows = rows.withColumn("dbscan_is_outlier", F.col("dbscan_cluster") == -1)
    if IQR in algorithms:
        rows = O.flag_outside(O.with_type_bounds(rows, type_col, population, DIMS, multipliers))
        flags.append("iqr_is_outlier")
    if DBSCAN in algorithms:
        flags.append("dbscan_is_outlier")
    return rows.withColumn("is_outlier_combined", combine_flags(flags, combine)).unionByName(
        small, allowMissingColumns=True)


def population(products: DataFrame, items: DataFrame, group_id: int, mode: str = "all",
               iteration_id: int | None = None, brands=None, category=None, types=None
               ) -> DataFrame:
    """Rows of a run: 'all' the filtered products, 'pending' those a saved run left undecided."""
    if mode == "all":
        return products_filtered(products, group_id, brands, category, types)
    if mode != "pending":
        raise ValueError("mode is 'all' or 'pending'")
    return products_by_ids(products, ids_by_final_status(items, iteration_id, None))


def run_statistics(labelled: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return O.outlier_totals(labelled, "is_outlier_combined", keys)


def run_items(labelled: DataFrame, population: Sequence[str] = ()) -> DataFrame:
    """Clustered rows as result items: status, mode, label, cluster size and share.

    Cluster sizes and shares are those within a ``population``. Rows without a cluster took no
    part in the run and give no item.
    """
    keys = list(population)
    took_part = labelled.filter(F.col("dbscan_cluster").isNotNull()).withColumn(
        "cluster", cluster_label(F.col("dbscan_cluster")))
    sizes = took_part.groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("cluster_items"))
    total = sizes.groupBy(*keys).agg(F.sum("cluster_items").alias("_total"))
    shares = null_safe_join(sizes, total, keys).select(
        *keys, "cluster", "cluster_items",
        percent(F.col("cluster_items"), F.col("_total")).alias("cluster_items_per"))
    noise = F.col("dbscan_cluster") == -1
    return null_safe_join(took_part, shares, [*keys, "cluster"]).select(
        "system_product_id", "brand", "category", "product_type", "cluster", "cluster_items",
        "cluster_items_per", F.when(noise, 0).otherwise(1).alias("status"),
        F.when(noise, 0).alias("outlier_mode"), F.lit(None).cast("int").alias("final_status"))


def run_header(labelled: DataFrame, counts: DataFrame, group_id: int, category: str, eps: float,
               min_samples: int, run_id: str, brand: str | None = None,
               product_type: str | None = None) -> DataFrame:
    """Header row of a run: parameters, population counts, outliers of this run."""
    found = labelled.agg(F.count_if(F.col("is_outlier_combined")).alias("outlier_items"))
    return counts.crossJoin(found).select(  # one row each
        F.lit(group_id).alias("product_group_id"), F.lit(DBSCAN).alias("algorithm"),
        F.lit(brand).cast("string").alias("brand"), F.lit(category).alias("category"),
        F.lit(product_type).cast("string").alias("product_type"), F.lit(eps).alias("eps"),
        F.lit(min_samples).alias("sample"), F.lit(run_id).alias("unique_number"),
        "total_items", "analyzed_items", "pending_items", "outlier_items")


# --- work groups -----------------------------------------------------------------------------

def combination_population(products: DataFrame, group_id: int, brands=None, category=None,
                           types=None, alone_from: int = 50, valid_from: int = 10) -> DataFrame:
    """All products with the key of their work group and ``is_valid``: large enough to be analysed."""
    groups = basic_groups(products, group_id, brands, category, types)
    valid = work_groups(groups, alone_from, valid_from).select("combination_key", "is_valid")
    brand = F.coalesce("brand", F.lit("None"))
    own = F.concat_ws("_", brand, "category", "product_type")
    merged = F.concat_ws("_", brand, "category")
    keyed = groups.select(
        "brand", "category", "product_type",
        F.when(F.col("total_count") >= alone_from, own).otherwise(merged).alias("combination_key"))
    # A key may be that of a group of its own and of a merged one; then any valid one counts.
    valid = valid.groupBy("combination_key").agg(F.max("is_valid").alias("is_valid"))
    keyed = keyed.join(valid, "combination_key")
    rows = products.filter((F.col("group_id") == group_id) & measured()
                           & (F.col("skip_status").isNull() | (F.col("skip_status") != 1)))
    return null_safe_join(rows, keyed, ["brand", "category", "product_type"])


def combination_rows(products: DataFrame, group_id: int, brands=None, category=None, types=None,
                     alone_from: int = 50, valid_from: int = 10) -> DataFrame:
    """Products of the valid work groups with their combination key; ``combination_population`` has
    the others too."""
    return combination_population(products, group_id, brands, category, types, alone_from,
                                  valid_from).filter("is_valid").drop("is_valid")


def combination_statistics(labelled: DataFrame) -> DataFrame:
    """Normal and outlier counts and shares per work group."""
    flag = F.col("is_outlier_combined")
    totals = labelled.groupBy("combination_key").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~flag).alias("normal_count"),
        F.count_if(flag).alias("outlier_count"))
    return totals.select(
        "combination_key", "normal_count", "outlier_count",
        percent(F.col("normal_count"), F.col("total")).alias("normal_count_percent"),
        percent(F.col("outlier_count"), F.col("total")).alias("outlier_count_percent"))


def combination_items(labelled: DataFrame, key: str = "product_id") -> DataFrame:
    """Rows to store of an analysis by work group: statuses 0 = outlier, 1 = normal per algorithm and
    dimension, and mode 0 for what was found automatically; no status where an algorithm did not run."""
    rows = O.flags_as_status(labelled)
    noise = F.col("dbscan_is_outlier")
    return rows.select(key, "combination_key", "iqr_status", *[f"iqr_{d}_status" for d in DIMS],
                       F.when(noise, 0).when(~noise, 1).alias("status"),
                       F.when(noise, 0).alias("outlier_mode"))


# --- earlier outliers ------------------------------------------------------------------------

def with_recomputed_bounds(previous: DataFrame, population: DataFrame,
                           algorithms: Sequence[str] = (IQR, DBSCAN)) -> DataFrame:
    """Earlier outliers with saved flags and fences recomputed over the whole selection.

    Fences appear only where an IQR status was saved: per type when the earlier outliers have
    several types, over the whole selection otherwise. Without a DBSCAN status a row counts as
    marked by hand, that is as noise.
    """
    rows = previous.withColumn("is_outlier_combined", F.lit(True))
    if IQR in algorithms:
        kinds = previous.agg(
            (F.countDistinct("product_type")
             + F.coalesce(F.max(F.col("product_type").isNull().cast("int")), F.lit(0))
             > 1).alias("_several"))
        typed = O.iqr_bounds(population, ["product_type"], clip=True)
        whole = O.iqr_bounds(population, [], clip=True)
        names = [*O.bound_columns(), "n"]
        joined = (
            rows.crossJoin(kinds).crossJoin(whole.withColumnsRenamed({c: f"_w_{c}" for c in names}))
            .join(typed.withColumnsRenamed({c: f"_t_{c}" for c in names}), "product_type", "left")
        )
        for d_col in O.bound_columns():
            chosen = F.when(F.col("_several"), F.when(F.col("_t_n") >= 4, F.col(f"_t_{d_col}"))
                            ).otherwise(F.when(F.col("_w_n") >= 4, F.col(f"_w_{d_col}")))
            joined = joined.withColumn(
                d_col, F.when(F.col("iqr_status").isNotNull() & (F.col("_w_n") >= 4), chosen))
        rows = joined.withColumn("iqr_is_outlier", F.col("iqr_status") == 0).select(
            *rows.columns, "iqr_is_outlier", *O.bound_columns())
    if DBSCAN in algorithms:
        kept = F.col("dbs_status").isNotNull() & (F.col("dbs_status") != 0)
        rows = rows.withColumns({"dbscan_is_outlier": ~kept,
                                 "dbscan_cluster": F.when(kept, 0).otherwise(-1)})
    return rows


# --- file mode -------------------------------------------------------------------------------

def analyse_file_rows(rows: DataFrame, categories: Sequence[str],
                      brands: Sequence[str] | None = None,
                      algorithms: Sequence[str] = (IQR, DBSCAN), order: str = "product_id",
                      eps: float = 1.0, min_samples: int = 4) -> DataFrame:
    """Validity texts per category, Yes = normal; final is Yes when any algorithm says so.

    Categories below four rows stay No with cluster -999.
    """
    if not categories:
        raise ValueError("categories must be selected")
    picked = rows.filter(F.col("category").isin(list(categories)) & measured(*DIMS))
    if brands:
        picked = picked.filter(F.col("brand").isin(list(brands)))
    texts = []
    if DBSCAN in algorithms:
        sizes = picked.groupBy("category").agg(F.count(F.lit(1)).alias("_rows"))
        large = sizes.filter(F.col("_rows") >= O.MIN_ROWS).select(
            "category", F.lit(True).alias("_large"))
        clustered = dbscan(picked, ["category"], order, [(eps, min_samples)], ["size"], DIMS,
                           drop_nonpositive=False).drop("eps", "min_samples")
        ran = F.coalesce("_large", F.lit(False))
        valid = yes_no(ran & (F.col("cluster") != -1))
        picked = clustered.join(large, "category", "left").withColumns({
            "dbscan_cluster": F.when(ran, F.col("cluster")).otherwise(-999),
            **{f"dbscan_{d}": valid for d in DIMS}, "dbscan_status": valid,
        }).drop("cluster", "_large")
        texts.append("dbscan_status")
    if IQR in algorithms:
        bounded = O.flag_outside(O.with_type_bounds(picked, None, ["category"], DIMS))
        picked = O.flags_as_valid_text(bounded).drop(
            "n", *O.bound_columns(), *[f"iqr_{d}_outlier" for d in DIMS], "iqr_is_outlier")
        texts.append("iqr_status")
    final = F.lit(False)
    for t in texts:
        final = final | (F.col(t) == "Yes")
    return picked.withColumn("final_status", yes_no(final))


def brand_category_summary(analysed: DataFrame) -> DataFrame:
    """Totals and shares per brand and category present, by brand, most outliers first."""
    good = F.col("final_status") == "Yes"
    return (
        analysed.na.drop(subset=["brand"]).groupBy("brand", "category").agg(
            F.count(F.lit(1)).alias("total"), F.count_if(good).alias("normal"),
            F.count_if(~good).alias("outlier"))
        .withColumns({"normal_pct": percent(F.col("normal"), F.col("total")),
                      "outlier_pct": percent(F.col("outlier"), F.col("total"))})
        .orderBy("brand", F.col("outlier").desc(), "category")
    )


def file_totals(analysed: DataFrame) -> DataFrame:
    good = F.col("final_status") == "Yes"
    return analysed.agg(F.count(F.lit(1)).alias("analyzed"), F.count_if(good).alias("valid"),
                        F.count_if(~good).alias("invalid"))


def category_profile(analysed: DataFrame) -> DataFrame:
    """Log figures per category: quartiles, fences, counts per algorithm, clusters found."""
    counts = analysed.groupBy("category").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("iqr_status") == "Yes").alias("iqr_normal"),
        F.count_if(F.col("iqr_status") == "No").alias("iqr_outliers"),
        F.count_if(F.col("dbscan_status") == "Yes").alias("dbscan_normal"),
        F.count_if(F.col("dbscan_status") == "No").alias("dbscan_outliers"),
        F.countDistinct(F.when(F.col("dbscan_cluster") >= 0, F.col("dbscan_cluster"))
                        ).alias("clusters"))
    bounds = O.iqr_bounds(analysed, ["category"])
    return counts.join(bounds.drop("n"), "category").select(
        *counts.columns, *[F.round(c, 2).alias(c) for c in O.bound_columns()])


def chart_statistics(labelled: DataFrame) -> DataFrame:
    """Totals with the outlier share to one digit."""
    return O.outlier_totals(labelled, "is_outlier_combined", digits=1).select(
        "total", F.col("normals").alias("normal_count"), F.col("outliers").alias("outlier_count"),
        "outlier_pct")


# Choices of the top-outliers list.
TOP_CHOICES = [(5, "Top 5 Outliers"), (10, "Top 10 Outliers"), (20, "Top 20 Outliers"),
               (30, "Top 30 Outliers"), (50, "Top 50 Outliers"), (100, "Top 50+ Outliers")]


def top_options(labelled: DataFrame) -> DataFrame:
    """Top-n choices, disabled where there are fewer outliers."""
    found = labelled.agg(F.count_if(F.col("is_outlier_combined")).alias("_outliers"))
    choices = labelled.sparkSession.createDataFrame(TOP_CHOICES, "value int, label string")
    return choices.crossJoin(found).select(  # six rows and one row
        "value", "label", (F.col("_outliers") < F.col("value")).alias("disabled")).orderBy("value")


# --- parameter sweep -------------------------------------------------------------------------

# Default settings of the sweep.
SWEEP_CONFIGS = [(e, m) for m in (2, 3, 4) for e in (2.0, 1.5, 1.0, 0.5)]


def config_name(eps: float, min_samples: int) -> str:
    return f"{eps} X {min_samples}"


def sweep_runs(rows: DataFrame, configs: Sequence[tuple[float, int]] = tuple(SWEEP_CONFIGS),
               settings: Sequence[str] | None = None) -> DataFrame:
    """One row per product with ``_runs``, an array of its figures under each setting: executed,
    outliers, status, cluster and its share.

    A setting is executed in categories with at least ``min_samples`` rows. Products without a
    usable dimension take part in no setting: status and cluster stay NULL. All categories and
    settings are clustered in the same jobs. Clusters are counted over weighted points, so products
    are joined once and are not shuffled again for each setting.
    """
    rows = stage(rows, "rows")
    configs = [(float(e), int(m)) for e, m in configs]
    clustered, entry_of, noise = clustered_rows(rows, ["category"], "product_id", configs, settings,
                                                DIMS, min_rows_from_config=True, sizes=True)
    counted = rows.groupBy("category").agg(F.count(F.lit(1)).alias("_rows")).join(
        noise, "category", "left")
    none = F.lit(0).cast("bigint")

    def run(eps: float, need: int) -> Column:
        found, executed = entry_of(eps, need), F.col("_rows") >= need
        cluster = found["cluster"]
        missed = F.coalesce(entry_of(eps, need, "_noise"), none)
        return F.struct(
            F.lit(eps).alias("eps"), F.lit(need).alias("min_samples"), cluster.alias("cluster"),
            executed.alias("executed"), F.when(executed, missed).alias("outliers"),
            F.when(cluster.isNotNull(), F.when(cluster == -1, 0).otherwise(1)).alias("status"),
            cluster_label(cluster).alias("cluster_name"), found["items"].alias("cluster_items"),
            F.when(cluster.isNotNull(), percent(found["items"], found["rows"])
                   ).alias("cluster_items_per"))

    return clustered.join(counted, "category").select(
        *rows.columns, F.array(*[run(e, m) for e, m in configs]).alias("_runs"))


def sweep_long(rows: DataFrame, configs: Sequence[tuple[float, int]] = tuple(SWEEP_CONFIGS),
               settings: Sequence[str] | None = None) -> DataFrame:
    """One row per product and setting, see ``sweep_runs``."""
    runs = sweep_runs(rows, configs, settings)
    return runs.select(*rows.columns, F.explode("_runs").alias("_run")).select(
        *rows.columns, "_run.*")


def sweep_wide(runs: DataFrame, products: DataFrame, group_id: int,
               configs: Sequence[tuple[float, int]] = tuple(SWEEP_CONFIGS)) -> DataFrame:
    """Rows of ``sweep_runs`` as one row per product with five columns per setting and the average
    status; the settings of a product are columns of its row, so nothing is repeated and gathered."""
    from shelfglass.plans.products import present

    described = present(runs, ["system_product_id", "qb_code", "brand", "product_type", "name",
                               "base_image_url", "product_url", "height", "width", "depth"])
    measures = [("Outliers", "outliers"), ("Status", "status"), ("Cluster", "cluster_name"),
                ("Cluster Item Count", "cluster_items"),
                ("Cluster Item Percentage", "cluster_items_per")]
    columns = [F.max(F.col("_runs")[i][c]).alias(f"{config_name(eps, m)} {title}")
               for i, (eps, m) in enumerate(configs) for title, c in measures]
    judged = reduce(add, [F.when(F.col("_runs")[i]["status"].isNotNull(), 1).otherwise(0)
                          for i in range(len(configs))]).cast("bigint")
    normal = reduce(add, [F.coalesce(F.col("_runs")[i]["status"], F.lit(0))
                          for i in range(len(configs))]).cast("bigint")
    executed = reduce(or_, [F.col("_runs")[i]["executed"] for i in range(len(configs))])
    wide = runs.groupBy("product_id").agg(
        F.first("category").alias("category"), *[F.first(c).alias(c) for c in described],
        F.max(executed).alias("_executed"), *columns,
        F.round(F.try_divide(F.sum(normal), F.sum(judged)) * 100, 2).alias("Average Status %"),
        F.sum(judged).alias("Status Column Count"))
    numbered = running_number(runs.select("category").distinct(), [], "category",
                              text_bucket("category"), "Unique Group Key")
    counts = category_progress(products, group_id).select(
        "category", F.col("total").alias("TOTAL ITEMS"),
        F.col("analyzed").alias("Analyzed Item Count"),
        F.col("pending").alias("Pending Item Count"))
    return (
        wide.join(numbered, "category").join(counts, "category", "left")
        .na.fill(0, ["TOTAL ITEMS", "Analyzed Item Count", "Pending Item Count"])
        .withColumn("EXECUTED", yes_no(F.col("_executed"))).drop("_executed")
    )


def min_outlier_config(long: DataFrame) -> DataFrame:
    """Per category the setting with the fewest outliers above zero, first in sweep order."""
    runs = long.filter("outliers > 0").groupBy("category", "eps", "min_samples").agg(
        F.first("outliers").alias("outliers"))
    best = F.min_by(F.struct("eps", "min_samples", "outliers"),
                    F.struct("outliers", "min_samples", -F.col("eps")))
    return runs.groupBy("category").agg(best.alias("b")).select(
        "category", "b.eps", "b.min_samples", "b.outliers")


def sweep(products: DataFrame, group_id: int,
          configs: Sequence[tuple[float, int]] = tuple(SWEEP_CONFIGS),
          settings: Sequence[str] | None = None, brands=None, categories=None,
          types=None) -> DataFrame:
    rows = products_for_sweep(products, group_id, "all", brands, categories, types)
    return sweep_wide(sweep_runs(rows, configs, settings), products, group_id, configs)


def sweep_headers(long: DataFrame, products: DataFrame, group_id: int, run_id: str) -> DataFrame:
    """Header rows to save: one per category and setting."""
    counts = category_progress(products, group_id).withColumnsRenamed(
        {"total": "total_items", "analyzed": "analyzed_items", "pending": "pending_items"})
    runs = long.groupBy("category", "eps", "min_samples").agg(
        F.count_if(F.col("status") == 0).alias("outlier_items"))
    return runs.join(counts, "category", "left").select(
        F.lit(group_id).alias("product_group_id"), F.lit(DBSCAN).alias("algorithm"), "category",
        "eps", F.col("min_samples").alias("sample"), F.lit(run_id).alias("unique_number"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_items", "analyzed_items",
                                                     "pending_items")], "outlier_items")


def sweep_items(long: DataFrame) -> DataFrame:
    """Item rows to save: every product of every setting it took part in."""
    return long.filter(F.col("status").isNotNull()).select(
        "category", "eps", F.col("min_samples").alias("sample"), "system_product_id", "brand",
        "product_type", F.col("cluster_name").alias("cluster"), "cluster_items",
        "cluster_items_per", F.when(F.col("status") == 0, 0).alias("outlier_mode"), "status")


def save_sweep(iterations: DataFrame, items: DataFrame, long: DataFrame, products: DataFrame,
               group_id: int, run_id: str, **same) -> tuple[DataFrame, DataFrame]:
    """Save a whole sweep (rows of ``sweep_long``): a header for each category and setting, and under
    each the items that took part in it, with ids. ``same`` replaces earlier runs, see ``save_run``."""
    return save_run(iterations, items, sweep_headers(long, products, group_id, run_id),
                    sweep_items(long), **same)
