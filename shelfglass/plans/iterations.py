"""Saved analysis runs: loading, histories, votes and corrections."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfglass.functions.display import (
    cluster_label, cluster_number, join_brands, percent, stamp_text, status_text,
)
from shelfglass.functions.predicates import all_of, equals, measured, not_skipped
from shelfglass.operators.joins import latest_by
from shelfglass.operators.keyed import (
    append_with_ids, apply_updates, delete_keys, delete_where, marked, set_where, with_new_ids,
)
from shelfglass.plans.products import ids_of_codes, selection
from shelfglass.staging import stage


# --- loading ---------------------------------------------------------------------------------

def load_run(items: DataFrame, products: DataFrame, iteration_id: int) -> DataFrame:
    """Rows of one saved run with merged outlier flag and cluster number."""
    product = products.select("system_product_id", "qb_code", "brand", "category", "product_type",
                              "name", *[F.nullif(F.col(c), F.lit(0.0)).alias(c)
                                        for c in ("height", "width", "depth")])
    final, status = F.col("final_status"), F.col("status")
    merged = (final == 0) | (final.isNull() & (status == 0))
    return items.filter(F.col("iteration_id") == iteration_id).join(
        product, "system_product_id").withColumns({
            "is_outlier_combined": F.coalesce(merged, F.lit(False)),
            "dbscan_cluster": cluster_number(F.col("cluster"))})


def run_totals(loaded: DataFrame) -> DataFrame:
    """Totals of a loaded run by its final status; unset counts in neither."""
    return loaded.agg(F.count(F.lit(1)).alias("total"),
                      F.count_if(F.col("final_status") == 1).alias("normals"),
                      F.count_if(F.col("final_status") == 0).alias("outliers"))


def ids_by_status(items: DataFrame, iteration_id: int, status: str) -> DataFrame:
    """Products a run found normal or outlier, not yet corrected by hand."""
    wanted = {"normal": 1, "outlier": 0}[status]
    return items.filter((F.col("iteration_id") == iteration_id) & (F.col("status") == wanted)
                        & F.col("final_status").isNull()).select("system_product_id")


def ids_by_final_status(items: DataFrame, iteration_id: int, final: int | None) -> DataFrame:
    return items.filter((F.col("iteration_id") == iteration_id)
                        & F.col("final_status").eqNullSafe(F.lit(final))).select(
        "system_product_id")


def run_filters(items: DataFrame, products: DataFrame, iteration_id: int) -> DataFrame:
    """Distinct brand, category and group values of the products of a run."""
    rows = products.join(items.filter(F.col("iteration_id") == iteration_id),
                         "system_product_id", "left_semi")
    pairs = F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"))
        for f in ("brand", "category", "group_id")]))
    return rows.select(pairs.alias("p")).select("p.*").filter(
        F.col("value").isNotNull() & (F.col("value") != "")).distinct()


def find_run(iterations: DataFrame, group_id: int, brand: str | None, category: str,
             types: Sequence[str] | None, eps: float, sample: int,
             algorithm: str = "DBSCAN") -> DataFrame:
    """Newest saved run with exactly these parameters."""
    stored = "|".join(sorted(types)) if types else None
    wanted = {"product_group_id": group_id, "brand": brand, "category": category,
              "product_type": stored, "eps": eps, "sample": sample, "algorithm": algorithm}
    where = all_of(*[F.col(c).eqNullSafe(F.lit(v)) for c, v in wanted.items()])
    return iterations.filter(where).orderBy(
        F.col("timestamp").desc(), F.col("iteration_id").desc()).limit(1)


def _of_run(brands, category: str, iteration: int | None = None) -> Column:
    return all_of(F.col("category") == category, equals(iteration, "iteration_number"),
                  equals(join_brands(brands), "brand"))


def run_is_saved(results: DataFrame, brands, category: str, iteration: int) -> DataFrame:
    return results.filter(_of_run(brands, category, iteration)).limit(1).agg(
        (F.count(F.lit(1)) > 0).alias("saved"))


def products_for_mode(products: DataFrame, results: DataFrame, brands, category: str,
                      iteration: int, mode: str = "all") -> DataFrame:
    """'all': the measured category slice; 'normal': products the previous run found normal."""
    if mode == "all":
        return products.filter(selection(None, brands, category) & measured())
    normal = (
        results.filter(_of_run(brands, category, iteration - 1))
        .groupBy("system_product_id").agg(F.max("status").alias("_status")).filter("_status = 1"))
    return products.join(normal, "system_product_id", "left_semi")


def latest_items(items: DataFrame) -> DataFrame:
    """Newest item per product: highest run, then highest id."""
    return latest_by(items, ["system_product_id"], [F.col("iteration_id"), F.col("id")])


def history(items: DataFrame, iterations: DataFrame, products: DataFrame | None = None
            ) -> DataFrame:
    """One row per judged item: parameters, status text and date of each correction."""
    judged = items.filter(F.col("analyzed_date").isNotNull())
    if products is not None:
        judged = judged.join(products, "system_product_id", "left_semi")
    run = iterations.select("iteration_id", "eps", "sample")
    return judged.join(run, "iteration_id").select(
        "system_product_id", "id", "eps", "sample",
        status_text(F.col("final_status"), "Unknown").alias("status"),
        stamp_text(F.col("analyzed_date")).alias("date"), "analyzed_date")


def history_lists(entries: DataFrame) -> DataFrame:
    """Per product its history, newest first, as the array a grid row shows.

    The list belongs to one cell; its length is the number of judged runs of one product.
    """
    entry = F.struct("analyzed_date", "id", "eps", "sample", "status", "date")
    return entries.groupBy("system_product_id").agg(
        F.sort_array(F.collect_list(entry), asc=False).alias("history"))


def history_text(entries: Column) -> Column:
    """'EPS: e, Sample: s, Status: x, date' lines joined by ' | '."""
    return F.array_join(F.transform(entries, lambda h: F.concat(
        F.lit("EPS: "), h["eps"].cast("string"), F.lit(", Sample: "), h["sample"].cast("string"),
        F.lit(", Status: "), h["status"], F.lit(", "), h["date"])), " | ")


# --- counts ----------------------------------------------------------------------------------

def counts_per_number(results: DataFrame, category: str, brands=None) -> DataFrame:
    """Per iteration number: products, automatic and manual outliers, the rest normal."""
    out = F.col("status") == 0
    counted = results.filter(_of_run(brands, category)).groupBy("iteration_number").agg(
        F.countDistinct("system_product_id").alias("total"),
        F.count_if(out & (F.col("outlier_mode") == 0)).alias("outlier"),
        F.count_if(out & (F.col("outlier_mode") == 1)).alias("manual_outlier"))
    return counted.select(
        F.col("iteration_number").alias("iteration"), "total",
        (F.col("total") - F.col("outlier") - F.col("manual_outlier")).alias("normal"),
        "outlier", "manual_outlier").orderBy("iteration")


def run_summary(iterations: DataFrame, items: DataFrame, products: DataFrame, where: Column,
                overlapping: bool = False) -> DataFrame:
    """Counts per saved run over its products that are not skipped.

    Disjoint: normal and outlier only count uncorrected items. Overlapping: they include the
    corrected ones. A run whose products are all skipped appears with zeros.
    """
    counted = products.filter(not_skipped()).select("system_product_id", F.lit(True).alias("_in"))
    status, final = F.col("status"), F.col("final_status")
    open_normal, open_outlier = final.isNull() & (status == 1), final.isNull() & (status == 0)
    normal = (final == 1) | open_normal if overlapping else open_normal
    outlier = (final == 0) | open_outlier if overlapping else open_outlier
    runs = iterations.filter(where).select("iteration_id", "eps", "sample")
    rows = items.join(runs, "iteration_id").join(counted, "system_product_id", "left")
    here = F.coalesce("_in", F.lit(False))
    figures = {"total_count": here, "normal_count": here & normal, "outlier_count": here & outlier,
               "manual_outlier_count": here & (final == 0),
               "manual_normal_count": here & (final == 1)}
    return rows.groupBy("iteration_id", "eps", "sample").agg(
        *[F.count_if(c).alias(k) for k, c in figures.items()]).orderBy("iteration_id")


def cluster_statistics(items: DataFrame) -> DataFrame:
    """Items per cluster label of a run and their share of the run."""
    sizes = items.groupBy("iteration_id", "cluster").agg(F.count(F.lit(1)).alias("cluster_items"))
    totals = sizes.groupBy("iteration_id").agg(F.sum("cluster_items").alias("_total"))
    return sizes.join(totals, "iteration_id").select(
        "iteration_id", "cluster", "cluster_items",
        percent(F.col("cluster_items"), F.col("_total")).alias("cluster_items_per"))


# --- votes -----------------------------------------------------------------------------------

def averaged_status(items: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Status by average over all items of a product; a manual majority forces outlier."""
    rows = items.join(ids, "system_product_id", "left_semi") if ids is not None else items
    votes = rows.groupBy("system_product_id").agg(
        F.avg("status").alias("_status"), F.avg("outlier_mode").alias("_mode"))
    dbs = F.when(F.col("_status") >= 0.5, 1).otherwise(0)
    manual = F.coalesce(F.col("_mode") >= 0.5, F.lit(False))
    return votes.select("system_product_id", dbs.alias("dbs_status"),
                        F.when(manual, 0).otherwise(dbs).alias("final_status"),
                        F.when(manual, 1).alias("outlier_mode"))


def majority_vote(results: DataFrame, category: str, brands=None) -> DataFrame:
    """Per product: status of each algorithm, outlier when either algorithm says so.

    An algorithm says outlier when at least half of its results do. A manual mark on an outlier
    wins over an automatic one.
    """
    out = F.col("status") == 0
    votes = results.filter(_of_run(brands, category)).groupBy("system_product_id", "algo_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(out).alias("_out"),
        F.count_if(out & (F.col("outlier_mode") == 1)).alias("_manual"))
    votes = votes.withColumn("_vote", F.when(F.col("_out") / F.col("_n") >= 0.5, 0).otherwise(1))
    known = F.col("algo_id").isin("IQR", "DBSCAN")
    per_product = votes.groupBy("system_product_id").agg(
        F.max(F.when(F.col("algo_id") == "IQR", F.col("_vote"))).alias("iqr_status"),
        F.max(F.when(F.col("algo_id") == "DBSCAN", F.col("_vote"))).alias("dbs_status"),
        F.min(F.when(known, F.col("_vote"))).alias("final_status"),
        F.max(F.when((F.col("_vote") == 0) & (F.col("_manual") > 0), 1).otherwise(0)
              ).alias("_manual_outlier"))
    mode = F.when(F.col("final_status") == 0, F.col("_manual_outlier"))
    return per_product.withColumn("outlier_mode", mode).drop("_manual_outlier")


# --- saving and deleting ---------------------------------------------------------------------

def save_header(iterations: DataFrame, header: DataFrame) -> DataFrame:
    """Append header rows with new ids, in category, eps and sample order, then by brand, type and
    group."""
    rest = [F.coalesce(F.col(c).cast("string"), F.lit(""))
            for c in ("brand", "product_type", "product_group_id") if c in header.columns]
    order = F.concat_ws("|", F.coalesce("category", F.lit("")),
                        F.format_string("%012.4f", F.col("eps").cast("double")),
                        F.format_string("%06d", F.col("sample").cast("int")), *rest)
    return append_with_ids(iterations, header.withColumn("_key", order), "iteration_id",
                           "_key").drop("_key")


def delete_runs(iterations: DataFrame, items: DataFrame, gone: DataFrame
                ) -> tuple[DataFrame, DataFrame]:
    """Remove runs and, with them, their items."""
    return (delete_keys(iterations, gone, "iteration_id"), delete_keys(items, gone, "iteration_id"))


def matching_runs(group_id=None, brand=None, category=None, types=None, eps=None, sample=None,
                  algorithm=None) -> Column:
    """Runs by equality on the given parameters; None means any."""
    stored = "|".join(sorted(types)) if types else None
    return all_of(equals(group_id, "product_group_id"), equals(brand, "brand"),
                  equals(category, "category"), equals(stored, "product_type"),
                  equals(eps, "eps"), equals(sample, "sample"), equals(algorithm, "algorithm"))


def delete_matching_runs(iterations: DataFrame, items: DataFrame, **filters
                         ) -> tuple[DataFrame, DataFrame]:
    gone = iterations.filter(matching_runs(**filters)).select("iteration_id")
    return delete_runs(iterations, items, gone)


# What headers and items may both carry.
RUN_PARAMETERS = ("product_group_id", "brand", "category", "product_type", "eps", "sample")


def items_to_headers(found: DataFrame, headers: DataFrame, shared: Sequence[str]) -> DataFrame:
    """Each item with the ``iteration_id`` of the one header that fits it best.

    A header fits if it agrees in every parameter; one it leaves NULL agrees with any, and one that
    an item leaves NULL only with that. Of several that fit, the one with the most parameters set
    counts, then the first to set them in the order of ``shared``, then the smallest id. Items
    without a header are left out. Each set of parameters that headers leave NULL is one equi-join
    with one row per key.
    """
    open_sets = headers.select(*[F.col(c).isNull().alias(c) for c in shared]).distinct().collect()
    found, ids = found.drop("iteration_id"), []
    for nulls in sorted(open_sets, key=lambda r: (sum(r), tuple(r))):  # at most 2 ** len(shared)
        given = [c for c in shared if not nulls[c]]
        same = [F.col(c).isNull() if nulls[c] else F.col(c).isNotNull() for c in shared]
        of_set = headers.filter(reduce(and_, same, F.lit(True))).groupBy(
            *[F.col(c).alias(f"_h_{c}") for c in given]).agg(
            F.min("iteration_id").alias(f"_id{len(ids)}"))
        on = reduce(and_, [found[c] == of_set[f"_h_{c}"] for c in given], F.lit(True))
        found = found.join(of_set, on, "left").drop(*[f"_h_{c}" for c in given])
        ids.append(f"_id{len(ids)}")
    best = F.coalesce(*ids) if ids else F.lit(None).cast("bigint")
    return found.withColumn("iteration_id", best).drop(*ids).filter(F.col("iteration_id").isNotNull())


def save_run(iterations: DataFrame, items: DataFrame, header: DataFrame, found: DataFrame,
             **same) -> tuple[DataFrame, DataFrame]:
    """Replace the runs with the parameters ``same`` by new ones: headers and items.

    An item goes to the new header that fits it best, see ``items_to_headers``. Items get ids after
    the greatest present one.
    """
    kept, kept_items = delete_matching_runs(iterations, items, **same) if same else (
        iterations, items)
    saved = stage(save_header(kept, header), "headers")
    new = saved.join(kept.select("iteration_id"), "iteration_id", "left_anti")
    shared = [c for c in RUN_PARAMETERS if c in found.columns and c in header.columns]
    new_items = items_to_headers(found, new, shared)
    new_items = new_items.select(*[c for c in new_items.columns if c in items.columns])
    if "id" in items.columns:
        order = [c for c in ("iteration_id", "system_product_id") if c in new_items.columns]
        new_items = with_new_ids(new_items, items, "id", order)
    return saved, kept_items.unionByName(new_items, allowMissingColumns=True)


def refresh_products(products: DataFrame, items: DataFrame, ids: DataFrame,
                     stamp: Column | None = None) -> DataFrame:
    """Statuses of the given products from the average over all their saved items."""
    return update_status_fields(products, averaged_status(items, ids), stamp)


RESET_FIELDS = ("final_status", "dbs_status", "analyzed_date", "eps", "sample")
ANALYSIS_FIELDS = ("iqr_status", "iqr_height_status", "iqr_width_status", "iqr_depth_status",
                   "dbs_status", "final_status", "outlier_mode", "iteration_closed",
                   "analyzed_date")


def reset_runs(iterations: DataFrame, items: DataFrame, products: DataFrame, group_id: int,
               category: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drop the runs of a category and clear the products they touched."""
    gone = iterations.filter(
        (F.col("product_group_id") == group_id) & (F.col("category") == category)
    ).select("iteration_id")
    touched = items.join(gone, "iteration_id", "left_semi").select("system_product_id")
    cleared = marked(products, touched, ["system_product_id"], "_touched")
    cleared = set_where(cleared, F.col("_touched"), {
        c: None for c in RESET_FIELDS if c in products.columns}).drop("_touched")
    kept, kept_items = delete_runs(iterations, items, gone)
    return kept, kept_items, cleared


def delete_results(results: DataFrame, brands, category: str) -> DataFrame:
    """Older per-number results of a category without those of the brand selection."""
    return delete_where(results, _of_run(brands, category))


def reset_fields(products: DataFrame, group_id: int, brands=None, category=None, types=None
                 ) -> DataFrame:
    """Clear the analysis fields of a selection."""
    return set_where(products, selection(group_id, brands, category, types),
                     {c: None for c in ANALYSIS_FIELDS if c in products.columns})


# --- corrections -----------------------------------------------------------------------------

def update_status_fields(products: DataFrame, updates: DataFrame, stamp: Column | None = None
                         ) -> DataFrame:
    """Set exactly the status columns ``updates`` carries, and the date when there is one."""
    if stamp is not None and "analyzed_date" in products.columns:
        updates = updates.withColumn("analyzed_date", stamp)
    return apply_updates(products, updates, ["system_product_id"])


def update_eps_sample(products: DataFrame, updates: DataFrame, group_id: int, stamp: Column
                      ) -> DataFrame:
    """Final and DBSCAN status, eps, sample and date of products of one group.

    updates: system_product_id, final_status, eps, sample; a NULL status clears the date.
    """
    rows = updates.select(
        "system_product_id", F.lit(group_id).alias("group_id"), "final_status",
        F.col("final_status").alias("dbs_status"), "eps", "sample",
        F.when(F.col("final_status").isNotNull(), stamp).alias("analyzed_date"))
    return apply_updates(products, rows, ["system_product_id", "group_id"])


RESULT_FIELDS = ("iqr_status", "iqr_height_status", "iqr_width_status", "iqr_depth_status",
                 "dbs_status", "final_status")


def overwrite_results(products: DataFrame, updates: DataFrame, stamp: Column | None = None
                      ) -> DataFrame:
    """Full overwrite of the statuses by product id; a status absent from ``updates`` is cleared.

    A manual mark survives on outliers, automatic outliers get mode 0, normal has no mode. The
    closing run changes only where one is given.
    """
    fields = [c for c in RESULT_FIELDS if c in products.columns]
    rows = updates.select(
        "product_id", F.lit(True).alias("_hit"),
        *[(F.col(c) if c in updates.columns else F.lit(None).cast("int")).alias(f"_new_{c}")
          for c in fields],
        (F.col("iteration_closed") if "iteration_closed" in updates.columns
         else F.lit(None).cast("int")).alias("_closed"))
    joined = products.join(rows, "product_id", "left")
    final = F.col("_new_final_status")
    mode = (F.when(final == 1, None)
            .when((final == 0) & (F.coalesce("outlier_mode", F.lit(0)) != 1), 0)
            .otherwise(F.col("outlier_mode")))
    values = {**{c: F.col(f"_new_{c}") for c in fields}, "outlier_mode": mode,
              "iteration_closed": F.coalesce("_closed", "iteration_closed")}
    if stamp is not None and "analyzed_date" in products.columns:
        values["analyzed_date"] = stamp
    return set_where(joined, F.col("_hit"), values).select(*products.columns)


def set_final_status(products: DataFrame, codes: DataFrame, status: int,
                     iteration: int | None = None) -> DataFrame:
    """Final status by code: mode 1 on outliers, none on normals, closed in the given run."""
    hit = marked(products, codes, ["qb_code"], "_hit")
    values = {"final_status": status, "outlier_mode": 1 if status == 0 else None}
    if iteration is not None:
        values["iteration_closed"] = iteration
    return set_where(hit, F.col("_hit"), values).drop("_hit")


def mark_results(results: DataFrame, ids: DataFrame, brands, category: str, iteration: int
                 ) -> DataFrame:
    """Mark results of the given products in one run as manual outliers."""
    hit = marked(results, ids, ["system_product_id"], "_hit")
    return set_where(hit, F.col("_hit") & _of_run(brands, category, iteration),
                     {"status": 0, "outlier_mode": 1}).drop("_hit")


def mark_outliers(products: DataFrame, results: DataFrame, codes: DataFrame, brands,
                  category: str, iteration: int) -> tuple[DataFrame, DataFrame]:
    """Mark products as outliers in one run and vote again over all runs."""
    new_results = mark_results(results, ids_of_codes(products, codes), brands, category, iteration)
    votes = majority_vote(new_results, category, brands)
    # Only an algorithm that voted changes its own status column.
    own = ("iqr_status", "dbs_status")
    both = apply_updates(products, votes.select(
        "system_product_id", "final_status", "outlier_mode", *own), ["system_product_id"],
        unique=True, keep_on_null=own)
    return both, new_results


def set_skip(products: DataFrame, ids: DataFrame, skip: int, stamp: Column | None = None
             ) -> DataFrame:
    """Skip flag by product id; only the single form passes a date."""
    hit = marked(products, ids, ["product_id"], "_hit")
    values: dict = {"skip_status": skip}
    if stamp is not None and "analyzed_date" in products.columns:
        values["analyzed_date"] = stamp
    return set_where(hit, F.col("_hit"), values).drop("_hit")


def set_item_final_status(items: DataFrame, ids: DataFrame, iteration_id: int,
                          final: int | None, stamp: Column) -> DataFrame:
    """Final status of items of one run; the date is set or cleared with it."""
    hit = marked(items, ids, ["system_product_id"], "_hit")
    return set_where(hit, F.col("_hit") & (F.col("iteration_id") == iteration_id), {
        "final_status": final,
        "analyzed_date": None if final is None else stamp}).drop("_hit")


def set_item_status(items: DataFrame, ids: DataFrame, iteration_id: int, status: int,
                    outlier_mode: int | None) -> DataFrame:
    hit = marked(items, ids, ["system_product_id"], "_hit")
    return set_where(hit, F.col("_hit") & (F.col("iteration_id") == iteration_id), {
        "status": status, "outlier_mode": outlier_mode}).drop("_hit")


def correct_cluster(products: DataFrame, items: DataFrame, codes: DataFrame, iteration_id: int,
                    final: int | None, group_id: int, eps: Column, sample: Column, stamp: Column
                    ) -> tuple[DataFrame, DataFrame]:
    """Set, or with None remove, the final status of the coded products in a run and group.

    A removal keeps the run's eps and sample; single-item removals pass NULL columns instead.
    """
    ids = ids_of_codes(products, codes).distinct()
    updates = ids.select("system_product_id", F.lit(final).cast("int").alias("final_status"),
                         eps.alias("eps"), sample.alias("sample"))
    return (update_eps_sample(products, updates, group_id, stamp),
            set_item_final_status(items, ids, iteration_id, final, stamp))


def result_rows(labelled: DataFrame, algorithms: Sequence[str], iteration: int, brands,
                category: str, eps: float, min_samples: int) -> DataFrame:
    """Labelled products to one result row per algorithm; DBSCAN rows carry its parameters."""
    dbs = F.col("algo_id") == "DBSCAN"
    return labelled.filter(F.col("system_product_id").isNotNull()).select(
        "system_product_id", F.lit(iteration).alias("iteration_number"),
        F.explode(F.array(*[F.lit(a) for a in algorithms])).alias("algo_id"),
        F.lit(join_brands(brands)).alias("brand"), F.lit(category).alias("category"),
        F.when(F.col("is_outlier_combined"), 0).otherwise(1).alias("status"),
        cluster_label(F.col("dbscan_cluster")).alias("_cluster")
    ).select(
        "system_product_id", "iteration_number", "algo_id", "brand", "category", "status",
        F.when(dbs, F.lit(eps)).alias("eps"), F.when(dbs, F.lit(min_samples)).alias("sample"),
        F.when(dbs, F.col("_cluster")).alias("cluster"), F.lit(0).alias("outlier_mode"))


def swap_dimensions(products: DataFrame, where: Column, first: str, second: str) -> DataFrame:
    """Exchange two dimension columns on the selected rows."""
    for c in (first, second):
        if c not in ("height", "width", "depth"):
            raise ValueError(f"not a dimension: {c}")
    return set_where(products, where, {first: F.col(second), second: F.col(first)})


def restore_dimensions(products: DataFrame, where: Column) -> DataFrame:
    """Original dimensions back where they are known."""
    return set_where(products, where, {
        d: F.coalesce(f"ori_{d}", d) for d in ("height", "width", "depth")})


