"""Grid pages over products, runs and matching results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfglass.functions.display import number_or_zero, skip_text, status_text
from shelfglass.functions.predicates import (
    all_of, any_of, cluster_choice, skip_choice, status_choice,
)
from shelfglass.operators.numbering import POSITION_BITS, range_sizes, sorted_ranges
from shelfglass.plans.iterations import history, history_lists, history_text, latest_items
from shelfglass.plans.products import grid_filter

RUN_COLUMNS = ("eps", "sample", "total_items", "analyzed_items", "pending_items", "outlier_items")
ITEM_COLUMNS = ("cluster_items", "cluster_items_per", "cluster")
SORTABLE = ("system_product_id", "qb_code", "brand", "category", "product_type", "name", "height",
            "width", "depth", "eps", "sample", "final_status", "skip_status", "total_items",
            "analyzed_items", "pending_items", "outlier_items", "cluster_items",
            "cluster_items_per", "cluster")


def _sort_keys(column: str | None, direction: str) -> list[tuple[Column, str, bool]]:
    """Order of a page as (key, its column, descending)."""
    if column in SORTABLE:
        c = F.col(column).try_cast("bigint") if column == "system_product_id" else F.col(column)
        keys = [(c, column, direction == "desc")]
    else:
        keys = [(F.col(c), c, False) for c in ("category", "cluster_items", "cluster")]
    return [*keys, *[(F.col(c), c, False) for c in ("product_id", "_tie")]]


def sort_columns(column: str | None = None, direction: str = "asc") -> list[Column]:
    """Order of a page; unknown columns fall back to category, cluster size and cluster.

    NULLs come first ascending and last descending; product ids order as numbers and break ties.
    """
    return [c.desc_nulls_last() if down else c.asc_nulls_first()
            for c, _, down in _sort_keys(column, direction)]


def _with_tie(rows: DataFrame) -> DataFrame:
    return rows if "_tie" in rows.columns else rows.withColumn("_tie", F.lit(0))


def page(rows: DataFrame, number: int, size: int, column: str | None = None,
         direction: str = "asc") -> DataFrame:
    """One page; Spark keeps the best (number x size) rows per task, it sorts nothing whole.

    For deep pages see ``page_index`` and ``page_after``.
    """
    ordered = _with_tie(rows).orderBy(*sort_columns(column, direction))
    return ordered.offset((number - 1) * size).limit(size).drop("_tie")


@dataclass(frozen=True)
class PageIndex:
    """A grid in its order, written once, and the sizes of its ranges, one per task that wrote it."""

    rows: DataFrame
    ranges: tuple[tuple[int, int], ...]

    def page(self, number: int, size: int) -> DataFrame:
        """A page: only the files of the ranges it lies in are read, and of them its rows."""
        first, before, where = (number - 1) * size, 0, F.lit(False)
        for part, n in self.ranges:
            low, high = max(first - before, 0), min(first + size - before, n)
            if low < high:
                start = part << POSITION_BITS
                where = where | F.col("_at").between(start + low, start + high - 1)
            before += n
        return self.rows.filter(where).orderBy("_at").drop("_at", "_tie")


def page_index(rows: DataFrame, column: str | None = None, direction: str = "asc") -> PageIndex:
    """Sort a grid once for any number of pages, however deep."""
    placed = sorted_ranges(_with_tie(rows), sort_columns(column, direction))
    sizes = sorted((r["_range"], r["_size"]) for r in range_sizes(placed).collect())
    return PageIndex(placed, tuple(sizes))


def page_after(rows: DataFrame, size: int, last: Mapping[str, Any] | None = None,
               column: str | None = None, direction: str = "asc") -> DataFrame:
    """The page that follows the row ``last`` of the page before (None: the first page).

    ``last`` names the sort columns, ``product_id`` and, where the grid has it, ``_tie``. The rows
    before it are filtered out, so a task keeps ``size`` rows only. The page keeps ``_tie``.
    """
    rows = _with_tie(rows)
    if last is not None:
        behind, equal = F.lit(False), F.lit(True)
        for key, name, down in _sort_keys(column, direction):
            value = last["_tie"] if name == "_tie" and "_tie" in last else (
                0 if name == "_tie" else last[name])
            if name == "system_product_id" and value is not None:
                value = int(value) if str(value).strip().lstrip("+-").isdigit() else None
            if value is None:
                later = F.lit(False) if down else key.isNotNull()
            else:
                later = (key < F.lit(value)) | key.isNull() if down else key > F.lit(value)
            behind = behind | (equal & later)
            equal = equal & key.eqNullSafe(F.lit(value))
        rows = rows.filter(behind)
    return rows.orderBy(*sort_columns(column, direction)).limit(size)


def run_rows(products: DataFrame, items: DataFrame, iterations: DataFrame) -> DataFrame:
    """Product, item and run side by side; item statuses win over product statuses."""
    run = iterations.select("iteration_id", *RUN_COLUMNS)
    item = items.select("iteration_id", "system_product_id", F.col("id").alias("_tie"), "status",
                        F.col("final_status").alias("_final"),
                        *[c for c in ITEM_COLUMNS if c in items.columns])
    base = products.drop("final_status", "eps", "sample", *ITEM_COLUMNS)
    return base.join(item, "system_product_id").join(run, "iteration_id").withColumnRenamed(
        "_final", "final_status")


def run_filter(iteration_id: int, brands=None, categories=None, types=None, final_status=None,
               skip_status=None, clusters=None) -> Column:
    return all_of(F.col("iteration_id") == iteration_id, any_of(brands, "brand"),
                  any_of(categories, "category"), any_of(types, "product_type"),
                  cluster_choice(clusters, "cluster"), skip_choice(skip_status),
                  status_choice(final_status, "final_status"))


def latest_rows(products: DataFrame, items: DataFrame, iterations: DataFrame) -> DataFrame:
    """Products with their newest item and its run, both optional."""
    newest = latest_items(items).select(
        "system_product_id", "iteration_id", *[c for c in ITEM_COLUMNS if c in items.columns])
    run = iterations.select("iteration_id", *RUN_COLUMNS)
    base = products.drop("eps", "sample", *ITEM_COLUMNS)
    return base.join(newest, "system_product_id", "left").join(run, "iteration_id", "left")


def displayed(rows: DataFrame) -> DataFrame:
    """Display values: empty texts, zero numbers, status words."""
    texts = [c for c in ("system_product_id", "qb_code", "brand", "category", "product_type",
                         "name", "cluster", "base_image_url", "product_url") if c in rows.columns]
    numbers = [c for c in ("height", "width", "depth", "cluster_items_per") if c in rows.columns]
    counts = [c for c in ("total_items", "analyzed_items", "pending_items", "outlier_items",
                          "cluster_items") if c in rows.columns]
    return rows.withColumns({
        **{c: F.coalesce(c, F.lit("")) for c in texts},
        **{c: number_or_zero(F.col(c).cast("double")) for c in numbers},
        **{c: F.coalesce(c, F.lit(0)) for c in counts},
        "eps": F.coalesce(F.nullif(F.col("eps").cast("double"), F.lit(0.0)).cast("string"),
                          F.lit("-")),
        "sample": F.coalesce(F.nullif(F.col("sample"), F.lit(0)).cast("string"), F.lit("-")),
        "final_status": status_text(F.col("final_status")),
    })


def run_page(products: DataFrame, items: DataFrame, iterations: DataFrame, iteration_id: int,
             number: int, size: int, column: str | None = None, direction: str = "asc", **choice
             ) -> DataFrame:
    rows = run_rows(products, items, iterations).filter(run_filter(iteration_id, **choice))
    return displayed(page(rows, number, size, column, direction))


def main_rows(products: DataFrame, items: DataFrame, iterations: DataFrame, group_id: int,
              clusters=None, **choice) -> DataFrame:
    """Filtered products with newest item and run; clusters compare with the newest label."""
    chosen = products.filter(grid_filter(group_id, **choice))
    rows = latest_rows(chosen, items, iterations)
    wanted = cluster_choice(clusters, "cluster")
    return rows if wanted is None else rows.filter(wanted)


def main_page(products: DataFrame, items: DataFrame, iterations: DataFrame, group_id: int,
              number: int, size: int, column: str | None = None, direction: str = "asc", **choice
              ) -> DataFrame:
    """A page of products with status words and their correction history."""
    rows = page(main_rows(products, items, iterations, group_id, **choice), number, size, column,
                direction)
    lists = history_lists(history(items, iterations, rows.select("system_product_id")))
    return displayed(rows.join(lists, "system_product_id", "left"))


# Export columns and their titles, in file order.
EXPORT_COLUMNS = {
    "system_product_id": "Product ID", "qb_code": "QB Code", "brand": "Brand",
    "category": "Category", "product_type": "Product Type", "name": "Name", "height": "Height",
    "width": "Width", "depth": "Depth", "eps": "EPS", "sample": "Sample",
    "final_status": "Final Status", "total_items": "Total Items",
    "analyzed_items": "Analyzed Items", "pending_items": "Pending Items",
    "outlier_items": "Outlier Items", "cluster_items": "Cluster Items",
    "cluster_items_per": "Cluster Items (%)", "cluster": "Cluster", "skip_status": "Skip Status",
    "history": "Final Status History",
}


def export_rows(products: DataFrame, items: DataFrame, iterations: DataFrame, group_id: int,
                **choice) -> DataFrame:
    """The whole selection with display texts, in export column order; no paging."""
    rows = main_rows(products, items, iterations, group_id, **choice)
    lists = history_lists(history(items, iterations, rows.select("system_product_id")))
    shown = displayed(rows.join(lists, "system_product_id", "left"))
    shown = shown.withColumns({
        "skip_status": skip_text(F.col("skip_status")),
        "history": F.coalesce(history_text(F.col("history")), F.lit("")),
        "cluster_items_per": F.format_string("%.2f%%", F.col("cluster_items_per")),
    })
    return shown.select(*[F.col(c).alias(t) for c, t in EXPORT_COLUMNS.items()
                          if c in shown.columns])


def highlight_flags(rows: DataFrame) -> DataFrame:
    """Dimension cells to mark in an export."""
    return rows.withColumns({f"{d}_marked": F.coalesce(F.col(f"iqr_{d}_status") == 0,
                                                       F.lit(False))
                             for d in ("height", "width", "depth")})


def matching_page(rows: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Matching products, newest id first."""
    ordered = rows.orderBy(F.col("product_id").desc())
    return ordered.offset(offset).limit(limit) if limit else ordered


def client_page(rows: DataFrame, column: str, direction: str, number: int, size: int,
                ties: Sequence[str] = ("product_id",)) -> DataFrame:
    """Case-insensitive sort and page slice."""
    c = F.lower(F.col(column).cast("string")) if dict(rows.dtypes)[column] == "string" \
        else F.col(column)
    order = c.desc_nulls_last() if direction == "desc" else c.asc_nulls_first()
    return rows.orderBy(order, *ties).offset((number - 1) * size).limit(size)
