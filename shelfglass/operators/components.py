"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregates and joins over the edges, written as one table. Hubs are never
gathered: the minimum neighbour is an aggregate, and the edges are rewired by a join that AQE may
split on skew. The rounds end when one leaves the edges as they were, which their number and the
sum of their hashes tell, taken while the table is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from shelfglass.staging import stage


def _rewire(edges: DataFrame, run: list[str], large: bool) -> DataFrame:
    """One star round on edges (run, u, v) with u > v."""
    both = edges
    if large:
        both = edges.unionByName(edges.select(*run, F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(*run, "u").agg(F.min("v").alias("_least")).withColumn(
        "_least", F.least("_least", "u"))
    joined = both.join(least, [*run, "u"])
    if large:
        joined = joined.filter("v > u")
    moved = joined.select(*run, F.col("v").alias("u"), F.col("_least").alias("v"))
    if not large:
        moved = moved.unionByName(least.select(*run, "u", F.col("_least").alias("v")))
    return moved.filter("u > v").distinct()


def component_labels(edges: DataFrame, run: list[str]) -> DataFrame:
    """Edges (run, u, v) to (run, node, label): the least node of each node's component.

    Nodes without an edge do not appear.
    """
    def kept(frame: DataFrame) -> tuple[DataFrame, dict]:
        seen = Observation()
        mark = F.xxhash64(*run, "u", "v").cast("decimal(38,0)")
        table = stage(frame.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(mark).alias("sum")),
                      "edges")
        return table, seen.get

    current, before = kept(
        edges.select(*run, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .filter("u > v").distinct())
    # Only a forest of stars stays as it is; rounds keep components connected.
    while before["n"]:
        current, now = kept(_rewire(_rewire(current, run, True), run, False))
        if now == before:
            break
        before = now
    members = current.select(*run, F.col("u").alias("node"), F.col("v").alias("label"))
    roots = current.select(*run, F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return members.unionByName(roots)
