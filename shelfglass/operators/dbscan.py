"""Density clustering (DBSCAN, Euclidean) as DataFrame joins over a grid.

Rules: neighbours lie within ``eps``, self included; a point with at least ``min_samples``
neighbours is core; clusters are the connected components of core points, numbered by their
first core point in row order; a border point takes the lowest numbered neighbouring cluster;
the rest is noise (-1).

How it stays far from quadratic:

* copies of a point are one weighted point;
* the cells have diagonal <= eps, so a cell with ``min_samples`` rows is all core and all of one
  cluster without a single distance;
* cells meet by a descent over pairs of boxes: cells are united into ever larger boxes by halving
  their coordinates, the few boxes of the coarsest level meet each other, and a pair of boxes hands
  down to the pairs of its halves only while its tight boxes come within eps. The pairs formed
  therefore grow with the pairs within reach, whatever the number of features;
* each cell pair is first decided by its two tight boxes (farther than eps: nothing, wholly within
  eps: everything); what the boxes leave open is compared point by point only for small cells.
  Large cells are halved along every feature, again and again, until boxes decide or few points
  remain; every comparison is therefore bounded by ``leaf`` and none is skipped;
* all settings of one eps share their cells, pairs and neighbourhood counts: a point's level is the
  number of its ``min_samples`` values that the count reaches, two cells touch up to the highest
  level of close points, and lower levels only add core points and edges.

All groups and all parameter settings run in the same jobs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from shelfglass.operators.components import component_labels
from shelfglass.operators.joins import null_safe_join
from shelfglass.operators.numbering import id_bucket, running_number
from shelfglass.operators.outliers import standardized
from shelfglass.staging import parallelism, stage

# Feature groups and the constant that keeps ratios finite.
FEATURE_GROUPS = ("size", "shape", "volume")
RATIO_EPSILON = 1e-6

LEAF = 64
# Halvings after which what is left is compared point by point, however many points there are. Parts
# are then smaller than 2^-48 of a cell, so boxes leave only points open whose distance from eps is
# of the size of rounding errors; nothing is left out.
_MAX_LEVEL = 48

# Pairs of boxes at the start of the descent, for every cell.
_START_PAIRS = 32

# A clustering run is one group (g, the row order of its first row) under one eps (k), for all
# ``min_samples`` that go with it (needs, ascending). Cells, boxes and parts are named by the row
# order of their first point, so all joins are on integers.
RUN = ["g", "k"]


def chosen_settings(settings: Sequence[str] | None) -> list[str]:
    """Known feature groups among the requested ones; none known means all."""
    wanted = {str(s).strip().lower() for s in settings or []}
    return [s for s in FEATURE_GROUPS if s in wanted] or list(FEATURE_GROUPS)


def add_features(df: DataFrame, settings: Sequence[str] | None = None,
                 dims: Sequence[str] = ("height", "width", "depth")) -> tuple[DataFrame, list[str]]:
    """Adds the feature columns of the chosen groups; returns the frame and their names."""
    h, w, d = (F.col(c) for c in dims)
    groups = {
        "size": {"f_h": h, "f_w": w, "f_d": d},
        "shape": {"f_hw": h / (w + RATIO_EPSILON), "f_wd": w / (d + RATIO_EPSILON),
                  "f_hd": h / (d + RATIO_EPSILON)},
        "volume": {"f_volume": h * w * d},
    }
    features = {k: v for s in chosen_settings(settings) for k, v in groups[s].items()}
    return df.withColumns(features), list(features)


# --- geometry as SQL text over flat columns ----------------------------------------------------

def _distance2(a: str, b: str, d: int) -> str:
    return " + ".join(f"power({a}{i} - {b}{i}, 2)" for i in range(d))


def _near2(alo: str, ahi: str, blo: str, bhi: str, d: int) -> str:
    """Least squared distance of two boxes."""
    return " + ".join(
        f"power(greatest(0D, {blo}{i} - {ahi}{i}, {alo}{i} - {bhi}{i}), 2)" for i in range(d))


def _far2(alo: str, ahi: str, blo: str, bhi: str, d: int) -> str:
    """Greatest squared distance of two boxes."""
    return " + ".join(
        f"power(greatest({bhi}{i} - {alo}{i}, {ahi}{i} - {blo}{i}), 2)" for i in range(d))


def _within_reach(frame: DataFrame, sides: tuple[str, str, str, str], d: int, *spread: str
                  ) -> DataFrame:
    """Rows whose boxes come within eps, with the flag ``full``: wholly within eps.

    The rows are redistributed between the two tests: they are few but costly from here on, and
    each test alone stays small enough for the JIT compiler.
    """
    reach = frame.filter(f"{_near2(*sides, d)} <= eps * eps")
    return reach.repartition(parallelism(frame.sparkSession), *RUN, *spread).withColumn(
        "full", F.expr(f"{_far2(*sides, d)} <= eps * eps"))


def _decide(frame: DataFrame, sides: tuple[str, str, str, str], d: int, *spread: str
            ) -> tuple[DataFrame, DataFrame]:
    """Rows whose boxes lie wholly within eps, and rows the boxes leave open; the rest is gone."""
    reach = _within_reach(frame, sides, d, *spread)
    return reach.filter("full").drop("full"), reach.filter("NOT full").drop("full")


def _flat(prefix: str, d: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(d)]


def _bounds(d: int) -> list[str]:
    return [*_flat("lo", d), *_flat("hi", d)]


def _summary(d: int, combine) -> list[Column]:
    """Name, value, size and tight box of a set of points; a value is a weight (sum) or level (max)."""
    return [F.min("first").alias("node"), combine("v").alias("v"), F.count(F.lit(1)).alias("m"),
            *[F.min(f"z{i}").alias(f"lo{i}") for i in range(d)],
            *[F.max(f"z{i}").alias(f"hi{i}") for i in range(d)]]


def _cell_at(level: int, d: int) -> Column:
    """Grid cell of a point; every level halves the side. The side is a touch below eps/√d."""
    scale = math.sqrt(d) / (1 - 1e-9) * 2.0**level
    return F.expr("array(" + ", ".join(
        f"cast(floor(z{i} * ({scale!r}D / eps)) AS bigint)" for i in range(d)) + ")")


def _counted_stage(df: DataFrame, label: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """Stage a frame and read a few figures from the written table."""
    table = stage(df, label)
    return table, table.agg(*[c.alias(k) for k, c in metrics.items()]).first().asDict()


def _split(points: DataFrame, parents: DataFrame, level: int, d: int, combine
           ) -> tuple[DataFrame, DataFrame]:
    """Parts of the given nodes one level down, and their points under the new node names.

    points: g, k, eps, node, first, v, z*. Parts carry their parent's name.
    """
    kept = points.join(parents, [*RUN, "node"], "left_semi").withColumnRenamed(
        "node", "parent").withColumn("part", _cell_at(level, d))
    parts = stage(kept.groupBy(*RUN, "parent", "part").agg(*_summary(d, combine)), "parts")
    moved = kept.join(parts.select(*RUN, "parent", "part", "node"), [*RUN, "parent", "part"])
    return parts.drop("part"), stage(moved.drop("parent", "part"), "moved")


# --- points against cells --------------------------------------------------------------------

def _within(asked: DataFrame, points: DataFrame, d: int, leaf: int, largest: int, combine
            ) -> DataFrame:
    """The combined value of the points of cell ``t`` within eps of each asking point.

    asked: g, k, eps, first, z* and the target cell: t, v, m, lo*, hi*. points: g, k, eps, node
    (the cell), first, v, z*. Returns g, k, first, t, v for the pairs with a point within eps.
    """
    sides, z = ("z", "z", "lo", "hi"), _flat("z", d)

    def inside(sure: DataFrame) -> DataFrame:
        return sure.select(*RUN, "first", "t", "v")

    def compare(rows: DataFrame, among: DataFrame) -> DataFrame:
        other = among.select(*RUN, "node", "v", *[F.col(c).alias(f"q{c[1:]}") for c in z])
        near = rows.select(*RUN, "eps", "first", "t", "node", *z).join(other, [*RUN, "node"])
        return near.filter(f"{_distance2('z', 'q', d)} <= eps * eps").select(
            *RUN, "first", "t", "v")

    sure, undecided = _decide(asked.withColumn("node", F.col("t")), sides, d, "first")
    found = [inside(sure)]
    if largest <= leaf:
        found.append(compare(undecided, points))
    else:
        found.append(compare(undecided.filter(F.col("m") <= leaf), points))
        rest, seen = _counted_stage(
            undecided.filter(F.col("m") > leaf), "asked", n=F.count(F.lit(1)))
        level = 1
        while seen["n"]:
            parts, points = _split(points, rest.select(*RUN, "node"), level, d, combine)
            step = rest.select(*RUN, "eps", "first", "t", *z, F.col("node").alias("parent")).join(
                parts, [*RUN, "parent"]).drop("parent")
            sure, undecided = _decide(step, sides, d, "first")
            few = (F.col("m") <= leaf) if level < _MAX_LEVEL else F.lit(True)
            found += [inside(sure), compare(undecided.filter(few), points)]
            rest, seen = _counted_stage(undecided.filter(~few), "asked", n=F.count(F.lit(1)))
            level += 1
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy(*RUN, "first", "t").agg(combine("v").alias("v"))


# --- cells against cells ---------------------------------------------------------------------

def _boxes(cells: DataFrame, d: int) -> tuple[DataFrame, int]:
    """All levels of boxes over the cells (g, k, lev, node, parent, lo*, hi*), and the level at
    which the descent starts: the finest at which all pairs of boxes are not many times the cells.

    A level unites the cells whose coordinates agree after so many halvings, down to a box on each
    side of zero in every feature. A box is named by its least cell, so its parent is named by the
    least of the boxes in it.
    """
    far = [F.abs(F.col("cell")[i]) for i in range(d)]
    high, n = cells.agg(F.max(F.greatest(*far, F.lit(0))), F.count(F.lit(1))).first()
    top = int(high + 1).bit_length()

    def halved(by: str) -> Column:
        return F.expr("array(" + ", ".join(f"shiftright(cell[{i}], {by})" for i in range(d)) + ")")

    every = cells.select(*RUN, "node", *_bounds(d), "cell", F.explode(
        F.sequence(F.lit(0), F.lit(top))).alias("lev")).withColumn("cell", halved("lev"))
    boxes = every.groupBy(*RUN, "lev", "cell").agg(
        F.min("node").alias("node"), *[F.min(f"lo{i}").alias(f"lo{i}") for i in range(d)],
        *[F.max(f"hi{i}").alias(f"hi{i}") for i in range(d)])
    siblings = Window.partitionBy(*RUN, "lev", "up")  # at most 2 ** d boxes
    tree = stage(boxes.withColumn("up", halved("1")).withColumn(
        "parent", F.min("node").over(siblings)).drop("up", "cell"), "boxes")
    per_run = tree.groupBy(*RUN, "lev").count().groupBy("lev").agg(
        F.sum(F.col("count") * F.col("count"))).collect()
    start = min([lev for lev, pairs in per_run if pairs <= _START_PAIRS * n], default=top)
    return tree, start


def cell_pairs(cells: DataFrame, d: int, formed: list[int] | None = None) -> DataFrame:
    """Pairs (g, k, eps, a_node < b_node, full) of cells whose boxes come within eps.

    cells: g, k, eps, node, cell, lo*, hi*. ``formed``, if given, takes the number of pairs that
    each level looked at.
    """
    sides = ("a_lo", "a_hi", "b_lo", "b_hi")
    tree, start = _boxes(cells, d)
    eps = cells.select(*RUN, "eps").distinct()

    def side(lev: int, s: str, *names: str) -> DataFrame:
        return tree.filter(F.col("lev") == lev).select(
            *RUN, *[F.col(c).alias(f"{s}_{c}") for c in ("node", *names, *_bounds(d))])

    pairs = None
    for lev in range(start, -1, -1):
        if pairs is None:
            meeting = eps.join(side(lev, "a"), RUN).join(side(lev, "b"), RUN).filter(
                "a_node <= b_node")
        else:
            meeting = (
                pairs.join(side(lev, "a", "parent"), [*RUN, "a_parent"])
                .join(side(lev, "b", "parent"), [*RUN, "b_parent"])
                .filter("a_parent <> b_parent OR a_node <= b_node"))
        seen = Observation()
        reach = _within_reach(meeting.observe(seen, F.count(F.lit(1)).alias("formed")), sides, d,
                              "a_node", "b_node")
        if lev:
            pairs = stage(reach.select(*RUN, "eps", F.col("a_node").alias("a_parent"),
                                       F.col("b_node").alias("b_parent")), "boxpairs")
        else:
            pairs = stage(reach.filter("a_node <> b_node").select(
                *RUN, "eps", F.least("a_node", "b_node").alias("a_node"),
                F.greatest("a_node", "b_node").alias("b_node"), "full"), "pairs")
        if formed is not None:
            formed.append(seen.get["formed"])
    return pairs


def _touching(pairs: DataFrame, points: DataFrame, d: int, leaf: int, largest: int) -> DataFrame:
    """Edges (g, k, u, v, level) between core cells that have core points within eps of each other:
    the highest level at which such a pair of points is core.

    pairs: g, k, eps, u, v, a, b (the parts compared, first the cells themselves) and for both
    sides m, v (the highest level in it), lo*, hi*. points: the core points with their core cell as
    node and their level as v.
    """
    sides, edge = ("a_lo", "a_hi", "b_lo", "b_hi"), [*RUN, "u", "v"]
    most = F.least("a_v", "b_v").alias("level")

    def compare(rows: DataFrame, among: DataFrame) -> DataFrame:
        a, b = [
            among.select(*RUN, F.col("node").alias(s), F.col("v").alias(f"{s}_v"),
                         *[F.col(f"z{i}").alias(f"{s}{i}") for i in range(d)]) for s in "ab"]
        both = rows.select(*edge, "eps", "a", "b").join(a, [*RUN, "a"]).join(b, [*RUN, "b"])
        return both.filter(f"{_distance2('a', 'b', d)} <= eps * eps").select(*edge, most)

    few = F.col("a_m") * F.col("b_m") <= leaf * leaf
    sure, undecided = _decide(pairs, sides, d, "u", "v")
    found = [sure.select(*edge, most)]
    if largest <= leaf:
        found.append(compare(undecided, points))
    else:
        found.append(compare(undecided.filter(few), points))
        rest, seen = _counted_stage(undecided.filter(~few), "cellpairs", n=F.count(F.lit(1)))
        level = 1
        while seen["n"]:
            parents = rest.select(*RUN, F.col("a").alias("node")).unionByName(
                rest.select(*RUN, F.col("b").alias("node")))
            parts, points = _split(points, parents, level, d, F.max)
            step = rest.select(*edge, "eps", "a", "b")
            for s in "ab":
                part = parts.select(*RUN, F.col("parent").alias(s), F.col("node").alias("_node"),
                                    *[F.col(c).alias(f"{s}_{c}") for c in ("m", "v", *_bounds(d))])
                step = step.join(part, [*RUN, s]).drop(s).withColumnRenamed("_node", s)
            sure, undecided = _decide(step, sides, d, "u", "v")
            sure = stage(sure.groupBy(*edge).agg(F.max(most).alias("level")), "touch")
            # What touching parts have settled needs no pair of parts of no higher level.
            settled = sure.withColumnRenamed("level", "_settled")
            undecided = undecided.join(settled, edge, "left").filter(
                F.col("_settled").isNull() | (F.col("_settled") < most)).drop("_settled")
            enough = few if level < _MAX_LEVEL else F.lit(True)
            found += [sure, compare(undecided.filter(enough), points)]
            rest, seen = _counted_stage(undecided.filter(~enough), "cellpairs", n=F.count(F.lit(1)))
            level += 1
    return reduce(DataFrame.unionByName, found).groupBy(*edge).agg(F.max("level").alias("level"))


# --- the clustering --------------------------------------------------------------------------

def _levels(level: Column, name: str = "i") -> Column:
    """One row for every level up to this one; level 0 has none."""
    return F.explode(F.slice(F.sequence(F.lit(0), level), F.lit(2), level)).alias(name)


def cluster_labels(points: DataFrame, d: int, leaf: int = LEAF) -> DataFrame:
    """Points (g, k, eps, needs, first, w, z0..) to (g, k, need, first, label).

    ``w`` is the number of copies and ``first`` the row order of the first copy, unique in a run;
    ``needs`` holds the run's values of ``min_samples`` in ascending order. ``label`` is the first
    core point of the cluster under ``need``; noise is absent.
    """
    z = _flat("z", d)
    runs = points.select(*RUN, "eps", "needs").distinct()
    gridded = points.drop("needs").withColumnRenamed("w", "v").withColumn("cell", _cell_at(0, d))
    cells, size = _counted_stage(gridded.groupBy(*RUN, "eps", "cell").agg(*_summary(d, F.sum)),
                                 "cells", largest=F.max("m"))
    if not size["largest"]:
        return points.select(*RUN, F.lit(0).alias("need"), "first", F.col("first").alias("label"))
    pts = stage(gridded.join(cells.select(*RUN, "cell", "node"), [*RUN, "cell"]).drop("cell"),
                "points")
    pairs = cell_pairs(cells, d)
    # Level i is reached with needs[i - 1] points; a higher level needs more.
    limits = runs.select(*RUN, "needs", F.array_max("needs").alias("_most"),
                         F.array_min("needs").alias("_least"))
    weights = cells.select(*RUN, "node", F.col("v").alias("n"))
    near = reduce(DataFrame.unionByName, [
        pairs.select(*RUN, "full", F.col(f"{s}_node").alias("node"), F.col(f"{t}_node").alias("t"))
        for s, t in (("a", "b"), ("b", "a"))
    ])

    # Cells settled without distances: all core at every level, or too few rows in reach for any.
    sums = near.join(weights.select(*RUN, F.col("node").alias("t"), "n"), [*RUN, "t"]).groupBy(
        *RUN, "node").agg(F.sum(F.when(F.col("full"), F.col("n")).otherwise(0)).alias("_sure"),
                          F.sum("n").alias("_reach"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    kinds = stage(
        weights.join(sums, [*RUN, "node"], "left").join(limits, RUN).select(
            *RUN, "node", "needs", (F.col("n") + zero("_sure")).alias("sure"),
            F.when(F.col("n") + zero("_sure") >= F.col("_most"), "all")
            .when(F.col("n") + zero("_reach") < F.col("_least"), "none").otherwise("some")
            .alias("kind")),
        "kinds")
    kinded = pts.join(kinds, [*RUN, "node"])
    asked = (
        kinded.filter("kind = 'some'").select(*RUN, "eps", "first", *z, "node")
        .join(near.filter(~F.col("full")).select(*RUN, "node", "t"), [*RUN, "node"]).drop("node")
        .join(cells.select(*RUN, F.col("node").alias("t"), "v", "m", *_bounds(d)), [*RUN, "t"])
    )
    hits = _within(asked, pts, d, leaf, size["largest"], F.sum).groupBy(*RUN, "first").agg(
        F.sum("v").alias("_hits"))
    around = F.col("sure") + F.when(F.col("kind") == "some", zero("_hits")).otherwise(0)
    level = F.size(F.filter("needs", lambda m: m <= F.col("_around")))
    judged = stage(
        kinded.drop("v").join(hits, [*RUN, "first"], "left").withColumn("_around", around).select(
            *RUN, "eps", "first", *z, "node", "needs", level.alias("v")), "judged")

    # Core cells are the nodes of the graph; an edge is there up to its level.
    core_pts = judged.filter("v > 0").drop("needs")
    core_cells, core_size = _counted_stage(
        core_pts.withColumnRenamed("node", "cell").groupBy(*RUN, "eps", "cell").agg(
            *_summary(d, F.max)), "corecells", largest=F.max("m"))
    core_cells, largest = core_cells.drop("node"), core_size["largest"] or 0
    linked = pairs.select(*RUN, "eps", F.col("a_node").alias("u"), F.col("b_node").alias("v"))
    for s, node in (("a", "u"), ("b", "v")):
        linked = linked.join(
            core_cells.select(*RUN, F.col("cell").alias(node), *[
                F.col(c).alias(f"{s}_{c}") for c in ("m", "v", *_bounds(d))]), [*RUN, node])
    linked = linked.withColumns({"a": F.col("u"), "b": F.col("v")})
    edges = _touching(linked, core_pts, d, leaf, largest)
    at_level = [*RUN, "i"]
    components = component_labels(edges.select(*RUN, "u", "v", _levels(F.col("level"))), at_level)
    firsts = core_pts.select(*RUN, "first", "node", _levels(F.col("v"))).groupBy(
        *at_level, "node").agg(F.min("first").alias("label"))
    owned = firsts.join(components.withColumnRenamed("label", "whole"), [*at_level, "node"],
                        "left").withColumn("whole", F.coalesce("whole", "node"))
    least = owned.groupBy(*at_level, "whole").agg(F.min("label").alias("label"))
    named = stage(owned.drop("label").join(least, [*at_level, "whole"]).select(
        *at_level, F.col("node").alias("t"), "label"), "named")

    # Border points of a level: lowest label among the cells with a core point within eps.
    reachable = near.select(*RUN, "node", "t").unionByName(
        weights.select(*RUN, "node", F.col("node").alias("t")))
    targets = core_cells.select(*RUN, F.col("cell").alias("t"), "v", "m", *_bounds(d))
    levels = F.size("needs")
    asking = (
        judged.withColumnRenamed("v", "own").filter(F.col("own") < levels)
        .select(*RUN, "eps", "first", *z, "node", "own").join(reachable, [*RUN, "node"])
        .drop("node").join(targets, [*RUN, "t"]).filter("v > own")
    )
    own = judged.select(*RUN, "first", F.col("v").alias("own"))
    close = _within(asking.drop("own"), core_pts, d, leaf, largest, F.max).join(
        own, [*RUN, "first"]).select(*RUN, "first", "t", "own", _levels(F.col("v"))).filter("i > own")
    border = close.join(named, [*at_level, "t"]).groupBy(*at_level, "first").agg(
        F.min("label").alias("label"))
    inner = core_pts.select(*RUN, "first", F.col("node").alias("t"), _levels(F.col("v"))).join(
        named, [*at_level, "t"]).select(*at_level, "first", "label")
    need = F.element_at("needs", F.col("i").cast("int"))
    return inner.unionByName(border).join(runs.select(*RUN, "needs"), RUN).select(
        *RUN, need.alias("need"), "first", "label")


def clustered_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    configs: Sequence[tuple[float, int]] = ((1.0, 4),),
    settings: Sequence[str] | None = None,
    dims: Sequence[str] = ("height", "width", "depth"),
    drop_nonpositive: bool = True,
    min_rows_from_config: bool = False,
    leaf: int = LEAF,
    sizes: bool = False,
) -> tuple[DataFrame, Callable[[float, int], Column], DataFrame | None]:
    """Rows of each group with the map ``_clusters`` of their clusters under all settings, see
    ``dbscan``, and a function that gives the entry of a setting: cluster and, with ``sizes``, the
    rows of the cluster (items) and of the run (rows); NULL where a row takes no part. With
    ``sizes`` also a table of the noise of each group: keys, ``_noise`` (a map like ``_clusters``).

    Sizes are counted over weighted points, so no row is repeated for a setting here. ``df`` is read
    several times and should be cheap to read, for example staged.
    """
    spark = df.sparkSession
    keys, dims = list(keys), list(dims)
    usable = df.na.drop(subset=dims)
    if drop_nonpositive:
        usable = usable.filter(reduce(lambda a, b: a & b, [F.col(c) > 0 for c in dims]))
    rows = usable.select(*keys, F.col(order).cast("bigint").alias("_order"),
                         *[F.col(c).cast("double").alias(c) for c in dims])
    featured, names = add_features(rows, settings, dims)
    scaled = standardized(featured, keys, names)
    z = _flat("z", len(names))
    weighted = stage(
        scaled.groupBy(*keys, *dims).agg(
            F.count(F.lit(1)).alias("w"), F.min("_order").alias("first"),
            *[F.first(f"z_{c}").alias(z[i]) for i, c in enumerate(names)]),
        "scaled")
    configs = [(float(e), int(m)) for e, m in configs]
    every_eps = sorted({e for e, _ in configs})
    grid = spark.createDataFrame(
        [(k, e, sorted({m for x, m in configs if x == e})) for k, e in enumerate(every_eps)],
        "k int, eps double, needs array<int>")
    groups = weighted.groupBy(*keys).agg(F.min("first").alias("g"), F.sum("w").alias("_rows"))
    runs = groups.crossJoin(grid)  # groups x the handful of eps
    if min_rows_from_config:
        runs = runs.withColumn("needs", F.filter("needs", lambda m: m <= F.col("_rows"))).filter(
            F.size("needs") > 0)
    runs = runs.drop("_rows")
    in_runs = null_safe_join(weighted, runs, keys)
    labels = stage(cluster_labels(
        in_runs.select(*RUN, "eps", "needs", "first", "w", *z), len(names), leaf), "labels")
    per_need = [*RUN, "need"]
    numbers = running_number(
        labels.select(*per_need, "label").distinct(), per_need, "label", id_bucket("label"), "_number")
    numbered = labels.join(numbers, [*per_need, "label"]).select(
        *per_need, "first", (F.col("_number") - 1).cast("int").alias("cluster"))
    # One entry per setting and point: rows are joined once, then repeated per setting.
    value, noise = ["cluster"], None
    placed = in_runs.select(*keys, *dims, *RUN, "first", "w", F.explode("needs").alias("need")).join(
        numbered, [*per_need, "first"], "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))
    if sizes:
        per_cluster = placed.groupBy(*per_need, "cluster").agg(F.sum("w").alias("items"))
        totals = per_cluster.groupBy(*per_need).agg(F.sum("items").alias("rows"), F.sum(
            F.when(F.col("cluster") == -1, F.col("items")).otherwise(0)).alias("noise"))
        figures = per_cluster.join(totals.select(*per_need, "rows"), per_need)
        placed = placed.join(figures, [*per_need, "cluster"])
        value = ["cluster", "items", "rows"]
        noise = totals.groupBy("g").agg(F.map_from_entries(F.collect_list(
            F.struct(F.struct("k", "need"), "noise"))).alias("_noise")).join(
            groups.select(*keys, "g"), "g").drop("g")
    entry = F.struct(F.struct("k", "need"), F.struct(*value).alias("value"))
    found = placed.groupBy(*keys, *dims).agg(
        F.map_from_entries(F.collect_list(entry)).alias("_clusters"))
    found = found.select(*[F.col(c).alias(f"_{c}") for c in [*keys, *dims]], "_clusters")
    on = [*[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys],
          *[F.col(c).cast("double") == F.col(f"_{c}") for c in dims]]

    def entry_of(eps: float, need: int, column: str = "_clusters") -> Column:
        run = F.struct(F.lit(every_eps.index(float(eps))).alias("k"), F.lit(int(need)).alias("need"))
        return F.try_element_at(column, run)

    return df.join(found, on, "left").select(*df.columns, "_clusters"), entry_of, noise


def dbscan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    configs: Sequence[tuple[float, int]] = ((1.0, 4),),
    settings: Sequence[str] | None = None,
    dims: Sequence[str] = ("height", "width", "depth"),
    drop_nonpositive: bool = True,
    min_rows_from_config: bool = False,
    leaf: int = LEAF,
) -> DataFrame:
    """Rows of each group clustered under every (eps, min_samples) setting.

    Returns the input rows once per setting with ``eps``, ``min_samples`` and ``cluster`` (-1 =
    noise). ``cluster`` is NULL for rows that take no part: a NULL dimension, a non-positive one
    when these are dropped, or, with ``min_rows_from_config``, a group with fewer usable rows than
    ``min_samples``. NULL is a group key like any other; ``order`` is a bigint row order, unique in
    df. The input is staged, since moments, points and rows are read from it in turn.
    """
    configs = [(float(e), int(m)) for e, m in configs]
    rows, entry_of, _ = clustered_rows(stage(df, "rows"), keys, order, configs, settings, dims,
                                       drop_nonpositive, min_rows_from_config, leaf)
    runs = F.explode(F.array(*[
        F.struct(F.lit(e).alias("eps"), F.lit(m).alias("min_samples"),
                 entry_of(e, m)["cluster"].alias("cluster")) for e, m in configs]))
    return rows.select(*df.columns, runs.alias("_s")).select(*df.columns, "_s.*")
