"""Exact group quantiles without gathering a group in one task.

Values are first counted per (group, column, value) with map-side combine. A monotone band of the
value splits each group; band totals give the rank range of every band, and only the bands that
hold a wanted rank are ordered value by value. A band of more than ``MOST_VALUES`` distinct values is
split at approximate quantiles of its own values first, and so are its parts, round by round, until
those that hold a wanted rank are small. A window therefore sees the band totals of one group (their
number depends on the value range, not on the rows), the parts of one band, or at most
``MOST_VALUES`` distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfglass.operators.joins import null_safe_join
from shelfglass.staging import stage

# Bands per factor e of the value: neighbouring bands differ by about 0.4 percent.
BANDS_PER_E = 256
#: Distinct values that one window orders, and the parts of a band that holds more.
MOST_VALUES, PARTS = 50_000, 256


def _band(v: Column) -> Column:
    return (F.signum(v) * F.floor(F.log1p(F.abs(v)) * BANDS_PER_E)).cast("bigint")


def _split(counted: DataFrame, crowded: DataFrame, group: list[str], wanted: Column
           ) -> tuple[DataFrame, DataFrame]:
    """The values of crowded bands under the names of their parts, and the parts with a wanted rank.

    Parts end at approximate quantiles of the band's distinct values, so each holds about its share
    of them, however the values lie; the last value of a part is one of the values.
    """
    band = [*group, "_band"]
    inside = stage(null_safe_join(counted, crowded.select(*band), band), "crowded")
    cuts = inside.groupBy(*band).agg(F.percentile_approx(
        "_v", [i / PARTS for i in range(1, PARTS)], PARTS * 16).alias("_cuts"))
    part = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    parts = stage(null_safe_join(inside, cuts, band).withColumn(
        "_part", part.cast("bigint")).drop("_cuts"), "parts")
    totals = parts.groupBy(*band, "_part").agg(
        F.sum("_c").alias("_bc"), F.count(F.lit(1)).alias("_values"))
    before = Window.partitionBy(*band).orderBy("_part")
    ranked = null_safe_join(totals, crowded.drop("_values"), band).withColumn(
        "_end", F.col("_start") + F.sum("_bc").over(before)).withColumn(
        "_start", F.col("_end") - F.col("_bc"))
    name = F.concat("_band", F.array("_part"))
    return (parts.withColumn("_band", name).drop("_part"), stage(
        ranked.filter(wanted).withColumn("_band", name).select(
            *band, "_start", "_values", "_n", "_min", "_max"), "bands"))


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    probabilities: Sequence[float] = (0.25, 0.75),
    names: Sequence[str] = ("q1", "q3"),
    most: int = MOST_VALUES,
) -> DataFrame:
    """Per key group: ``n`` rows and, per column, linearly interpolated quantiles, min and max.

    Keys may be NULL (a group of its own); rows with a NULL or an infinity in any column are left
    out. ``most`` bounds the distinct values that are ordered in one place.
    """
    keys, columns = list(keys), list(columns)
    present = df.na.drop(subset=columns)
    for c in columns:
        present = present.filter(F.abs(F.col(c).cast("double")) < float("inf"))
    values = present.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("_col"), F.col(c).cast("double").alias("_v"))
                      for i, c in enumerate(columns)])
        ).alias("_e"),
    ).select(*keys, "_e._col", "_e._v")
    group = [*keys, "_col"]
    counted = stage(
        values.groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_band", F.array(_band(F.col("_v")))), "values")
    bands = counted.groupBy(*group, "_band").agg(
        F.sum("_c").alias("_bc"), F.count(F.lit(1)).alias("_values"), F.min("_v").alias("_lo"),
        F.max("_v").alias("_hi")
    )
    ordered = Window.partitionBy(*group).orderBy("_band")
    whole = Window.partitionBy(*group)
    ranked = (
        bands.withColumn("_end", F.sum("_bc").over(ordered))
        .withColumn("_n", F.sum("_bc").over(whole))
        .withColumn("_min", F.min("_lo").over(whole))
        .withColumn("_max", F.max("_hi").over(whole))
        .withColumn("_start", F.col("_end") - F.col("_bc"))
    )

    def holds(rank: Column, start: Column, end: Column) -> Column:
        return (start <= rank) & (rank < end)

    def rank_range(p: float) -> tuple[Column, Column]:
        position = F.lit(float(p)) * (F.col("_n") - 1)
        return F.floor(position), F.ceil(position)

    wanted = F.lit(False)
    for p in probabilities:
        low, high = rank_range(p)
        for rank in (low, high):
            wanted = wanted | holds(rank, F.col("_start"), F.col("_end"))
    targets = stage(ranked.filter(wanted).select(
        *group, "_band", "_start", "_values", "_n", "_min", "_max"), "bands")

    placed = []
    while True:
        small = null_safe_join(counted, targets.filter(F.col("_values") <= most), [*group, "_band"])
        in_band = Window.partitionBy(*group, "_band").orderBy("_v")
        placed.append(small.withColumn("_to", F.col("_start") + F.sum("_c").over(in_band)))
        crowded = targets.filter(F.col("_values") > most)
        if crowded.isEmpty():
            break
        counted, targets = _split(counted, crowded, group, wanted)
    placed = reduce(DataFrame.unionByName, placed).withColumn("_from", F.col("_to") - F.col("_c"))
    aggregates = [F.max("_n").alias("n")]
    for i, c in enumerate(columns):
        here = F.col("_col") == i
        aggregates += [F.max(F.when(here, F.col("_min"))).alias(f"{c}_min"),
                       F.max(F.when(here, F.col("_max"))).alias(f"{c}_max")]
        for p, name in zip(probabilities, names, strict=True):
            low, high = rank_range(p)
            for side, rank in (("lo", low), ("hi", high)):
                hit = here & holds(rank, F.col("_from"), F.col("_to"))
                aggregates.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{c}_{name}_{side}"))
    picked = placed.groupBy(*keys).agg(*aggregates)

    out = [*keys, "n"]
    for c in columns:
        for p, name in zip(probabilities, names, strict=True):
            position = F.lit(float(p)) * (F.col("n") - 1)
            low, high = F.col(f"_{c}_{name}_lo"), F.col(f"_{c}_{name}_hi")
            out.append((low + (high - low) * (position - F.floor(position))).alias(f"{c}_{name}"))
        out += [f"{c}_min", f"{c}_max"]
    return picked.select(*out)
