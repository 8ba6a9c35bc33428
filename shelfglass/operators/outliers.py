"""Interquartile fences per group, flags and summary figures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfglass.functions.display import percent, yes_no
from shelfglass.operators.joins import null_safe_join
from shelfglass.operators.quantiles import group_quantiles

DIMENSIONS = ("height", "width", "depth")
MIN_ROWS = 4
DEFAULT_MULTIPLIER = 1.5


def _multiplier(multipliers: Mapping[str, float] | float | None, dim: str) -> float:
    if isinstance(multipliers, Mapping):
        return float(multipliers.get(dim, DEFAULT_MULTIPLIER))
    return float(DEFAULT_MULTIPLIER if multipliers is None else multipliers)


def iqr_bounds(
    df: DataFrame,
    keys: Sequence[str] = (),
    dims: Sequence[str] = DIMENSIONS,
    multipliers: Mapping[str, float] | float | None = None,
    clip: bool = False,
) -> DataFrame:
    """Quartiles, IQR and fences per key group; ``clip`` keeps fences inside the observed range.

    Groups below four rows report 0.0 everywhere next to their true ``n``.
    """
    stats = group_quantiles(df, keys, dims)
    enough = F.col("n") >= MIN_ROWS
    out = [*keys, "n"]
    for d in dims:
        q1, q3 = F.col(f"{d}_q1"), F.col(f"{d}_q3")
        iqr, m = q3 - q1, _multiplier(multipliers, d)
        lower, upper = q1 - m * iqr, q3 + m * iqr
        if clip:
            lower = F.greatest(lower, F.col(f"{d}_min"))
            upper = F.least(upper, F.col(f"{d}_max"))
        for name, value in (("q1", q1), ("q3", q3), ("iqr", iqr), ("lower", lower),
                            ("upper", upper)):
            out.append(F.when(enough, value).otherwise(0.0).alias(f"{d}_{name}"))
    return stats.select(*out)


def bound_columns(dims: Sequence[str] = DIMENSIONS) -> list[str]:
    return [f"{d}_{s}" for d in dims for s in ("q1", "q3", "iqr", "lower", "upper")]


def with_type_bounds(
    df: DataFrame,
    type_col: str | None = "product_type",
    population: Sequence[str] = (),
    dims: Sequence[str] = DIMENSIONS,
    multipliers: Mapping[str, float] | float | None = None,
    clip: bool = False,
) -> DataFrame:
    """Rows with the fences of their type (or of their population when ``type_col`` is None).

    With one type only, its group is the whole population. Rows without a type have no fences
    of their own unless the whole population is untyped; they get 0.0 and ``n`` 0.
    """
    population = list(population)
    keys = [*population, type_col] if type_col else population
    stats = iqr_bounds(df, keys, dims, multipliers, clip)
    if not type_col:
        return null_safe_join(df, stats, keys, "left")
    typed = stats.groupBy(*population).agg(
        F.max(F.col(type_col).isNotNull()).alias("_has_types")
    )
    lost = F.col(type_col).isNull() & F.col("_has_types")
    fenced = null_safe_join(stats, typed, population).select(
        *keys,
        F.when(lost, 0).otherwise(F.col("n")).cast("bigint").alias("n"),
        *[F.when(lost, 0.0).otherwise(F.col(c)).alias(c) for c in bound_columns(dims)],
    )
    return null_safe_join(df, fenced, keys, "left")


def outside(dim: str) -> Column:
    """True where a dimension lies beyond its fences and the group was large enough."""
    x = F.col(dim)
    beyond = (x < F.col(f"{dim}_lower")) | (x > F.col(f"{dim}_upper"))
    return F.coalesce(beyond & (F.col("n") >= MIN_ROWS), F.lit(False))


def flag_outside(df: DataFrame, dims: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Adds ``iqr_<dim>_outlier`` per dimension and ``iqr_is_outlier`` (any dimension)."""
    flags = {f"iqr_{d}_outlier": outside(d) for d in dims}
    return df.withColumns(flags).withColumn(
        "iqr_is_outlier", reduce(or_, [F.col(c) for c in flags])
    )


def flags_as_status(df: DataFrame, dims: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Flags to 0 = outlier, 1 = normal: ``iqr_<dim>_status`` and their minimum ``iqr_status``."""
    status = {f"iqr_{d}_status": F.when(F.col(f"iqr_{d}_outlier"), 0).otherwise(1) for d in dims}
    return df.withColumns(status).withColumn("iqr_status", F.least(*[F.col(c) for c in status]))


def flags_as_outlier_text(df: DataFrame, dims: Sequence[str] = DIMENSIONS) -> DataFrame:
    """``iqr_o_<dim>``: Yes means outlier."""
    return df.withColumns({f"iqr_o_{d}": yes_no(F.col(f"iqr_{d}_outlier")) for d in dims})


def flags_as_valid_text(df: DataFrame, dims: Sequence[str] = DIMENSIONS) -> DataFrame:
    """File mode, Yes means normal; groups below four rows are not valid."""
    enough = F.col("n") >= MIN_ROWS
    texts = {f"iqr_{d}": yes_no(~F.col(f"iqr_{d}_outlier") & enough) for d in dims}
    texts["iqr_status"] = yes_no(~F.col("iqr_is_outlier") & enough)
    return df.withColumns(texts)


def outlier_totals(df: DataFrame, flag: str, keys: Sequence[str] = (), digits: int = 2,
                   ) -> DataFrame:
    """Total, outliers, normals and outlier share; a NULL flag counts as ``excluded``."""
    f = F.col(flag)
    totals = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(f).alias("outliers"),
        F.count_if(~f).alias("normals"),
        F.count_if(f.isNull()).alias("excluded"),
    )
    return totals.withColumn("outlier_pct", percent(F.col("outliers"), F.col("total"), digits))


def fence_distance(dims: Sequence[str] = DIMENSIONS) -> Column:
    """Summed distance of the dimensions beyond their fences."""
    zero = F.lit(0.0)
    parts = [F.greatest(F.col(f"{d}_lower") - F.col(d), zero)
             + F.greatest(F.col(d) - F.col(f"{d}_upper"), zero) for d in dims]
    return reduce(add, parts)


def with_centroid_distance(df: DataFrame, dims: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Adds ``outlier_score``, the distance to the centroid of all rows of ``df``."""
    centre = df.agg(*[F.avg(d).alias(f"_mean_{d}") for d in dims])
    square = reduce(add, [(F.col(d) - F.col(f"_mean_{d}")) ** 2 for d in dims])
    return (
        df.crossJoin(centre)  # one row by construction
        .withColumn("outlier_score", F.sqrt(square))
        .drop(*[f"_mean_{d}" for d in dims])
    )


def top_outliers(df: DataFrame, flag: str, order: str, top: int | None,
                 dims: Sequence[str] = DIMENSIONS, by_fences: bool = True,
                 digits: int | None = 9) -> DataFrame:
    """The ``top`` most distant outliers; the centroid is that of all rows, outliers included.

    Distances that agree to ``digits`` decimals are ties, which go by ``order``, so that the order
    in which a mean was summed up does not show.
    """
    scored = (df.withColumn("outlier_score", fence_distance(dims)) if by_fences
              else with_centroid_distance(df, dims))
    if digits is not None:
        scored = scored.withColumn("outlier_score", F.round("outlier_score", digits))
    ranked = scored.filter(F.col(flag)).orderBy(F.col("outlier_score").desc(), F.col(order))
    return ranked.limit(top) if top else ranked


def axis_extents(df: DataFrame, dims: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Min and max per dimension, padded by 15 percent of the range, at least 5."""
    ranges = df.agg(*[f(d).alias(f"_{n}_{d}") for d in dims
                      for n, f in (("min", F.min), ("max", F.max))])
    out = []
    for d in dims:
        low, high = F.col(f"_min_{d}"), F.col(f"_max_{d}")
        pad = F.greatest((high - low) * 0.15, F.lit(5.0))
        out += [(low - pad).alias(f"{d}_from"), (high + pad).alias(f"{d}_to")]
    return ranges.select(*out)


def standardized(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Adds ``z_<feature>`` per key group with the population deviation; zero deviation acts as 1."""
    moments = df.groupBy(*keys).agg(
        *[f(c).alias(f"_{n}_{c}") for c in features
          for n, f in (("avg", F.avg), ("sd", F.stddev_pop))]
    )

    def z(c: str) -> Column:
        sd = F.col(f"_sd_{c}")
        return (F.col(c) - F.col(f"_avg_{c}")) / F.when(sd == 0, 1.0).otherwise(sd)

    return (
        null_safe_join(df, moments, keys)
        .withColumns({f"z_{c}": z(c) for c in features})
        .drop(*[f"_{n}_{c}" for c in features for n in ("avg", "sd")])
    )
