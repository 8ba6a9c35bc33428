"""Labels, codecs and display values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NOISE_LABEL = "Noise/Outlier"


def to_number(c: Column) -> Column:
    """Text to double; text that is not a finite number or NaN becomes NULL."""
    number = F.trim(c.cast("string")).try_cast("double")
    return F.when(F.isnan(number) | (F.abs(number) == float("inf")), None).otherwise(number)


def status_text(status: Column, pending: str = "Pending to Analyze") -> Column:
    """1 Normal, 0 Outlier, NULL the ``pending`` text (histories use 'Unknown')."""
    return F.when(status == 1, "Normal").when(status == 0, "Outlier").otherwise(pending)


def cluster_label(number: Column) -> Column:
    """-1 is noise, n is 'Cluster n', NULL stays NULL."""
    return (
        F.when(number.isNull(), None)
        .when(number == -1, NOISE_LABEL)
        .otherwise(F.concat(F.lit("Cluster "), number.cast("string")))
    )


def cluster_number(label: Column) -> Column:
    """Number in a 'Cluster n' label; -1 for noise and anything else."""
    number = F.regexp_replace(label, "Cluster ", "").try_cast("int")
    return F.coalesce(number, F.lit(-1))


def yes_no(flag: Column) -> Column:
    return F.when(flag, "Yes").otherwise("No")


def skip_text(skip: Column) -> Column:
    return F.when(skip == 1, "Yes").when(skip == 0, "No").otherwise("-")


def join_types(types: Column) -> Column:
    """Array of product types to its stored text: sorted and '|'-joined."""
    return F.array_join(F.array_sort(types), "|")


def split_types(text: Column) -> Column:
    return F.split(text, r"\|")


def join_brands(brands: Sequence[str] | None) -> str | None:
    """Brand selection to its stored text; no selection is NULL."""
    return ", ".join(brands) if brands else None


def stamp_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def at_least_zero(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """Share in percent, 0 when there is nothing to share."""
    return F.when(whole > 0, F.round(part / whole * 100.0, digits)).otherwise(0.0)


def number_or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast("double"))


def label_count(value: Column, n: Column) -> Column:
    """'value (n)' option label."""
    return F.concat(value.cast("string"), F.lit(" ("), n.cast("string"), F.lit(")"))
