"""Predicates built from declarative criteria, as Columns Catalyst can push down."""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS: dict[str, Callable[[Column, Any], Column]] = {
    "=": operator.eq,
    "!=": operator.ne,
    ">": operator.gt,
    "<": operator.lt,
    ">=": operator.ge,
    "<=": operator.le,
    "like": lambda c, v: c.like(v),
    "ilike": lambda c, v: c.ilike(v),
    "in": lambda c, v: c.isin(list(v)),
    "not_in": lambda c, v: ~c.isin(list(v)),
    "between": lambda c, v: c.between(v[0], v[1]),
    "is_null": lambda c, v: c.isNull() if v else c.isNotNull(),
}


def condition(field: str, op: str, value: Any = None) -> Column:
    """One comparison; an unknown operator is an error."""
    try:
        return OPERATORS[op](F.col(field), value)
    except KeyError:
        raise ValueError(f"unknown operator {op!r}") from None


def criteria(spec: dict[str, Sequence[tuple]] | None) -> Column | None:
    """``{'and': [...], 'or': [...]}`` to a Column; both present means (all) OR (any)."""
    groups = []
    for key, join in (("and", operator.and_), ("or", operator.or_)):
        parts = [condition(*part) for part in (spec or {}).get(key) or []]
        if parts:
            groups.append(reduce(join, parts))
    return reduce(operator.or_, groups) if groups else None


def all_of(*parts: Column | None) -> Column:
    """AND of the parts that are present; no part means every row."""
    present = [p for p in parts if p is not None]
    return reduce(operator.and_, present) if present else F.lit(True)


def any_of(values: Sequence | None, field: str | Column) -> Column | None:
    """``field IN values`` when a selection was made."""
    column = F.col(field) if isinstance(field, str) else field
    return column.isin(list(values)) if values else None


def equals(value: Any, field: str | Column) -> Column | None:
    column = F.col(field) if isinstance(field, str) else field
    return None if value is None else column == value


def not_skipped(field: str | Column = "skip_status") -> Column:
    column = F.col(field) if isinstance(field, str) else field
    return column.isNull() | (column != 1)


def measured(*fields: str) -> Column:
    """All dimension columns present."""
    return all_of(*[F.col(f).isNotNull() for f in fields or ("height", "width", "depth")])


# Texts of the status multi-select.
STATUS_CHOICES = {"Pending": None, "Pending to Analyze": None, "Normal": 1, "Outlier": 0}


def status_choice(choices: Sequence[str] | None, field: str | Column) -> Column | None:
    """Pending / Normal / Outlier, OR-combined and NULL-aware."""
    column = F.col(field) if isinstance(field, str) else field
    picked = [column.eqNullSafe(F.lit(STATUS_CHOICES[c])) for c in choices or []
              if c in STATUS_CHOICES]
    return reduce(operator.or_, picked) if picked else None


def skip_choice(choices: Sequence[str] | None, field: str | Column = "skip_status") -> Column | None:
    """'Yes' = skipped, 'No' = 0 or unset, both = no restriction."""
    column = F.col(field) if isinstance(field, str) else field
    picked = set(choices or [])
    if picked == {"Yes"}:
        return column == 1
    if picked == {"No"}:
        return column.isNull() | (column == 0)
    return None


def cluster_choice(numbers: Sequence[int] | None, field: str | Column) -> Column | None:
    """Cluster numbers against stored labels, -1 meaning noise."""
    labels = ["Noise/Outlier" if int(n) == -1 else f"Cluster {int(n)}" for n in numbers or []]
    return any_of(labels, field)
