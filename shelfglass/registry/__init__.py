"""All registered queries."""

from shelfglass.registry import files, iterations, matching, outliers, products, scalars  # noqa: F401
from shelfglass.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
