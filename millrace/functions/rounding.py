"""Rounding as SQL engines do it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column | str, digits: int) -> Column:
    """x to so many places, halves of the scaled double away from zero, as DuckDB rounds. F.round goes by the digits that a double prints: 0.6938124999999999 times a million is 693812.5 and goes up here, down there."""
    scale = F.lit(float(10**digits))
    return F.round((F.col(x) if isinstance(x, str) else x).cast("double") * scale) / scale
