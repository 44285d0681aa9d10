"""Missing values: one helper, used before every statistic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def finite(x: Column) -> Column:
    """x where it is a finite number, else null."""
    return F.when(is_finite(x), x)
