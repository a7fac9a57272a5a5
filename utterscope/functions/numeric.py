"""Small numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` as a double, and 0.0 where the denominator is not positive."""
    return F.when(
        denominator > 0, numerator.cast("double") / denominator.cast("double")
    ).otherwise(F.lit(0.0))


def count_where(condition: Column, weight: Column | None = None) -> Column:
    """Sum of ``weight`` (default 1) over the rows where ``condition`` is true; never null."""
    weight = F.lit(1) if weight is None else weight
    return F.sum(F.when(condition, weight).otherwise(F.lit(0))).cast("long")
