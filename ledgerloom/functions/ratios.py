"""Ratios with a stated result where the denominator is zero, in double; sums stay decimal until here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column, otherwise: float | None = None) -> Column:
    """numerator / denominator as double; `otherwise` (NULL by default) where the denominator is zero or NULL."""
    d = denominator.cast("double")
    return F.when(d != 0, numerator.cast("double") / d).otherwise(F.lit(otherwise).cast("double"))


def percent(numerator: Column, denominator: Column, otherwise: float | None = None) -> Column:
    d = denominator.cast("double")
    return F.when(d != 0, numerator.cast("double") / d * 100).otherwise(F.lit(otherwise).cast("double"))


def zero(amount: Column) -> Column:
    """An amount as double, 0 for NULL."""
    return F.coalesce(amount.cast("double"), F.lit(0.0))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))
