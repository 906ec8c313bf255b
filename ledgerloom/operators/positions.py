"""Derived measures of open and closed positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ratios import ratio


def margin_used(value: Column, entry: Column, mark: Column, size: Column, leverage: Column, reported: Column) -> Column:
    """Entry notional over leverage; the reported margin where leverage is not positive.

    The notional is the value taken back from mark to entry price, or entry times size where one is missing."""
    v, e, m, s, lev = (c.cast("double") for c in (value, entry, mark, size, leverage))
    notional = F.when((v != 0) & (e > 0) & (m > 0), F.abs(v) * e / m).otherwise(F.abs(e * s))
    return F.when(F.coalesce(lev, F.lit(0.0)) <= 0, F.abs(reported.cast("double"))).otherwise(notional / lev)


def unrealized_percent(pnl: Column, margin: Column, stored: Column) -> Column:
    """PnL in percent of a positive margin, else the stored percentage."""
    return F.when(margin > 0, pnl.cast("double") / margin * 100).otherwise(stored)


def closed_margin(margin: Column, entry: Column, size: Column, leverage: Column) -> Column:
    """The margin of a closed position, or entry times size over leverage where it is missing or 0."""
    fallback = ratio(F.abs(entry.cast("double")) * F.abs(size.cast("double")), F.when(leverage > 0, leverage))
    return F.coalesce(F.when(margin.cast("double") > 0, margin.cast("double")), fallback)


def price_change_percent(entry: Column, exit_: Column, side: Column) -> Column:
    """Change from entry to exit in the position's direction; NULL without an entry price."""
    return ratio((exit_.cast("double") - entry.cast("double")) * F.when(side == "SHORT", -1).otherwise(1), entry) * 100


def merged(previous: DataFrame, incoming: DataFrame, keys: list[str], kept: list[str]) -> DataFrame:
    """The incoming positions in place of the previous ones: vanished keys go, and the columns `kept` (baselines
    of tracking) stay as they were for keys that were there before."""
    old = previous.select(*keys, *[F.col(c).alias(f"__{c}") for c in kept])
    joined = incoming.join(old, keys, "left")
    return joined.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in kept else F.col(c) for c in incoming.columns])


def reduced(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose total absolute size fell, or that are gone."""
    size = lambda rows, name: rows.groupBy(*keys).agg(F.sum(F.abs("size")).alias(name))
    joined = size(previous, "before").join(size(current, "after"), keys, "left")
    return joined.withColumn("after", F.coalesce("after", F.lit(0).cast("decimal(28,2)"))).filter("after < before")
