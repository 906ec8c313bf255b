"""Concentration, exposure, liquidation distance and the level of risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ratios import percent, ratio

#: Percent from which (or, for the distance, down to which) risk is of a level.
HIGH = {"drawdown": 25, "concentration": 50, "margin": 80, "liquidation": 10}
MEDIUM = {"drawdown": 15, "concentration": 35, "margin": 50, "liquidation": 20}


def concentration(balances: DataFrame) -> DataFrame:
    """Equity of each exchange and its share of all in percent (0 without equity)."""
    by_exchange = balances.groupBy("exchange").agg(F.sum("equity").alias("equity"))
    total = balances.agg(F.sum("equity")).scalar()
    return by_exchange.select("exchange", F.col("equity").cast("double").alias("equity"), percent(F.col("equity"), total, 0.0).alias("share_percent"))


def exposures(positions: DataFrame, total_equity: DataFrame, most: int = 10) -> DataFrame:
    """The symbols of most absolute value: value, PnL, exchanges in order, and percent of equity (0 without equity)."""
    by_symbol = positions.groupBy("symbol").agg(
        F.sum(F.abs("value_usd")).alias("value"),
        F.sum("net_pnl").alias("pnl"),
        F.array_join(F.sort_array(F.collect_set("exchange")), ",").alias("exchanges"),
    )
    total = total_equity.select("total").scalar()
    out = by_symbol.select(
        "symbol",
        F.col("value").cast("double").alias("value_usd"),
        F.col("pnl").cast("double").alias("pnl"),
        "exchanges",
        percent(F.col("value"), total, 0.0).alias("equity_percent"),
    )
    return out.orderBy(F.desc("value_usd"), "symbol").limit(most)


def liquidation_distance(side: Column, mark: Column, liquidation: Column) -> Column:
    """Percent of the mark price to liquidation, 0 at least; NULL unless both prices are positive."""
    m, q = mark.cast("double"), liquidation.cast("double")
    gap = F.when(side == "LONG", m - q).otherwise(q - m)
    return F.when((m > 0) & (q > 0), F.greatest(gap / m * 100, F.lit(0.0)))


def nearest_liquidations(positions: DataFrame, most: int = 10, ties: list[str] | None = None) -> DataFrame:
    """Positions with a distance, nearest first, to nine digits; ties by account, symbol and side, then by `ties`."""
    d = liquidation_distance(F.col("side"), F.col("mark_price"), F.col("liquidation_price"))
    return positions.withColumn("distance_percent", d).filter("distance_percent is not null").orderBy(
        F.round("distance_percent", 9),
        "account_id",
        "symbol",
        "side",
        *(ties or []),
    ).limit(most)


def margin_utilization(margin: Column, equity: Column) -> Column:
    """Sum of absolute margin balances in percent of equity, 0 without equity (an aggregate)."""
    return ratio(F.sum(F.abs(margin)) * 100, F.sum(equity), 0.0)


def level(drawdown: Column, concentrated: Column, margin: Column, distance: Column) -> Column:
    """HIGH, MEDIUM or LOW; a NULL distance counts for nothing."""

    def beyond(limits: dict[str, int]) -> Column:
        near = F.coalesce(distance <= limits["liquidation"], F.lit(False))
        return (drawdown >= limits["drawdown"]) | (concentrated >= limits["concentration"]) | (margin >= limits["margin"]) | near

    return F.when(beyond(HIGH), "HIGH").when(beyond(MEDIUM), "MEDIUM").otherwise("LOW")


def summary(drawdown: DataFrame, shares: DataFrame, utilization: DataFrame, nearest: DataFrame) -> DataFrame:
    """One row: drawdown, largest share (0 without any), margin utilization, nearest liquidation (NULL) and level."""
    out = drawdown.select(
        "max_drawdown",
        shares.agg(F.coalesce(F.max("share_percent"), F.lit(0.0))).scalar().alias("largest_share"),
        utilization.select("margin_utilization").scalar().alias("margin_utilization"),
        nearest.agg(F.min("distance_percent")).scalar().alias("nearest_liquidation"),
    )
    return out.withColumn("risk_level", level(F.col("max_drawdown"), F.col("largest_share"), F.col("margin_utilization"), F.col("nearest_liquidation")))
