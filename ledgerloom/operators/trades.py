"""Statistics over closed positions: win and loss by side, extremes, totals, filters, pages, duplicates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ratios import ratio


def active_only(positions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Positions of active accounts, with the account's exchange, connection name and tracking start."""
    return positions.join(accounts.filter("is_active").select("account_id", "exchange", "connection_name", "tracking_started_at"), "account_id")


def _win_loss(net: Column) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("trade_count"),
        F.coalesce(F.sum(net), F.lit(0)).alias("net"),
        F.count_if(net > 0).alias("wins"),
        F.coalesce(F.sum(F.when(net > 0, net)), F.lit(0)).alias("win_sum"),
        F.count_if(net < 0).alias("losses"),
        F.coalesce(F.sum(F.when(net < 0, net)), F.lit(0)).alias("loss_sum"),
    ]


def quality_by_side(positions: DataFrame) -> DataFrame:
    """Per side, and over all as side ALL: counts, averages (0 without trades), and for ALL the payoff ratio,
    profit factor and long/short ratio (NULL without a denominator). A trade of 0 neither wins nor loses."""
    # One pass: the row of all sides is the sum of two small rows, not a second scan.
    sides = positions.groupBy("side").agg(*_win_loss(F.col("net_pnl")))
    measures = ("trade_count", "net", "wins", "win_sum", "losses", "loss_sum")
    longs, shorts = F.sum(F.when(F.col("side") == "LONG", F.col("trade_count"))), F.sum(F.when(F.col("side") == "SHORT", F.col("trade_count")))
    both = sides.rollup("side").agg(*[F.sum(m).alias(m) for m in measures], longs.alias("longs"), shorts.alias("shorts"), F.grouping("side").alias("all_sides"))
    average_win, average_loss = ratio(F.col("win_sum"), F.col("wins"), 0.0), ratio(F.col("loss_sum"), F.col("losses"), 0.0)
    whole = F.col("all_sides") == 1
    return both.select(
        F.when(whole, "ALL").otherwise(F.col("side")).alias("side"),
        F.coalesce("trade_count", F.lit(0)).alias("trade_count"),
        F.coalesce(F.col("net").cast("double"), F.lit(0.0)).alias("net_pnl"),
        ratio(F.col("net"), F.col("trade_count"), 0.0).alias("average_net"),
        (ratio(F.col("wins"), F.col("trade_count"), 0.0) * 100).alias("win_rate"),
        average_win.alias("average_win"),
        average_loss.alias("average_loss"),
        F.when(whole, ratio(average_win, F.abs(average_loss))).alias("payoff_ratio"),
        F.when(whole, ratio(F.col("win_sum"), F.abs(F.col("loss_sum")))).alias("profit_factor"),
        F.when(whole, ratio(F.col("longs"), F.col("shorts"))).alias("long_short_ratio"),
    )


def extremes(positions: DataFrame, keys: list[str]) -> DataFrame:
    """The best and the worst trade by net PnL; of equal ones the later, then the greatest keys."""
    row = F.struct(F.col("net_pnl"), F.col("close_time"), *keys, "symbol", "side")
    # Aggregates, not a sort: each task sends two rows.
    low = F.struct(-F.col("net_pnl"), F.col("close_time"), *keys)
    ends = positions.agg(F.max_by(row, F.struct("net_pnl", "close_time", *keys)).alias("best"), F.max_by(row, low).alias("worst"))
    pick = lambda name: F.struct(F.lit(name).alias("kind"), F.col(name).alias("row"))
    out = ends.select(F.explode(F.array(pick("best"), pick("worst"))).alias("x")).filter("x.row is not null").select("x.kind", "x.row.*")
    return out.withColumn("net_pnl", F.col("net_pnl").cast("double"))


def profit_and_loss(positions: DataFrame) -> DataFrame:
    """Total profit, total loss as a positive number, and net."""
    net = F.col("net_pnl")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    return positions.agg(total(F.when(net > 0, net)).alias("total_profit"), F.abs(total(F.when(net < 0, net))).alias("total_loss"), total(net).alias("net_pnl"))


def result_class(net: Column) -> Column:
    return F.when(net > 0, "PROFIT").when(net < 0, "LOSS").otherwise("BREAKEVEN")


def filtered(
    positions: DataFrame,
    exchange: str | None = None,
    account_id: int | None = None,
    symbol: str | None = None,
    side: str | None = None,
    result: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """Positions closed since tracking started, under the filters that are given; symbol is a part of either
    the symbol or the title, in any case."""
    tests = [F.col("close_time") >= F.col("tracking_started_at")]
    if exchange is not None:
        tests.append(F.col("exchange") == exchange.upper())
    if account_id is not None:
        tests.append(F.col("account_id") == account_id)
    if symbol is not None:
        tests.append(F.col("symbol").ilike(f"%{symbol}%") | F.col("title").ilike(f"%{symbol}%"))
    if side is not None:
        tests.append(F.col("side") == side.upper())
    if result is not None:
        tests.append(result_class(F.col("net_pnl")) == result.upper())
    if start is not None:
        tests.append(F.col("close_time") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        tests.append(F.col("close_time") <= F.lit(end).cast("timestamp_ntz"))
    out = positions
    for test in tests:
        out = out.filter(test)
    return out


def page(positions: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    if number < 1 or not 1 <= size <= 500:
        raise ValueError("pages count from 1 and hold 1 to 500 rows")
    return positions.orderBy(*order).offset((number - 1) * size).limit(size)


def matching_titles(positions: DataFrame, titles: DataFrame, needle: str) -> DataFrame:
    """Positions whose symbol holds the needle, or that a title (key l_partkey) holding it exists for."""
    named = titles.filter(F.col("title_text").ilike(f"%{needle}%")).select(F.col("part_key").alias("l_partkey")).distinct().withColumn("named", F.lit(True))
    joined = positions.join(named, "l_partkey", "left")
    return joined.filter(F.col("symbol").ilike(f"%{needle}%") | F.col("named")).drop("named")


def duplicates(positions: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of more than one position with the same keys."""
    return positions.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")


def keepers(positions: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The row of each group that stays: the first in the given order, with the group's size."""
    turn = Window.partitionBy(*group).orderBy(*order)
    ranked = positions.withColumn("turn", F.row_number().over(turn)).withColumn("group_size", F.count(F.lit(1)).over(Window.partitionBy(*group)))
    return ranked.filter("turn = 1").drop("turn")
