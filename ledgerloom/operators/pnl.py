"""Profit and loss by day, week and month, by exchange, and the statistics over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import period_start, reporting_day
from ..functions.ratios import ratio

FLOWS = ("investment_return", "realized_pnl", "funding_fee", "trading_fee", "net_cash_flow")
LEVELS = ("equity_usd", "cumulative_return")


def daily_account_rows(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """Per account and reporting day: the day's realized PnL, funding and fees, and cash and equity so far.

    Equity is the initial equity and all signed records so far; the return is what cash flows do not explain.
    """
    kind, amount = F.col("record_type"), F.col("amount_usd")

    def day_sum(name: str, column: Column = amount) -> Column:
        return F.coalesce(F.sum(F.when(kind == name, column)), F.lit(0)).cast("decimal(24,2)")

    by_day = ledger.groupBy("account_id", reporting_day(F.col("record_time")).alias("snapshot_date")).agg(
        day_sum("REALIZED_PNL").alias("realized_pnl"),
        day_sum("FUNDING_FEE").alias("funding_fee"),
        day_sum("TRADING_FEE").alias("trading_fee"),
        (day_sum("DEPOSIT") - day_sum("WITHDRAWAL")).alias("day_cash"),
        F.sum("signed_amount_usd").alias("day_signed"),
    )
    so_far = Window.partitionBy("account_id").orderBy("snapshot_date").rowsBetween(Window.unboundedPreceding, 0)
    running = by_day.withColumn("net_cash_flow", F.sum("day_cash").over(so_far)).withColumn("signed", F.sum("day_signed").over(so_far))
    joined = running.join(accounts.filter("is_active").select("account_id", "exchange", "initial_equity"), "account_id")
    return joined.select(
        "account_id",
        "exchange",
        "snapshot_date",
        "realized_pnl",
        "funding_fee",
        "trading_fee",
        F.col("net_cash_flow").cast("decimal(24,2)").alias("net_cash_flow"),
        (F.col("initial_equity") + F.col("signed")).cast("decimal(24,2)").alias("equity_usd"),
        (F.col("signed") - F.col("net_cash_flow")).cast("decimal(24,2)").alias("investment_return"),
    )


def deltas(rows: DataFrame) -> DataFrame:
    """Cumulative columns as changes from the account's row before; its first row changes from 0."""
    order = Window.partitionBy("account_id").orderBy("snapshot_date")
    out = rows
    for name in ("investment_return", "net_cash_flow"):
        out = out.withColumn(name, F.col(name) - F.coalesce(F.lag(name).over(order), F.lit(0)))
    return out


def daily_points(rows: DataFrame) -> DataFrame:
    """One point a day over the accounts present that day, with the running return."""
    # Days are few: one row each after the sum, so the running window is over a calendar.
    by_day = deltas(rows).groupBy("snapshot_date").agg(*[F.sum(c).alias(c) for c in (*FLOWS, "equity_usd")])
    so_far = Window.orderBy("snapshot_date").rowsBetween(Window.unboundedPreceding, 0)
    return by_day.withColumn("cumulative_return", F.sum("investment_return").over(so_far))


def as_double(points: DataFrame, key: str) -> DataFrame:
    return points.select(key, *[F.col(c).cast("double").alias(c) for c in (*FLOWS, *LEVELS)])


def rollup(points: DataFrame, unit: str) -> DataFrame:
    """Daily points by week or month: flows summed, levels as of the last day."""
    keyed = points.withColumn("period_start", period_start(F.col("snapshot_date"), unit))
    return keyed.groupBy("period_start").agg(*[F.sum(c).alias(c) for c in FLOWS], *[F.max_by(c, "snapshot_date").alias(c) for c in LEVELS])


def by_exchange(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """Totals of every exchange with an active account, 0 where it has no rows."""
    exchanges = accounts.filter("is_active").select("exchange").distinct()
    sums = deltas(rows).groupBy("exchange").agg(*[F.sum(c).alias(c) for c in FLOWS], F.countDistinct("snapshot_date").alias("days"))
    joined = exchanges.join(sums, "exchange", "left")
    return joined.select("exchange", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FLOWS], F.coalesce("days", F.lit(0)).alias("days"))


def day_stats(points: DataFrame) -> DataFrame:
    """Best and worst day (0 without days), and how many days gained and lost."""
    r = F.col("investment_return")
    return points.agg(
        F.coalesce(F.max(r), F.lit(0)).cast("double").alias("best_day"),
        F.coalesce(F.min(r), F.lit(0)).cast("double").alias("worst_day"),
        F.count_if(r > 0).alias("profitable_days"),
        F.count_if(r < 0).alias("losing_days"),
        F.coalesce(F.sum(r), F.lit(0)).cast("double").alias("period_return"),
    )


def period_pnl(
    initial_equity: Column,
    current_equity: Column,
    deposits: Column,
    withdrawals: Column,
    realized: Column,
    funding: Column,
    fee: Column,
    initial_unrealized: Column,
    current_unrealized: Column,
) -> dict[str, Column]:
    """Cash flow, return, trading result and change of unrealized PnL of a tracking period."""
    cash = deposits - withdrawals
    return {
        "net_cash_flow": cash,
        "investment_return": current_equity - initial_equity - cash,
        "trading_pnl": realized + funding - fee,
        "unrealized_change": current_unrealized - initial_unrealized,
    }


def max_drawdown(points: DataFrame, order: str = "snapshot_date", equity: str = "equity_usd") -> DataFrame:
    """Largest fall from the running peak in percent; the peak starts at 0, and days at or below 0 peak do not count."""
    so_far = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    e = F.col(equity).cast("double")
    peaked = points.select(e.alias("e"), F.greatest(F.max(e).over(so_far), F.lit(0.0)).alias("peak"))
    fall = F.when(F.col("peak") > 0, (F.col("peak") - F.col("e")) / F.col("peak") * 100)
    return peaked.agg(F.coalesce(F.max(fall), F.lit(0.0)).alias("max_drawdown"))


def change(points: DataFrame, order: str, value: str) -> DataFrame:
    """First and last value, their difference, and that in percent (NULL without points or from 0)."""
    ends = points.agg(F.min_by(value, order).cast("double").alias("first"), F.max_by(value, order).cast("double").alias("last"))
    amount = F.col("last") - F.col("first")
    return ends.select("first", "last", amount.alias("change_amount"), (ratio(amount, F.col("first")) * 100).alias("change_percent"))
