"""Latest states: the last balance of each account, its newest batch of assets, and who is missing a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str], as_of: Column | None = None) -> DataFrame:
    """The last row of each key by `order` (the last of which must settle ties), at or before `as_of`.

    An aggregate, so tasks send one row for each key, and no key is sorted.
    """
    held = rows if as_of is None else rows.filter(F.col(order[0]) <= as_of)
    others = [c for c in rows.columns if c not in keys]
    last = held.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("last"))
    return last.select(*keys, "last.*").select(*rows.columns)


def latest_batch(rows: DataFrame, keys: list[str], batch: str) -> DataFrame:
    """All rows of each key's newest batch."""
    newest = Window.partitionBy(*keys)
    return rows.withColumn("__newest", F.max(batch).over(newest)).filter(F.col(batch) == F.col("__newest")).drop("__newest")


def first_of_day(rows: DataFrame, keys: list[str], day: Column, order: list[str]) -> DataFrame:
    """The first row of each key and day, with the day: what a daily snapshot keeps."""
    others = [c for c in rows.columns if c not in keys]
    first = rows.withColumn("day", day).groupBy(*keys, "day").agg(F.min_by(F.struct(*others), F.struct(*order)).alias("first"))
    return first.select(*keys, "day", "first.*")


def unvalued(assets: DataFrame) -> DataFrame:
    """Assets held, free or locked, that have no value in USD."""
    return assets.filter(F.col("value_usd").isNull() & ((F.col("available") != 0) | (F.col("locked") != 0)))


def with_assets(balances: DataFrame, assets: DataFrame) -> DataFrame:
    """Balances with the list of their assets, empty without any."""
    nested = assets.groupBy("account_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in assets.columns if c != "account_id"]))).alias("assets"))
    joined = balances.join(nested, "account_id", "left")
    return joined.withColumn("assets", F.coalesce("assets", F.array().cast(nested.schema["assets"].dataType)))


def dashboard_totals(balances: DataFrame, unvalued_assets: DataFrame, todays_return: DataFrame) -> DataFrame:
    """Equity, account count, unvalued assets and today's return over all accounts, one row."""
    totals = balances.agg(F.coalesce(F.sum("equity"), F.lit(0)).cast("double").alias("total_equity"), F.count(F.lit(1)).alias("accounts"))
    missing = unvalued_assets.agg(F.count(F.lit(1))).scalar()
    today = todays_return.agg(F.coalesce(F.sum("investment_return"), F.lit(0)).cast("double")).scalar()
    return totals.select("total_equity", "accounts", missing.alias("unvalued_assets"), today.alias("today_return"))


def unrealized_ends(snapshots: DataFrame, accounts: DataFrame, now: Column) -> DataFrame:
    """(account_id, initial_unrealized, current_unrealized): the unrealised PnL of each account's first snapshot since
    tracking started and of its last one by now, in one pass. A snapshot is all positions of one recorded_at."""
    tracked = snapshots.join(accounts.select("account_id", "tracking_started_at"), "account_id").filter((F.col("recorded_at") >= F.col("tracking_started_at")) & (F.col("recorded_at") <= now))
    each = tracked.groupBy("account_id", "recorded_at").agg(F.coalesce(F.sum("unrealized_pnl"), F.lit(0)).alias("total"))
    return each.groupBy("account_id").agg(F.min_by("total", "recorded_at").alias("initial_unrealized"), F.max_by("total", "recorded_at").alias("current_unrealized"))


def cny(amount: Column, rate: Column | float) -> Column:
    """A USD amount for display in CNY at a quoted rate; nothing stored is converted."""
    return amount.cast("double") * (F.lit(rate) if isinstance(rate, float) else rate)
