"""Repairs of stored positions, as plans: what would be deleted, migrated, inserted or refused.

Every repair gives its plan as DataFrames, so a preview is the plan and applying it is writing the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def realized_by_day(income: DataFrame, closed: DataFrame, days: DataFrame, income_day: Column, close_day: Column) -> DataFrame:
    """Realized PnL of the given (account_id, snapshot_date): the sum of income if there is any income record of
    that day, else of closed positions, else 0."""
    keys = ["account_id", "snapshot_date"]
    earned = income.withColumn("snapshot_date", income_day).join(days, keys, "left_semi").groupBy(*keys).agg(
        F.sum("amount_usd").alias("earned"),
        F.count(F.lit(1)).alias("n"),
    )
    gained = closed.withColumn("snapshot_date", close_day).join(days, keys, "left_semi").groupBy(*keys).agg(F.sum("realized_pnl").alias("gained"))
    joined = days.select(*keys).distinct().join(earned, keys, "left").join(gained, keys, "left")
    realized = F.when(F.coalesce("n", F.lit(0)) > 0, F.col("earned")).otherwise(F.col("gained"))
    return joined.select(*keys, F.coalesce(realized, F.lit(0)).alias("realized_pnl"))


def duplicate_plan(rows: DataFrame, group: list[str], order: list[Column], key: list[str]) -> DataFrame:
    """Rows to delete: all of a group but the first in the given order (the greatest close, update, creation)."""
    # Rows meet the one that stays in one pass: rows of its key stay with it, a null in a key being a value like others.
    kept = F.first(F.struct(*key)).over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("__kept", kept).filter(~F.struct(*key).eqNullSafe(F.col("__kept"))).drop("__kept")


def fragment_plan(stored: DataFrame, trade_orders: DataFrame, normalized: DataFrame) -> DataFrame:
    """Groups of stored rows (source_record_id, symbol, side, trade_id) that are fills of one order: how many, how
    many normalised positions match them, and the row that stays. `resolved` is false unless exactly one matches;
    a group that is not resolved must not be touched."""
    known = stored.join(trade_orders, "trade_id").join(normalized.select("source_record_id", F.lit(1).alias("match")), "source_record_id", "left")
    groups = known.groupBy("account_id", "symbol", "side", "order_id").agg(
        F.count(F.lit(1)).alias("stored_rows"),
        F.count("match").alias("matches"),
        F.max(F.when(F.col("match") == 1, F.col("source_record_id"))).alias("keep_source_record_id"),
    )
    many = groups.filter("stored_rows > 1")
    return many.withColumn("resolved", F.col("matches") == 1).withColumn(
        "keep_source_record_id",
        F.when(F.col("matches") == 1, F.col("keep_source_record_id")),
    ).withColumn("to_delete", F.when(F.col("resolved"), F.col("stored_rows") - 1).otherwise(0))


def rebuild_plan(legacy: DataFrame, normalized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cycles, unresolved): of each normalised cycle (source_record_id, base_id, symbol, side, open_time) whether it
    is there already, migrates legacy rows of the same base, symbol, side and opening, or is inserted; and the
    legacy rows that no cycle matches, with which nothing may be applied."""
    match = ["base_id", "symbol", "side", "open_time"]
    exact = legacy.select("source_record_id").distinct().withColumn("there", F.lit(True))
    counts = legacy.filter("is_legacy").groupBy(*match).agg(F.count(F.lit(1)).alias("candidates"))
    cycles = normalized.join(exact, "source_record_id", "left").join(counts, match, "left")
    n = F.coalesce("candidates", F.lit(0))
    action = F.when(F.col("there"), "KEEP").when(n > 0, "MIGRATE").otherwise("INSERT")
    deleted = F.when(F.col("there"), n).otherwise(F.greatest(n - 1, F.lit(0)))
    planned = cycles.select("source_record_id", *match, action.alias("action"), deleted.alias("legacy_to_delete"))
    return planned, legacy.filter("is_legacy").join(normalized.select(*match).distinct(), match, "left_anti")


def with_previous_leverage(closed: DataFrame, previous: DataFrame, now: Column, open_seconds: int = 2, close_seconds: int = 300) -> DataFrame:
    """Closed positions with leverage and margin of the position that was open before under the same account, symbol
    and side, if it opened at the same time (to under 2 s) or closed just now; their own values come first."""
    keys = ["account_id", "symbol", "side"]
    seconds = lambda a, b: F.abs(F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 1_000_000
    old = previous.select(*keys, F.col("open_time").alias("__opened"), F.col("leverage").alias("__leverage"), F.col("margin_used").alias("__margin"))
    joined = closed.join(old, keys, "left")
    same = F.coalesce(seconds(F.col("open_time"), F.col("__opened")) < open_seconds, F.lit(False)) | (seconds(now, F.col("close_time")) < close_seconds)
    out = joined.withColumn("leverage", F.coalesce("leverage", F.when(same, F.col("__leverage")))).withColumn(
        "margin_used",
        F.coalesce("margin_used", F.when(same, F.col("__margin"))),
    )
    return out.select(*closed.columns)


def with_wider_coverage(initial: DataFrame, excluded: DataFrame, version: int = 2) -> DataFrame:
    """Baselines (account_id, coverage_version and measures) plus what coverage left out before (account_id and the
    same measures), once: accounts at `version` or later stay as they are."""
    measures = [c for c in excluded.columns if c != "account_id"]
    joined = initial.join(excluded.select("account_id", *[F.col(m).alias(f"__{m}") for m in measures]), "account_id", "left")
    old = F.coalesce("coverage_version", F.lit(0)) < version
    added = {m: F.when(old, F.col(m) + F.coalesce(f"__{m}", F.lit(0))).otherwise(F.col(m)) for m in measures}
    return joined.withColumns(added).withColumn(
        "coverage_version",
        F.greatest(F.coalesce("coverage_version", F.lit(0)), F.lit(version)),
    ).select(*initial.columns)
