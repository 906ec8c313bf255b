"""Findings about positions, one select per rule, and what may be deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ratios import percent

#: The greatest leverage that is believed, and the difference in percent points that is not.
MOST_LEVERAGE, MISMATCH, RECENT_SECONDS = 200, 0.01, 300


def _issues(rows: DataFrame, test: Column, code: str, severity: str, key: list[str]) -> DataFrame:
    entity = F.concat_ws(" ", *[F.col(k).cast("string") for k in key])
    return rows.filter(test).select("account_id", F.lit(code).alias("code"), F.lit(severity).alias("severity"), entity.alias("entity"))


def open_position_issues(positions: DataFrame) -> DataFrame:
    """Of open positions with margin, leverage and stored return: three rules; NULL leverage counts as 0."""
    key, leverage, margin = ["symbol", "side"], F.coalesce("leverage", F.lit(0)), F.col("margin_used").cast("double")
    wrong = F.abs(F.col("unrealized_percent").cast("double") - percent(F.col("unrealized_pnl"), margin)) > MISMATCH
    rules = (
        ((leverage <= 0) | (leverage > MOST_LEVERAGE), "INVALID_LEVERAGE", "WARNING"),
        (margin <= 0, "NON_POSITIVE_MARGIN", "WARNING"),
        ((margin > 0) & wrong, "RETURN_MISMATCH", "ERROR"),
    )
    # One pass: positions are read once for all rules.
    entity = F.concat_ws(" ", *[F.col(k).cast("string") for k in key])
    found = F.filter(F.array(*[F.when(test, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for test, code, severity in rules]), lambda x: x.isNotNull())
    return positions.select("account_id", entity.alias("entity"), F.explode(found).alias("x")).select("account_id", "x.code", "x.severity", "entity")


def closed_position_issues(positions: DataFrame, key: list[str]) -> DataFrame:
    """Of closed positions with a margin: leverage that is not believed, returns that do not follow from it."""
    held = positions.filter(F.col("margin_used").cast("double") > 0)
    bad = F.col("leverage").isNotNull() & ((F.col("leverage") <= 0) | (F.col("leverage") > MOST_LEVERAGE))
    wrong = F.abs(F.col("return_percent").cast("double") - percent(F.col("net_pnl"), F.col("margin_used"))) > MISMATCH
    return _issues(held, bad, "INVALID_HISTORICAL_LEVERAGE", "WARNING", key).unionByName(_issues(held, wrong, "HISTORICAL_RETURN_MISMATCH", "ERROR", key))


def disappeared(previous: DataFrame, incoming: DataFrame, closed: DataFrame, checked_at: Column) -> DataFrame:
    """Previous positions that are neither there any more nor closed within the last minutes."""
    key = ["account_id", "symbol", "side"]
    age = F.abs(F.unix_micros(checked_at.cast("timestamp")) - F.unix_micros(F.col("close_time").cast("timestamp")))
    recent = closed.filter(age < RECENT_SECONDS * 1_000_000).select(*key).distinct()
    gone = previous.join(incoming.select(*key).distinct(), key, "left_anti").join(recent, key, "left_anti")
    return _issues(gone, F.lit(True), "POSITION_DISAPPEARED", "ERROR", ["symbol", "side"])


def duplicate_issues(positions: DataFrame) -> DataFrame:
    """Groups of closed positions of one account, symbol, side and period."""
    groups = positions.groupBy("account_id", "symbol", "side", "open_time", "close_time").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return _issues(groups, F.lit(True), "DUPLICATE_CLOSED_POSITION", "ERROR", ["symbol", "side"])


def summary(issues: DataFrame) -> DataFrame:
    """Number of findings, errors and warnings."""
    return issues.agg(
        F.count(F.lit(1)).alias("issues"),
        F.count_if(F.col("severity") == "ERROR").alias("errors"),
        F.count_if(F.col("severity") == "WARNING").alias("warnings"),
    )


def expired_snapshots(snapshots: DataFrame, summarised: DataFrame, day: Column, before: Column | None) -> DataFrame:
    """Snapshots older than `before` whose account and reporting day is summarised (account_id, snapshot_date);
    none for before=None, which keeps all for ever."""
    if before is None:
        return snapshots.limit(0)
    old = snapshots.filter(F.col("recorded_at") < before).withColumn("snapshot_date", day)
    return old.join(summarised.select("account_id", "snapshot_date").distinct(), ["account_id", "snapshot_date"], "left_semi").select(*snapshots.columns)


def expired_jobs(jobs: DataFrame, before: Column | None) -> DataFrame:
    return jobs.limit(0) if before is None else jobs.filter((F.col("started_at") < before) & (F.col("status") != "RUNNING"))
