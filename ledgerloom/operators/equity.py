"""The portfolio's equity in buckets of time: captured, rolled up, downsampled and filled from the past."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import bucket
from .running import running_sums

#: Fixed values in minutes: the width of a point, how far back a point may look, and when a value is stale.
WIDTH, BACK, STALE = 5, 15, 3
#: The bucket in minutes that each range is shown in.
RANGES = {"1d": 5, "1w": 30, "1m": 120, "6m": 360, "1y": 720}


def points(snapshots: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per bucket: the last snapshot of each account that has one in it, summed over accounts."""
    held = snapshots.withColumn("bucket_time", bucket(F.col("recorded_at"), width))
    last = held.groupBy("account_id", "bucket_time").agg(
        F.max_by("equity", F.struct("recorded_at", "snapshot_id")).alias("equity"),
        F.max("recorded_at").alias("recorded_at"),
    )
    return last.groupBy("bucket_time").agg(
        F.sum("equity").alias("total_equity"),
        F.count(F.lit(1)).alias("account_count"),
        F.max("recorded_at").alias("source_latest_at"),
    )


def downsampled(five_minutes: DataFrame, minutes: int) -> DataFrame:
    """The last point of each wider bucket, under the bucket's start; source_latest_at is the latest of all."""
    held = five_minutes.withColumn("wide", bucket(F.col("bucket_time"), minutes))
    last = held.groupBy("wide").agg(
        F.max_by("total_equity", "bucket_time").alias("total_equity"),
        F.max_by("account_count", "bucket_time").alias("account_count"),
        F.max("source_latest_at").alias("source_latest_at"),
    )
    return last.withColumnRenamed("wide", "bucket_time")


def downsampled_in_place(five_minutes: DataFrame, minutes: int) -> DataFrame:
    """The last point of each wider bucket as it is, under its own time."""
    others = [c for c in five_minutes.columns]
    last = five_minutes.groupBy(bucket(F.col("bucket_time"), minutes).alias("wide")).agg(F.max_by(F.struct(*others), "bucket_time").alias("x"))
    return last.select("x.*")


def curve(five_minutes: DataFrame, range_: str) -> DataFrame:
    """The points of a range in its bucket width."""
    if range_ not in RANGES:
        raise ValueError(f"unknown range {range_!r}")
    return five_minutes if RANGES[range_] == WIDTH else downsampled(five_minutes, RANGES[range_])


def backfilled(snapshots: DataFrame, accounts: DataFrame) -> DataFrame:
    """Points filled from the past that are whole: where every account tracked by then has a value."""
    return coverage(snapshots, accounts).filter("account_count = expected").drop("expected")


def coverage(snapshots: DataFrame, accounts: DataFrame) -> DataFrame:
    """Points filled from the past: in a bucket b each account's latest snapshot of [b - BACK, b + WIDTH); with the
    number of accounts whose value is stale, and of all accounts tracked by then (expected).

    A snapshot is a candidate of the few buckets it can fill, so the as-of join is a join on equal buckets.
    """
    active = accounts.filter("is_active").select("account_id", "tracking_started_at")
    held = snapshots.join(active, "account_id").withColumn("own", bucket(F.col("recorded_at"), WIDTH))
    spine = held.select(F.col("own").alias("bucket_time")).distinct()
    shifts = F.explode(F.array(*[F.lit(k) for k in range(0, BACK + 1, WIDTH)])).alias("k")
    candidates = held.select("account_id", "equity", "recorded_at", "snapshot_id", "tracking_started_at", "own", shifts)
    candidates = candidates.withColumn("bucket_time", F.col("own") + F.make_dt_interval(mins=F.col("k")))
    until = F.col("bucket_time") + F.expr(f"INTERVAL {WIDTH} MINUTES")
    candidates = candidates.join(spine, "bucket_time", "left_semi").filter((F.col("tracking_started_at") < until) & (F.col("recorded_at") >= F.col("bucket_time") - F.expr(f"INTERVAL {BACK} MINUTES")))
    last = candidates.groupBy("bucket_time", "account_id").agg(
        F.max_by("equity", F.struct("recorded_at", "snapshot_id")).alias("equity"),
        F.max("recorded_at").alias("recorded_at"),
    )
    stale = F.col("recorded_at") < F.col("bucket_time") - F.expr(f"INTERVAL {STALE} MINUTES")
    filled = last.groupBy("bucket_time").agg(
        F.sum("equity").alias("total_equity"),
        F.count(F.lit(1)).alias("account_count"),
        F.count_if(stale).alias("stale_account_count"),
        F.max("recorded_at").alias("source_latest_at"),
    )
    # Accounts tracked before a bucket's end: a running count over starts and ends in the order of time.
    starts = active.groupBy(F.col("tracking_started_at").alias("at")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(1))
    marks = starts.unionByName(spine.select(until.alias("at"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("kind"))).filter("at is not null")
    counted = running_sums(marks, [], F.to_date("at"), ["at", "kind"], {"expected": F.col("n")}).filter("kind = 0")
    expected = counted.select((F.col("at") - F.expr(f"INTERVAL {WIDTH} MINUTES")).alias("bucket_time"), "expected")
    return filled.join(expected, "bucket_time")
