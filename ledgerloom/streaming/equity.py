"""The equity curve kept up to date from a stream of balance snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import bucket
from ..operators.equity import WIDTH
from ..sources.shared import fresh_path
from ..sources.sinks import stored, upsert

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
STATE = "account_id bigint, bucket_time timestamp_ntz, equity decimal(18,2), recorded_at timestamp_ntz, snapshot_id bigint, day date"


def snapshot_stream(spark: SparkSession, sf_dir: str, per_trigger: int = 1) -> DataFrame:
    """Balance snapshots as they arrive, none dropped for being late: repeats of an event fall together in the upsert."""
    # As a pattern, the path may be a single file as well as a folder of files.
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).parquet(f"{sf_dir}/events.parque[t]")
    return raw.select(
        F.col("event_id").alias("snapshot_id"),
        F.col("user_id").alias("account_id"),
        F.col("value").cast("decimal(18,2)").alias("equity"),
        F.col("ts").cast("timestamp").alias("recorded_at"),
    )


def latest_in_buckets(snapshots: DataFrame) -> DataFrame:
    """The last snapshot of each account and bucket (STATE), of a batch or of a stream."""
    held = snapshots.withColumn("bucket_time", bucket(F.col("recorded_at"), WIDTH))
    last = held.groupBy("account_id", "bucket_time").agg(F.max_by(F.struct("equity", F.col("recorded_at").cast("timestamp_ntz").alias("recorded_at"), "snapshot_id"), F.struct("recorded_at", "snapshot_id")).alias("x"))
    return last.select("account_id", "bucket_time", "x.*", F.to_date("bucket_time").alias("day"))


def maintain(spark: SparkSession, sf_dir: str, table: str, checkpoint: str, **stream) -> None:
    """Reads what is new and upserts it: each micro-batch replaces the days it touches, keyed by account and bucket.

    The latest snapshot stays whatever order the files come in, and a batch that is run again after a failure
    changes nothing, so the table follows the stream exactly once.
    """

    def write(batch: DataFrame, _: int) -> None:
        upsert(latest_in_buckets(batch), table, ["account_id", "bucket_time", "day"], ["recorded_at", "snapshot_id"], "day", latest=True)

    stream_ = snapshot_stream(spark, sf_dir, **stream)
    query = stream_.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def points_of(state: DataFrame) -> DataFrame:
    """Portfolio points from the table kept by maintain()."""
    return state.groupBy("bucket_time").agg(
        F.sum("equity").alias("total_equity"),
        F.count(F.lit(1)).alias("account_count"),
        F.max("recorded_at").alias("source_latest_at"),
    )


def replayed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events through the stream, then the points: the same as the batch query gives."""
    table = fresh_path(spark, "stream-table")
    maintain(spark, sf_dir, table, fresh_path(spark, "stream-checkpoint"))
    return points_of(stored(spark, table, STATE))


def deduplicated_errors(errors: DataFrame, within: str = "1 hour") -> DataFrame:
    """A stream of errors (account_id, error_type, message, occurred_at) without repeats within a while of the first."""
    return errors.withWatermark("occurred_at", within).dropDuplicatesWithinWatermark(["account_id", "error_type", "message"])
