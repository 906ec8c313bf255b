"""Tables that change by key, read models with an age, exports and audit rows, over plain Parquet folders."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import csv_cell
from ..operators.incremental import upserted
from .shared import exists, fresh_path, staged

#: Rows of an export at most, and seconds that a read model is served at least.
EXPORT_ROWS, LEAST_TTL = 10_000, 120


def stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at path, empty if there is none yet. One that is there and cannot be read is an error, not empty."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def upsert(incoming: DataFrame, path: str, keys: list[str], version: list[str], partition: str, latest: bool = False) -> None:
    """Puts rows into a table partitioned by `partition` (part of every key), rewriting only the partitions touched.

    An incoming row replaces the stored one; with `latest` the greater version of the two stays.

    The new partitions are written aside first, and then moved into this plain folder one by one: a job that is lost
    before that leaves the table as it was, one that is lost during it leaves some partitions new and some old, and
    the same batch again gives the whole new table. Where readers must see all or nothing, or ask what has changed, use
    commits.VersionedTable.
    """
    spark = incoming.sparkSession
    touched = staged(incoming, fresh_path(spark, "incoming"))
    if touched.isEmpty():
        return
    # Every partition that is overwritten brings its stored rows, however many there are.
    days = touched.select(F.col(partition).alias("__partition")).distinct()
    old = stored(spark, path, incoming.schema)
    old = old.join(days, F.col(partition).eqNullSafe(F.col("__partition")), "left_semi")
    merged = upserted(old.limit(0), old.unionByName(touched), keys, version) if latest else upserted(old, touched, keys, version)
    new = staged(merged, fresh_path(spark, "merged"))
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def export_csv(rows: DataFrame, path: str, order: list, columns: list[str], most: int = EXPORT_ROWS) -> None:
    """The newest rows with header, text guarded against being read as formulas."""
    guarded = [csv_cell(F.col(c)).alias(c) if kind == "string" else F.col(c) for c, kind in rows.select(*columns).dtypes]
    rows.orderBy(*order).limit(most).select(*guarded).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_model(spark: SparkSession, path: str, now: datetime, every_seconds: int, compute: Callable[[], DataFrame]) -> DataFrame:
    """The stored result while it is young enough (twice the interval, LEAST_TTL at least), else computed and stored."""
    ttl = timedelta(seconds=max(2 * every_seconds, LEAST_TTL))
    if exists(spark, path):
        kept = spark.read.parquet(path)
        at = kept.agg(F.max("calculated_at")).first()[0]
        if at is not None and now - at <= ttl:
            return kept.drop("calculated_at")
    fresh = staged(compute().withColumn("calculated_at", F.lit(now).cast("timestamp_ntz")), fresh_path(spark, "model"))
    fresh.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).drop("calculated_at")


def audit(spark: SparkSession, path: str, now: datetime, action: str, outcome: str, details: dict[str, str]) -> None:
    row = [(now, action, outcome, details)]
    spark.createDataFrame(row, "at timestamp_ntz, action string, outcome string, details map<string,string>").write.mode("append").parquet(path)


def relabelled(rows: DataFrame, column: str, old: str, new: str, test=None) -> DataFrame:
    """`new` for `old` in a column, where `test` holds."""
    hit = F.col(column) == old
    return rows.withColumn(column, F.when(hit if test is None else hit & test, new).otherwise(F.col(column)))
