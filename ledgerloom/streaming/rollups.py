"""Continuous aggregates of the equity curve: wider and wider buckets, each level fed by the one below.

A stream in append mode closes the windows of a level once the watermark has passed them, and the closed windows are
the input of the next level, so state is bounded by the watermark's lag and no level reads the points again. What a
stream must drop, since its window is closed, a second reader of the same points makes good: it keeps the points in
a table of versions, reckons closed windows that its batch touches anew from that table, and keeps those that differ as
corrections. Buckets that are not closed yet are reckoned from the points when they are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from ..functions.calendar import bucket
from ..operators.equity import downsampled
from ..sources.commits import VersionedTable

#: The widths of the levels in minutes, each a multiple of the one before.
LEVELS = (30, 120, 360, 720)
POINT = "bucket_time timestamp_ntz, total_equity decimal(28,2), account_count bigint, source_latest_at timestamp_ntz"
_CLOSED = f"{POINT}, last_at timestamp_ntz"


def _wide(minutes: int) -> Column:
    return bucket(F.col("bucket_time"), minutes)


class Rollups:
    """The levels under one folder. `lag` is how late a point may be and still go the streaming way."""

    def __init__(self, spark: SparkSession, path: str, lag: str = "30 minutes"):
        self.spark, self.path, self.lag = spark, path.rstrip("/"), lag
        self.points = VersionedTable(spark, f"{self.path}/points", f"{POINT}, day date", ["bucket_time", "day"], "day")
        self.corrections = {m: VersionedTable(spark, f"{self.path}/corrections-{m}", f"{POINT}, day date", ["bucket_time", "day"], "day") for m in LEVELS}

    def refresh(self, source: str, **options) -> None:
        """Takes in what has come to the folder `source` of Parquet files of points, then ends. A point that comes
        again under its time replaces the one before if its source_latest_at is not earlier."""
        below = self._read(source, POINT, **options)
        for minutes in LEVELS:
            self._close(below, minutes)
            # All that a level has closed is one batch of the next: windows close in the order of time, so none of them
            # comes late there, whatever files they lie in.
            below = self._read(self._folder(minutes), _CLOSED)
        name = "late"

        def write(batch: DataFrame, number: int) -> None:
            day = batch.withColumn("day", F.to_date("bucket_time"))
            self.points.upsert(day, ["source_latest_at"], latest=True, batch=(name, number))
            for minutes in LEVELS:
                self._correct(batch, minutes, (name, number))

        self._run(self._read(source, POINT, **options).writeStream.foreachBatch(write), name)

    def read(self, minutes: int) -> DataFrame:
        """The buckets of a level: closed ones as corrected, and those still open as they are now."""
        closed, frontier = self._closed(minutes)
        live = self.points.read()
        live = live if frontier is None else live.filter(F.col("bucket_time") >= F.lit(frontier))
        return self._kept(closed, minutes).unionByName(downsampled(live, minutes).select(*closed.columns))

    def _folder(self, minutes: int) -> str:
        return f"{self.path}/closed-{minutes}"

    def _read(self, path: str, schema: str, **options) -> DataFrame:
        reader: DataStreamReader = self.spark.readStream.schema(schema).options(**options)
        return reader.parquet(path)

    def _run(self, writer, name: str) -> None:
        writer.option("checkpointLocation", f"{self.path}/checkpoints/{name}").trigger(availableNow=True).start().awaitTermination()

    def _close(self, below: DataFrame, minutes: int) -> None:
        """Appends the windows of a level that the watermark has passed."""
        last = F.col("last_at") if "last_at" in below.columns else F.col("bucket_time")
        # Event time has to be an instant; the session's zone is the one the wall clock times are read in throughout.
        held = below.withColumn("last", last).withColumn("at", F.col("bucket_time").cast("timestamp")).withWatermark("at", self.lag)
        wide = held.groupBy(F.window("at", f"{minutes} minutes").alias("w")).agg(
            F.max_by(F.struct("total_equity", "account_count"), F.struct("last", "source_latest_at")).alias("x"),
            F.max("source_latest_at").alias("source_latest_at"),
            F.max("last").alias("last_at"),
        )
        out = wide.select(F.col("w.start").cast("timestamp_ntz").alias("bucket_time"), "x.*", "source_latest_at", "last_at")
        self._run(out.writeStream.format("parquet").option("path", self._folder(minutes)).outputMode("append"), f"closed-{minutes}")

    def _closed(self, minutes: int) -> tuple[DataFrame, object]:
        """(closed windows of a level, the moment up to which they are closed, None if none is)."""
        closed = self.spark.read.schema(_CLOSED).parquet(self._folder(minutes)).drop("last_at")
        last = closed.agg(F.max("bucket_time").alias("at")).first()["at"]
        return closed, None if last is None else self.spark.range(1).select((F.lit(last).cast("timestamp_ntz") + F.make_dt_interval(mins=F.lit(minutes))).alias("at")).first()["at"]

    def _kept(self, closed: DataFrame, minutes: int) -> DataFrame:
        right = self.corrections[minutes].read().select(*closed.columns)
        return closed.join(right.select("bucket_time"), "bucket_time", "left_anti").unionByName(right)

    def _correct(self, batch: DataFrame, minutes: int, number: tuple[str, int]) -> None:
        """Reckons the closed windows that a batch touches from all points, and keeps those that differ."""
        closed, frontier = self._closed(minutes)
        if frontier is None:
            return
        touched = batch.filter(F.col("bucket_time") < F.lit(frontier)).select(_wide(minutes).alias("wide")).distinct()
        points = self.points.read().withColumn("wide", _wide(minutes)).join(touched, "wide", "left_semi")
        fresh = downsampled(points.drop("wide"), minutes).select(*closed.columns)
        differ = fresh.exceptAll(self._kept(closed, minutes))
        self.corrections[minutes].upsert(differ.withColumn("day", F.to_date("bucket_time")), ["source_latest_at"], batch=number)
