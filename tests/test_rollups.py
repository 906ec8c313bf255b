"""Continuous aggregates: all levels equal the batch, however late points come and in whatever files."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.equity import downsampled
from ledgerloom.streaming.rollups import LEVELS, POINT, Rollups

T = datetime(2024, 1, 1)


def points(n, step=5):
    return [(T + timedelta(minutes=step * i), i * 1.25, i % 7, T + timedelta(minutes=step * i, seconds=i % 200)) for i in range(n)]


def frame(spark, rows):
    raw = spark.createDataFrame(rows, "bucket_time timestamp_ntz, total_equity double, account_count long, source_latest_at timestamp_ntz")
    return raw.withColumn("total_equity", F.col("total_equity").cast("decimal(28,2)")).coalesce(1)


def held(df):
    return sorted(tuple(r) for r in df.select("bucket_time", "total_equity", "account_count", "source_latest_at").collect())


def closed(spark, rollups, minutes):
    return spark.read.parquet(rollups._folder(minutes)).count()


@pytest.mark.parametrize("order", ["in order", "shuffled"])
def test_levels_equal_the_batch(spark, tmp_path, order):
    rows = points(400, step=10)
    if order == "shuffled":
        random.Random(3).shuffle(rows)
    source, rollups = f"file://{tmp_path}/points", Rollups(spark, f"file://{tmp_path}/levels")
    for at in range(0, 400, 200):
        frame(spark, rows[at : at + 200]).write.mode("append").parquet(source)
        rollups.refresh(source, maxFilesPerTrigger=1)
        want = frame(spark, rows[: at + 200])
        for minutes in LEVELS:
            assert held(rollups.read(minutes)) == held(downsampled(want, minutes))
    # In order every window but the last is closed by the stream, and nothing is reckoned twice.
    late = {m: rollups.corrections[m].read().count() for m in LEVELS}
    assert closed(spark, rollups, 30) > 20
    assert all(n == 0 for n in late.values()) if order == "in order" else late[30] > 0


def test_a_late_point_and_one_that_is_stated_again(spark, tmp_path):
    source, rollups = f"file://{tmp_path}/points", Rollups(spark, f"file://{tmp_path}/levels")
    rows = [r for r in points(300) if r[0].minute != 55]
    frame(spark, rows).write.parquet(source)
    rollups.refresh(source)
    before = held(rollups.read(30))
    version = rollups.points.version()
    rollups.refresh(source)
    assert held(rollups.read(30)) == before and rollups.points.version() == version
    late = (T + timedelta(minutes=55), 999.0, 3, T + timedelta(hours=2))
    again = (rows[0][0], 5.0, 2, rows[0][3] + timedelta(seconds=1))
    frame(spark, [late, again]).write.mode("append").parquet(source)
    rollups.refresh(source)
    want = frame(spark, [late, again, *rows[1:]])
    for minutes in LEVELS:
        assert held(rollups.read(minutes)) == held(downsampled(want, minutes))
    assert rollups.corrections[30].read().count() == 1


def test_a_refresh_that_fails_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    source, rollups = f"file://{tmp_path}/points", Rollups(spark, f"file://{tmp_path}/levels")
    rows = points(200)
    random.Random(1).shuffle(rows)
    for n in range(2):
        frame(spark, rows[n * 100 : n * 100 + 100]).write.mode("append").parquet(source)

    def lost(*_):
        raise OSError("lost")

    monkeypatch.setattr(rollups.corrections[120], "publish", lost)
    with pytest.raises(Exception, match="lost"):
        rollups.refresh(source, maxFilesPerTrigger=1)
    monkeypatch.undo()
    rollups.refresh(source, maxFilesPerTrigger=1)
    for minutes in LEVELS:
        assert held(rollups.read(minutes)) == held(downsampled(frame(spark, rows), minutes))


def test_no_points(spark, tmp_path):
    source, rollups = f"file://{tmp_path}/points", Rollups(spark, f"file://{tmp_path}/levels")
    spark.createDataFrame([], POINT).write.parquet(source)
    rollups.refresh(source)
    assert [held(rollups.read(m)) for m in LEVELS] == [[]] * 4
