"""Records of paged upstreams kept up to date in a table of versions."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import VersionedTable
from ..sources.paged import PagedSource

#: Rows of a page that written_upstream writes.
PAGE = 500


def _day() -> Column:
    return F.to_date(F.timestamp_millis("at"))


def written_upstream(records: DataFrame, path: str, page: int = PAGE) -> str:
    """Writes records (stream, at in milliseconds, ...) as an upstream of pages, each a file of at most `page` rows in
    the folder of its stream and day; returns the path, which folder_pages reads."""
    dealt = records.withColumn("day", _day()).repartitionByRange("stream", "at").sortWithinPartitions("stream", "at")
    dealt.write.option("maxRecordsPerFile", page).partitionBy("stream", "day").parquet(path)
    return path


def folder_pages(path: str, stream: str):
    """A fetch over such a folder: its cursor counts the files of the days asked for. The folder is reached by its
    address, so tasks on any machine read it."""
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    store, root = fs.FileSystem.from_uri(path)

    def files(day: date) -> list[str]:
        at = fs.FileSelector(f"{root}/stream={stream}/day={day.isoformat()}", allow_not_found=True)
        return sorted(f.path for f in store.get_file_info(at) if f.base_name.endswith(".parquet"))

    def days(start: int, end: int) -> Iterator[date]:
        at, last = (datetime.fromtimestamp(ms / 1000, UTC).date() for ms in (start, end))
        while at <= last:
            yield at
            at += timedelta(days=1)

    def fetch(start: int, end: int, cursor: int | None) -> tuple[list[dict], int | None]:
        every = [f for day in days(start, end) for f in files(day)]
        turn = cursor or 0
        if turn >= len(every):
            return [], None
        with store.open_input_file(every[turn]) as held:
            rows = pq.read_table(held).to_pylist()
        return [r for r in rows if start <= r["at"] <= end], turn + 1 if turn + 1 < len(every) else None

    return fetch


def keep_records(spark: SparkSession, table: VersionedTable, checkpoint: str, fields: str, order: list[str], every: dict[str, int], **options) -> None:
    """Reads all streams that are due (see PagedStreamReader; options are the source's) and upserts their rows, the
    greatest by `order` of each key, under the day of their time `at`, then ends. A batch counts once, however often it
    is run."""
    spark.dataSource.register(PagedSource)
    reader = spark.readStream.format("paged").schema(fields).options(streams=json.dumps(every), **options)

    def write(batch: DataFrame, number: int) -> None:
        table.upsert(batch.withColumn("day", _day()), order, latest=True, batch=("records", number))

    reader.load().writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
