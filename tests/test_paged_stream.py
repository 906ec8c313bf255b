"""The paged source as a stream: cursors, overlap, look-back, and a reader that is killed and started again."""

import json
from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql.types import LongType, StringType, StructType

from ledgerloom.sources.commits import VersionedTable
from ledgerloom.sources.paged import PagedStreamReader, StreamSlice
from ledgerloom.streaming.records import folder_pages, keep_records, written_upstream

DAY, MINUTE = 86_400_000, 60_000
START = 1_704_067_200_000
FIELDS = "stream string, id long, at long, amount string"
SCHEMA = StructType().add("stream", StringType()).add("id", LongType()).add("at", LongType()).add("amount", StringType())
TABLE = "stream string, id long, at long, amount string, day date"


def open_since(stream):
    return START + 100 if stream == "closed" else None


def reader(now, **more):
    return PagedStreamReader(SCHEMA, {"start": str(START), "now": str(now), "streams": json.dumps({"closed": 60, "history": 300}), "fetch": "x:y"} | more)


def test_streams_are_due_when_their_interval_has_passed():
    assert reader(START - 5).latestOffset() == {} and reader(START).latestOffset() == {}
    assert reader(START + 61_000).latestOffset() == {"closed": START + 60_000}
    assert reader(START + 300_000).latestOffset() == {"closed": START + 300_000, "history": START + 300_000}
    quick = PagedStreamReader(SCHEMA, {"start": "0", "now": "5400", "streams": '{"a": 1}'})
    assert quick.latestOffset() == {"a": 5000} and quick.initialOffset() == {}


def test_slices_overlap_and_look_back():
    first = reader(0).partitions({}, {"closed": START + 8 * DAY})
    assert first == [StreamSlice(START, START + 7 * DAY - 1, "closed"), StreamSlice(START + 7 * DAY, START + 8 * DAY, "closed")]
    at = {"closed": START + DAY, "history": START + DAY}
    assert reader(0).partitions(at, at | {"closed": START + DAY + MINUTE}) == [StreamSlice(START + DAY - 5 * MINUTE, START + DAY + MINUTE, "closed")]
    assert reader(0, overlapMinutes="0").partitions({"closed": START + 1}, {"closed": START + 9})[0].start == START + 1
    # Never before the start of tracking, but for a position that was open.
    assert reader(0).partitions({"closed": START + MINUTE}, {"closed": START + 2 * MINUTE})[0].start == START
    back = reader(0, openSince="tests.test_paged_stream:open_since").partitions(at, {k: v + MINUTE for k, v in at.items()})
    assert [(p.stream, p.start) for p in back] == [("closed", START + 100), ("history", START + DAY - 5 * MINUTE)]


def failing_pages(upstream, stream):
    """Pages of a folder whose upstream is down while a file says so."""
    path, flag = upstream.split("|")
    fetch = folder_pages(path, stream)

    def guarded(start, end, cursor):
        if stream == "history" and cursor and Path(flag).exists():
            raise ValueError("upstream is down")
        return fetch(start, end, cursor)

    return guarded


@pytest.fixture
def upstream(spark, tmp_path):
    rows = [("closed" if i % 3 else "history", i, START + i * 7 * MINUTE, str(i)) for i in range(600)]
    records = spark.createDataFrame(rows + rows[:5], FIELDS)
    return rows, written_upstream(records, f"file://{tmp_path}/pages", page=40)


def test_killed_and_started_again_it_gives_the_rows_of_the_batch(spark, tmp_path, upstream):
    rows, path = upstream
    flag = tmp_path / "down"
    table = VersionedTable(spark, f"file://{tmp_path}/table", TABLE, ["stream", "id", "day"], "day")
    end = START + 600 * 7 * MINUTE + 600_000

    def keep(now):
        keep_records(spark, table, f"file://{tmp_path}/checkpoint", FIELDS, ["at"], {"closed": 60, "history": 300}, fetch="tests.test_paged_stream:failing_pages", upstream=f"{path}|{flag}", start=START, now=now, time="at")

    def held():
        return sorted((r.stream, r.id, r.at, r.amount) for r in table.read().collect())

    keep(START + DAY)
    assert held() == sorted(r for r in rows if r[2] <= START + DAY)
    flag.touch()
    with pytest.raises(StreamingQueryException, match="upstream is down"):
        keep(end)
    assert held() == sorted(r for r in rows if r[2] <= START + DAY)
    flag.unlink()
    keep(end)
    assert held() == sorted(rows)
    version = table.version()
    keep(end)
    assert table.version() == version


def test_pages_of_a_folder(spark, upstream):
    rows, path = upstream
    fetch, got, cursor = folder_pages(path, "closed"), [], None
    while True:
        page, cursor = fetch(START + MINUTE, START + 2 * DAY, cursor)
        got += [r["id"] for r in page]
        if cursor is None:
            break
    assert sorted(set(got)) == [r[1] for r in rows if r[0] == "closed" and START + MINUTE <= r[2] <= START + 2 * DAY]
    assert folder_pages(path, "none")(START, START + DAY, None) == ([], None)
