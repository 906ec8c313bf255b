"""Paged upstreams as a Spark data source: time slices are partitions, pages are read inside them with retries."""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Tries of a request, the first wait in seconds, pages of a slice, and its length in days.
TRIES, WAIT, PAGES, SLICE_DAYS = 3, 0.25, 50, 7
#: Seconds between two reads of a stream at least, and minutes that a read begins before the last one's end.
LEAST_SECONDS, OVERLAP_MINUTES = 5, 5
DAY_MS = 86_400_000


@dataclass
class Slice(InputPartition):
    start: int
    end: int


def slices(start: int, end: int, days: int = SLICE_DAYS) -> list[Slice]:
    """Closed ranges of milliseconds that meet without overlap."""
    step = days * DAY_MS
    return [Slice(lo, min(lo + step - 1, end)) for lo in range(start, end + 1, step)]


def with_retries(call, tries: int = TRIES, wait: float = WAIT, sleep=time.sleep):
    """call(), again after OSError with doubling waits; the last failure is raised without its details."""
    for n in range(tries):
        try:
            return call()
        except OSError as failure:
            if n == tries - 1:
                raise OSError(f"upstream failed after {tries} tries: {type(failure).__name__}") from None
            sleep(wait * 2**n)


def pages(fetch, part: Slice, most: int = PAGES, sleep=time.sleep, size: int | None = None) -> Iterator[dict]:
    """Rows of a slice: fetch(start, end, cursor) gives (rows, next cursor or None). A cursor seen before ends it, as
    does a page of fewer than `size` rows, where that is given.

    A slice of more than `most` pages is read again as two halves, and so on, so none of its rows is left out; a
    slice of one millisecond that is still too long is an error.
    """
    cursor, seen, got = None, set(), []
    for _ in range(most):
        rows, following = with_retries(lambda at=cursor: fetch(part.start, part.end, at), sleep=sleep)
        got += rows
        if following is None or following in seen or size is not None and len(rows) < size:
            yield from got
            return
        seen.add(following)
        cursor = following
    if part.start >= part.end:
        raise ValueError(f"more than {most} pages of one millisecond at {part.start}")
    middle = (part.start + part.end) // 2
    yield from pages(fetch, Slice(part.start, middle), most, sleep, size)
    yield from pages(fetch, Slice(middle + 1, part.end), most, sleep, size)


def offset_pages(fetch_offset, size: int):
    """A fetch for upstreams that count rows: fetch_offset(start, end, offset, size) gives rows, the last page fewer."""

    def fetch(start: int, end: int, cursor) -> tuple[list[dict], int | None]:
        offset = cursor or 0
        rows = fetch_offset(start, end, offset, size)
        return rows, offset + size if len(rows) == size else None

    return fetch


def tidied(rows: Iterator[dict], part: Slice, key: str | None = None, at: str | None = None) -> Iterator[dict]:
    """Rows within the slice by their own time `at` (milliseconds), each `key` once, in the order of time and key."""
    if key is None and at is None:
        yield from rows
        return
    seen: dict = {}
    for n, row in enumerate(rows):
        if at is None or part.start <= int(row[at]) <= part.end:
            seen.setdefault(n if key is None else row[key], row)
    yield from sorted(seen.values(), key=lambda r: (0 if at is None else int(r[at]), "" if key is None else str(r[key]).rjust(32)))


def named(target: str):
    """What "module:name" names."""
    module, _, name = target.partition(":")
    return getattr(importlib.import_module(module), name)


def fetch_of(options, stream: str | None = None):
    """The fetch that options name: a function of (start, end, cursor), or, with an option `upstream`, what the function
    makes of that text (and the stream's name)."""
    target = named(options["fetch"])
    if "upstream" not in options:
        return target
    return target(options["upstream"]) if stream is None else target(options["upstream"], stream)


def rows_of(partition: Slice, fetch, options) -> Iterator[dict]:
    size = options.get("pageSize")
    rows = pages(fetch, partition, int(options.get("maxPages", PAGES)), size=int(size) if size else None)
    return tidied(rows, partition, options.get("key"), options.get("time"))


class PagedReader(DataSourceReader):
    def __init__(self, schema, options):
        self.names = schema.fieldNames()
        self.options = options

    def partitions(self) -> list[Slice]:
        return slices(int(self.options["start"]), int(self.options["end"]), int(self.options.get("sliceDays", SLICE_DAYS)))

    def read(self, partition: Slice) -> Iterator[tuple]:
        for row in rows_of(partition, fetch_of(self.options), self.options):
            yield tuple(row.get(n) for n in self.names)


@dataclass
class StreamSlice(Slice):
    stream: str


class PagedStreamReader(DataSourceStreamReader):
    """Several upstream streams, each read on when its interval has passed.

    An offset holds each stream's cursor: the moment up to which it has been read. Cursors move in whole intervals
    from the start, so whether a stream is due follows from the clock alone, and a reader that starts again agrees
    with the one before. They are kept in the checkpoint of the query, which moves them only when a batch has been
    written, so what a lost batch would have read is read again. A read begins some minutes before the cursor, or at
    the earliest position that was open then: rows may come twice, and it takes a sink that keys them.
    """

    def __init__(self, schema, options):
        self.names = schema.fieldNames()
        self.options = options
        self.start = int(options["start"])
        self.every = {name: 1000 * max(int(seconds), LEAST_SECONDS) for name, seconds in json.loads(options["streams"]).items()}

    def now(self) -> int:
        given = self.options.get("now")
        if given is None:
            return int(time.time() * 1000)
        return int(given) if given.lstrip("-").isdigit() else named(given)()

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        passed = max(0, self.now() - self.start)
        return {name: self.start + passed // every * every for name, every in self.every.items() if passed >= every}

    def partitions(self, start: dict, end: dict) -> list[StreamSlice]:
        days, overlap = int(self.options.get("sliceDays", SLICE_DAYS)), 60_000 * int(self.options.get("overlapMinutes", OVERLAP_MINUTES))
        look_back = named(self.options["openSince"]) if "openSince" in self.options else lambda stream: None
        out = []
        for stream, until in sorted(end.items()):
            cursor = start.get(stream)
            if cursor is not None and cursor >= until:
                continue
            since = self.start if cursor is None else max(self.start, cursor - overlap)
            opened = look_back(stream)
            since = since if opened is None else min(since, opened)
            out += [StreamSlice(part.start, part.end, stream) for part in slices(since, until, days)]
        return out

    def read(self, partition: StreamSlice) -> Iterator[tuple]:
        for row in rows_of(partition, fetch_of(self.options, partition.stream), self.options):
            held = {"stream": partition.stream} | row
            yield tuple(held.get(n) for n in self.names)

    def commit(self, end: dict) -> None:
        """Nothing to release upstream: the cursor is the checkpoint's."""


class PagedSource(DataSource):
    """spark.read.format("paged").schema(...).option("fetch", "module:function").option("start", ms).option("end", ms).

    Further options: upstream (text that the function makes a fetch of), sliceDays, maxPages, pageSize (a shorter page
    is the last), key (rows of one key are one), time (rows outside the slice by that column are left out, the others
    are in its order).

    spark.readStream.format("paged") takes `streams` (JSON, seconds between reads by name) in place of `end`, and needs
    `upstream`: the function gets it and the stream's name. It also takes now (milliseconds or "module:function", the
    clock otherwise), overlapMinutes, openSince ("module:function" of the stream's name: since when a position is
    open, or None). A column `stream` is the stream's name."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self):
        raise ValueError("give the payload's schema; it is never inferred")

    def reader(self, schema) -> PagedReader:
        return PagedReader(schema, self.options)

    def streamReader(self, schema) -> PagedStreamReader:  # noqa: N802  the name is Spark's
        return PagedStreamReader(schema, self.options)
