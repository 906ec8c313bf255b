"""Folds over each key's rows in the order of time, kept by a stream whose files may come in any order.

Rows wait in the key's state until the watermark has passed them and are then taken in order, so what comes out is
what the batch operators give, as long as no row is later than the watermark's lag; one that is gets dropped. The
state of a key is small (what the fold carries) and goes when the fold says that it can no longer matter.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..sources.shared import fresh_path

#: Rows as a fold takes them: a key, a moment (as a timestamp and in microseconds), what settles ties, and a value.
ROWS = "key string, at timestamp, at_us bigint, tie string, value string"
FOLDED = "key string, at_us bigint, value string"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Fold(Protocol):
    #: Microseconds after which the state of a key without rows no longer matters; None if it always does.
    expires: int | None

    def take(self, state: str | None, at_us: int, values: list[str]) -> tuple[str | None, list[str]]:
        """(the state after the rows of one moment, what comes out)."""


@dataclass(frozen=True)
class Spaced:
    """Rows that come more than `apart` microseconds after the last one kept."""

    apart: int

    @property
    def expires(self) -> int:
        return self.apart

    def take(self, state: str | None, at_us: int, values: list[str]) -> tuple[str, list[str]]:
        if state is not None and at_us <= int(state) + self.apart:
            return state, []
        return str(at_us), values[:1]


@dataclass(frozen=True)
class Sticky:
    """The status whenever it changes: a PARTIAL stays against a COMPLETE that is not authoritative. Values are
    status and, after a bar, whether it is authoritative."""

    expires: None = None

    def take(self, state: str | None, at_us: int, values: list[str]) -> tuple[str | None, list[str]]:
        out = []
        for value in values:
            status, _, sure = value.partition("|")
            after = state if state == "PARTIAL" and status == "COMPLETE" and sure != "true" else status
            if after != state:
                out.append(after)
            state = after
        return state, out


@dataclass(frozen=True)
class Reductions:
    """Positions whose size is less than in the moment before, or that are gone. The values of a moment are one
    snapshot: JSON with `position` and `size`, or a list of such; one without a position, or a list of none, tells that
    there is a snapshot."""

    expires: None = None

    def take(self, state: str | None, at_us: int, values: list[str]) -> tuple[str, list[str]]:
        sizes: dict[str, Decimal] = {}
        given = map(json.loads, values)
        for held in (one for some in given for one in (some if isinstance(some, list) else [some])):
            if held.get("position") is not None:
                sizes[held["position"]] = sizes.get(held["position"], Decimal(0)) + abs(Decimal(held["size"]))
        before = {k: Decimal(v) for k, v in json.loads(state).items()} if state else {}
        fell = {k: v for k, v in before.items() if sizes.get(k, Decimal(0)) < v}
        out = [json.dumps({"position": k, "before": str(v), "after": str(sizes.get(k, Decimal(0)))}) for k, v in sorted(fell.items())]
        return json.dumps({k: str(v) for k, v in sizes.items()}), out


class OrderedFold(StatefulProcessor):
    """The fold of one key: pending rows, the state so far, and a timer at the first pending row or the state's end."""

    def __init__(self, fold: Fold):
        self.fold = fold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "at_us long, tie string, value string")
        self.state = handle.getValueState("state", "at_us long, value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        least = None
        for frame in rows:
            got = [(int(a), t, v) for a, t, v in zip(frame["at_us"], frame["tie"], frame["value"], strict=True)]
            self.pending.appendList(got)
            least = min([least, *(g[0] for g in got)], key=lambda a: float("inf") if a is None else a)
        if least is not None:
            self._wake(least)
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        every = sorted(self.pending.get(), key=lambda r: (r[0], r[1] or ""))
        ready, later = [r for r in every if r[0] <= passed], [r for r in every if r[0] > passed]
        at, held = self.state.get() if self.state.exists() else (None, None)
        out = []
        while ready:
            at = ready[0][0]
            same = [r for r in ready if r[0] == at]
            held, found = self.fold.take(held, at, [r[2] for r in same])
            out += [(key[0], at, v) for v in found]
            ready = ready[len(same) :]
        if later:
            self.pending.put(later)
            self._wake(later[0][0])
        else:
            self.pending.clear()
        end = None if at is None or self.fold.expires is None else at + self.fold.expires
        if end is not None and end < passed and not later:
            self.state.clear()
        elif at is not None:
            self.state.update((at, held))
            if end is not None:
                self._wake(end + 1)
        if out:
            yield pd.DataFrame(out, columns=["key", "at_us", "value"])

    def close(self) -> None:
        pass

    def _wake(self, at_us: int) -> None:
        self.handle.registerTimer(-(-at_us // 1000))


def keyed(rows: DataFrame, keys: list[str], at: str, tie: list[str], value: Column) -> DataFrame:
    """Rows of a table or a stream as ROWS; rows without a time are left out, as nothing orders them."""
    moment = F.col(at).cast("timestamp")
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    # Ties are settled as text: numbers at one width.
    place = F.concat_ws("\x1f", *[F.lpad(F.col(c).cast("string"), 24, " ") for c in tie]) if tie else F.lit("")
    return rows.filter(moment.isNotNull()).select(key.alias("key"), moment.alias("at"), F.unix_micros(moment).alias("at_us"), place.alias("tie"), value.alias("value"))


def folded(rows: DataFrame, fold: Fold, lag: str) -> DataFrame:
    """A stream of ROWS as the stream of what the fold of each key puts out (FOLDED)."""
    late = rows.withWatermark("at", lag).groupBy("key")
    return late.transformWithStateInPandas(OrderedFold(fold), FOLDED, "Append", "EventTime")


def replayed(spark: SparkSession, folder: str, fold: Fold, lag: str, **options) -> DataFrame:
    """Runs a folder of Parquet files of ROWS through the fold to its end, and returns what came out. A row of the key
    '' that lies in the future ends the waiting of those before it, and is left out."""
    out, name = fresh_path(spark, "folded"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, _ROCKS)
    try:
        stream = folded(spark.readStream.schema(ROWS).options(**options).parquet(folder), fold, lag)
        writer = stream.filter("key != ''").writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh_path(spark, "fold-checkpoint"))
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(FOLDED).parquet(out)


def flush(spark: SparkSession) -> DataFrame:
    """The row that ends the waiting."""
    return spark.sql("SELECT '' AS key, TIMESTAMP '2200-01-01' AS at, unix_micros(TIMESTAMP '2200-01-01') AS at_us, '' AS tie, '' AS value")
