"""Keeping derived tables up to date: affected keys, recomputation of those alone, keyed upserts, cursors."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_bitget_id, canonical_okx_id


def affected(changed: list[DataFrame], keys: list[str]) -> DataFrame:
    """The distinct keys of all rows that changed."""
    return reduce(DataFrame.unionByName, [c.select(*keys) for c in changed]).distinct()


def rebuilt(stored: DataFrame, source: DataFrame, keys: DataFrame, names: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The stored rows of other keys, and those that `compute` makes of the source rows of the affected keys."""
    fresh = compute(source.join(keys, names, "left_semi"))
    return stored.join(keys, names, "left_anti").unionByName(fresh)


def upserted(stored: DataFrame, incoming: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """One row for each key, the incoming one where there is one; of several incoming the greatest version.

    Applying the same batch again changes nothing.
    """
    both = stored.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    others = [c for c in stored.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct("__new", *version)).alias("x"))
    return best.select(*keys, "x.*").select(*stored.columns)


def migrated(rows: DataFrame, id_col: str = "source_record_id") -> DataFrame:
    """Rows of closed positions under the ids that stay the same whichever fill a cycle was read from."""
    return rows.withColumn(id_col, canonical_bitget_id(canonical_okx_id(F.col(id_col))))


def upserted_closed(stored: DataFrame, incoming: DataFrame, version: list[str]) -> DataFrame:
    """Closed positions after a batch: rows of one account and canonical id are one, also where the stored ones still
    have the ids of former times, several of which may stand for one position."""
    keys = ["account_id", "source_record_id"]
    old = migrated(stored)
    return upserted(upserted(old.limit(0), old, keys, version), migrated(incoming), keys, version)


def upserted_present(stored: DataFrame, incoming: DataFrame, keys: list[str], version: list[str], group: str) -> DataFrame:
    """As upserted, without stored rows of groups (exchanges) that the incoming rows no longer have."""
    present = incoming.select(group).distinct()
    return upserted(stored.join(present, group, "left_semi").select(*stored.columns), incoming, keys, version)


def stream_time(details: Column, key: str, fallback: Column) -> Column:
    """When a stream was last read, by ISO text in an account's details; the fallback where that is missing or no time."""
    return F.coalesce(F.try_to_timestamp(F.try_element_at(details, F.lit(key))).cast("timestamp_ntz"), fallback)


def oldest_streams(accounts: DataFrame, keys: dict[str, str]) -> DataFrame:
    """One row: for each name the oldest time at which an account's stream of that key was read."""
    return accounts.agg(*[F.min(stream_time(F.col("details"), key, F.col("last_synced_at"))).alias(name) for name, key in keys.items()])


def within_period(rows: DataFrame, periods: DataFrame, now: Column) -> DataFrame:
    """Rows of an active tracking period, from its start to now."""
    active = periods.filter("is_active").select("account_id", "started_at")
    return rows.join(active, "account_id").filter((F.col("record_time") >= F.col("started_at")) & (F.col("record_time") <= now)).drop("started_at")


def replaced(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows after, rows deleted) of a table that the incoming rows replace whole: keys that are gone are deleted."""
    return incoming.select(*stored.columns), stored.join(incoming.select(*keys).distinct(), keys, "left_anti")


def due(cursors: DataFrame, now: Column, least_seconds: int = 5) -> DataFrame:
    """Streams (stream, last_success_at, every_seconds) whose interval has passed, or that never succeeded."""
    waited = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("last_success_at").cast("timestamp"))
    return cursors.filter(F.col("last_success_at").isNull() | (waited >= F.greatest(F.col("every_seconds"), F.lit(least_seconds))))


def read_from(cursor: Column, overlap_minutes: int = 5, earliest_open: Column | None = None) -> Column:
    """Where the next read starts: some minutes before the cursor, or earlier for a position still open then."""
    start = cursor - F.expr(f"INTERVAL {overlap_minutes} MINUTES")
    return start if earliest_open is None else F.least(start, F.coalesce(earliest_open, start))


def changed_content(stored: DataFrame, incoming: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """Incoming rows that are new or whose content has another digest than the stored one."""
    digest = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in content]), 256)
    old = stored.select(*keys, digest.alias("__old"))
    return incoming.withColumn("__new", digest).join(old, keys, "left").filter(F.col("__old").isNull() | (F.col("__old") != F.col("__new"))).drop("__old", "__new")


def work_queue(items: DataFrame, now: Column, most: int, attempts: int = 5, retry_minutes: int = 15) -> DataFrame:
    """Items to work on next, oldest first: pending, or failed a while ago, tried less than `attempts` times."""
    retry = (F.col("status") == "FAILED") & (F.col("updated_at") < now - F.expr(f"INTERVAL {retry_minutes} MINUTES"))
    return items.filter((F.col("attempts") < attempts) & ((F.col("status") == "PENDING") | retry)).orderBy("created_at", "item_id").limit(most)


def redated(rows: DataFrame, day: Column, keys: list[str]) -> DataFrame:
    """Rows under a new day, the last updated of each key and day."""
    others = [c for c in rows.columns if c not in (*keys, "snapshot_date")]
    moved = rows.withColumn("snapshot_date", day)
    return moved.groupBy(*keys, "snapshot_date").agg(F.max_by(F.struct(*others), "updated_at").alias("x")).select(*keys, "snapshot_date", "x.*").select(*rows.columns)


def previous_row(rows: DataFrame, keys: list[str], order: list[str], column: str) -> Column:
    return F.lag(column).over(Window.partitionBy(*keys).orderBy(*order))
