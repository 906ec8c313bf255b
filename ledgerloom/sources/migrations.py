"""Changes of a stored table that are made once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.incremental import redated
from .commits import Commit, VersionedTable

CALENDAR = "calendar"


def rebuild_calendar(table: VersionedTable, day: Column, measures: list[str], compute: Callable[[DataFrame], DataFrame]) -> Commit | None:
    """Puts the daily rows of a table (keys with snapshot_date, measures, updated_at) under the day that `day` makes of
    them; of several the last updated stays. None if that has been done: the table's manifest keeps the marker, in
    the same commit, so a run that fails leaves neither.

    Only days that rows have moved to are reckoned anew: `compute` gets their keys and returns them with the measures.
    A measure that it does not return stays as it was.
    """
    if table.done(CALENDAR):
        return None
    stored = table.read()
    moved_on = redated(stored, day, [k for k in table.keys if k != "snapshot_date"])
    arrived = stored.withColumn("__to", day).filter("__to != snapshot_date").select(*[F.col("__to").alias(k) if k == "snapshot_date" else F.col(k) for k in table.keys]).distinct()
    fresh = compute(arrived)
    new = [m for m in measures if m in fresh.columns]
    joined = moved_on.join(fresh.select(*table.keys, *[F.col(m).alias(f"__{m}") for m in new]), table.keys, "left")
    out = joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in new else F.col(c) for c in stored.columns])
    return table.replace(out, ["updated_at"], batch=(CALENDAR, 0))
