"""The reporting day: days are counted in the zone of the books (+8 hours, no daylight saving since 1991)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hours ahead of UTC, and the zone they stand for.
OFFSET_HOURS, ZONE = 8, "Asia/Shanghai"


def reporting_day(moment: Column) -> Column:
    """The date in the reporting zone of a UTC timestamp (with or without zone)."""
    return F.to_date(moment + F.expr(f"INTERVAL {OFFSET_HOURS} HOURS"))


def day_bounds(day: Column) -> tuple[Column, Column]:
    """First and last microsecond of a reporting day, in UTC."""
    start = day.cast("timestamp_ntz") - F.expr(f"INTERVAL {OFFSET_HOURS} HOURS")
    return start, start + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MICROSECOND")


def is_day_aligned(start, end) -> bool:
    """Whether optional datetimes in UTC lie on reporting-day bounds: midnight, and 23:59:59 with no microseconds."""
    from datetime import time, timedelta

    shift = timedelta(hours=OFFSET_HOURS)
    return (start is None or (start + shift).time() == time(0)) and (end is None or (end + shift).time() == time(23, 59, 59))


def bucket(moment: Column, minutes: int) -> Column:
    """Start of the bucket of so many minutes that a UTC timestamp lies in, counted from the epoch."""
    seconds = minutes * 60
    since = F.unix_seconds(moment.cast("timestamp"))
    return F.timestamp_seconds(since - F.pmod(since, F.lit(seconds))).cast("timestamp_ntz")


def period_start(day: Column, unit: str) -> Column:
    """Monday of the week or first of the month of a date."""
    if unit not in ("week", "month"):
        raise ValueError(f"unknown period {unit!r}")
    return F.to_date(F.date_trunc(unit, day))


def months_before(moment: Column, months: int) -> Column:
    """So many calendar months earlier; a day that the month lacks becomes its last day."""
    return moment - F.make_ym_interval(F.lit(0), F.lit(months))


def try_moment(text: Column) -> Column:
    """ISO text as a timestamp, NULL if it is none; text without a zone is UTC (the session's zone)."""
    return F.try_to_timestamp(text)
