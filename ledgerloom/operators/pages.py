"""Pages of rows under optional filters, each with the number of all rows that the filters leave."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trades

#: Rows of a page at most, by list, and what filters may ask for.
SNAPSHOT_ROWS, HISTORY_ROWS = 500, 200
RESULTS, COMPLETENESS = ("PROFIT", "LOSS", "BREAKEVEN"), ("COMPLETE", "PARTIAL")


def one_of(name: str, value: str | None, allowed: tuple[str, ...]) -> str | None:
    if value is not None and value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}")
    return value


def page_of(rows: DataFrame, order: list[Column | str], number: int, size: int, most: int) -> DataFrame:
    """A page of rows with `total`, the number of all; pages count from 1."""
    if number < 1 or not 1 <= size <= most:
        raise ValueError(f"pages count from 1 and hold 1 to {most} rows")
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    return rows.orderBy(*order).offset((number - 1) * size).limit(size).withColumn("total", total)


def snapshot_page(snapshots: DataFrame, accounts: DataFrame, exchange: str | None = None, account_id: int | None = None, symbol: str | None = None, start: datetime | None = None, end: datetime | None = None, number: int = 1, size: int = 100) -> DataFrame:
    """Position snapshots (account_id, snapshot_id, symbol, recorded_at, ...) of active accounts, the newest first."""
    rows = snapshots.join(accounts.filter("is_active").select("account_id", "exchange"), "account_id")
    tests = [
        None if exchange is None else F.col("exchange") == exchange.upper(),
        None if account_id is None else F.col("account_id") == account_id,
        None if symbol is None else F.col("symbol").ilike(f"%{symbol}%"),
        None if start is None else F.col("recorded_at") >= F.lit(start).cast("timestamp_ntz"),
        None if end is None else F.col("recorded_at") <= F.lit(end).cast("timestamp_ntz"),
    ]
    for test in tests:
        rows = rows if test is None else rows.filter(test)
    return page_of(rows, [F.desc("recorded_at"), "snapshot_id"], number, size, SNAPSHOT_ROWS)


def history_page(positions: DataFrame, order: list[str], result: str | None = None, completeness: str | None = None, period_id: int | None = None, number: int = 1, size: int = 50, **filters) -> DataFrame:
    """Closed positions under the filters of trades.filtered, and of the period and completeness of their records, the
    last closed first; `order` settles ties."""
    one_of("result", result, RESULTS)
    one_of("completeness", completeness, COMPLETENESS)
    rows = trades.filtered(positions, result=result, **filters)
    if completeness is not None:
        rows = rows.filter(F.col("data_completeness") == completeness)
    if period_id is not None:
        rows = rows.filter(F.col("tracking_period_id") == period_id)
    return page_of(rows, [F.desc("close_time"), *order], number, size, HISTORY_ROWS)
