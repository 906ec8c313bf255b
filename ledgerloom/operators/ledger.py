"""The signed ledger: four record frames as one, its filters, pages, totals and daily pre-aggregate."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import is_day_aligned, reporting_day

#: Record types, those that take money out, and what the filter CASH_FLOW stands for.
TYPES = ("REALIZED_PNL", "FUNDING_FEE", "TRADING_FEE", "DEPOSIT", "WITHDRAWAL")
OUTGOING = ("WITHDRAW", "WITHDRAWAL")
CASH_FLOW = ("DEPOSIT", "WITHDRAW", "WITHDRAWAL")
_COLUMNS = ("record_id", "account_id", "record_time", "record_type", "amount_usd", "signed_amount_usd")


def union(income: DataFrame, funding: DataFrame, fees: DataFrame, cash: DataFrame) -> DataFrame:
    """All records with aligned columns; fees and withdrawals are negative in signed_amount_usd."""
    amount = F.col("amount_usd")

    def aligned(part: DataFrame, kind: Column, signed: Column) -> DataFrame:
        return part.select("record_id", "account_id", "record_time", kind.alias("record_type"), amount, signed.cast("decimal(19,2)").alias("signed_amount_usd"))

    flow = F.upper("flow_type")
    out = F.when(flow.isin(*OUTGOING), -amount).otherwise(amount)
    return (
        aligned(income, F.lit("REALIZED_PNL"), amount)
        .unionByName(aligned(funding, F.lit("FUNDING_FEE"), amount))
        .unionByName(aligned(fees, F.lit("TRADING_FEE"), -amount))
        .unionByName(aligned(cash, flow, out))
    )


def filtered(
    ledger: DataFrame,
    accounts: DataFrame,
    exchange: str | None = None,
    account_id: int | None = None,
    record_type: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """Records of active accounts with exchange and connection name, under the filters that are given."""
    active = accounts.filter("is_active").select("account_id", "exchange", "connection_name")
    out = ledger.join(active, "account_id")
    if exchange is not None:
        out = out.filter(F.col("exchange") == exchange.upper())
    if account_id is not None:
        out = out.filter(F.col("account_id") == account_id)
    if record_type is not None:
        kind = record_type.upper()
        wanted = {"CASH_FLOW": CASH_FLOW, "WITHDRAWAL": OUTGOING}.get(kind, (kind,))
        out = out.filter(F.col("record_type").isin(*wanted))
    if start is not None:
        out = out.filter(F.col("record_time") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out.filter(F.col("record_time") <= F.lit(end).cast("timestamp_ntz"))
    return out


def page(records: DataFrame, number: int, size: int) -> DataFrame:
    """Newest first; records of one moment by id."""
    if number < 1 or not 1 <= size <= 500:
        raise ValueError("pages count from 1 and hold 1 to 500 records")
    return records.orderBy(F.desc("record_time"), "record_id").offset((number - 1) * size).limit(size)


def _sum_of(kinds: tuple[str, ...], amount: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("record_type").isin(*kinds), F.col(amount))), F.lit(0))


def _derived(totals: DataFrame) -> DataFrame:
    cash = F.col("deposits") - F.col("withdrawals")
    realized = F.col("realized_pnl") + F.col("funding_fee") - F.col("trading_fee")
    named = totals.withColumn("net_cash_flow", cash).withColumn("net_realized", realized).withColumn("net_effect", realized + cash)
    return named.select(*[F.col(c).cast("double").alias(c) for c in ("realized_pnl", "funding_fee", "trading_fee", "deposits", "withdrawals", "net_cash_flow", "net_realized", "net_effect")])


def summary(records: DataFrame, closed: DataFrame, record_type: str | None = None) -> DataFrame:
    """One row of eight totals. Realized PnL comes from closed positions under the same filters (`closed`), or
    is 0 when records of another type were asked for."""
    totals = records.agg(
        _sum_of(("FUNDING_FEE",), "amount_usd").alias("funding_fee"),
        _sum_of(("TRADING_FEE",), "amount_usd").alias("trading_fee"),
        F.coalesce(F.sum(F.when(F.col("record_type").isin("DEPOSIT"), F.col("amount_usd"))), F.lit(0)).alias("deposits"),
        _sum_of(OUTGOING, "amount_usd").alias("withdrawals"),
    )
    asked = record_type is None or record_type.upper() == "REALIZED_PNL"
    realized = closed.agg(F.coalesce(F.sum("realized_pnl"), F.lit(0))).scalar() if asked else F.lit(0)
    return _derived(totals.withColumn("realized_pnl", realized))


def daily(ledger: DataFrame, closed: DataFrame, accounts: DataFrame) -> DataFrame:
    """Per exchange, account, reporting day and record type: amount and count; realized PnL from closed positions.

    WITHDRAW is WITHDRAWAL here, so cash of one day is one row a type."""
    kind = F.when(F.col("record_type").isin(*OUTGOING), "WITHDRAWAL").otherwise(F.col("record_type"))
    records = ledger.filter("record_type != 'REALIZED_PNL'").select(
        "account_id",
        reporting_day(F.col("record_time")).alias("record_date"),
        kind.alias("record_type"),
        F.col("amount_usd").cast("decimal(24,4)").alias("amount_usd"),
    )
    realized = closed.select(
        "account_id",
        reporting_day(F.col("close_time")).alias("record_date"),
        F.lit("REALIZED_PNL").alias("record_type"),
        F.col("realized_pnl").cast("decimal(24,4)").alias("amount_usd"),
    )
    # Summed before the join, so the join carries one row for each account, day and type.
    summed = records.unionByName(realized).groupBy("account_id", "record_date", "record_type").agg(
        F.sum("amount_usd").alias("amount_usd"),
        F.count(F.lit(1)).alias("record_count"),
    )
    return summed.join(accounts.filter("is_active").select("account_id", "exchange"), "account_id").select(
        "exchange",
        "account_id",
        "record_date",
        "record_type",
        "amount_usd",
        "record_count",
    )


def daily_summary(preagg: DataFrame, first_day: Column | None = None, last_day: Column | None = None) -> DataFrame:
    """The eight totals from the pre-aggregate, for whole reporting days."""
    held = preagg
    if first_day is not None:
        held = held.filter(F.col("record_date") >= first_day)
    if last_day is not None:
        held = held.filter(F.col("record_date") <= last_day)
    return _derived(
        held.agg(
            _sum_of(("REALIZED_PNL",), "amount_usd").alias("realized_pnl"),
            _sum_of(("FUNDING_FEE",), "amount_usd").alias("funding_fee"),
            _sum_of(("TRADING_FEE",), "amount_usd").alias("trading_fee"),
            _sum_of(("DEPOSIT",), "amount_usd").alias("deposits"),
            _sum_of(OUTGOING, "amount_usd").alias("withdrawals"),
        )
    )


def routed_summary(preagg: DataFrame | None, records: DataFrame, closed: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    """The pre-aggregate answers where there is one and the range is of whole reporting days (or open), else the records."""
    if preagg is None or not is_day_aligned(start, end):
        return summary(records, closed)
    day = lambda moment: None if moment is None else reporting_day(F.lit(moment).cast("timestamp_ntz"))
    return daily_summary(preagg, day(start), day(end))


def activity(ledger: DataFrame) -> DataFrame:
    """Per account and record type: number of records and the latest."""
    return ledger.groupBy("account_id", "record_type").agg(F.count(F.lit(1)).alias("records"), F.max("record_time").alias("latest"))
