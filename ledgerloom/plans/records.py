"""Queries of raw JSON payloads, pages, rates, retention and repairs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import reporting_day
from ..operators import balances, cycles, ledger, pages, quality, rates, reconcile
from ..sources import venue_states, venues, views
from ..sources.commits import VersionedTable
from ..sources.migrations import rebuild_calendar
from ..sources.payload_json import accepted, read_payloads, rejects
from ..sources.shared import fresh_path, staged
from .payloads import _events
from .queries import KEYS, NOW, _active_trades, query

#: Fields of a closed position's payload: all text, as the venue sends it, but for the times.
_CLOSED = {name: (f"$.{name}", "string") for name in "productType positionId symbol holdSide openAvgPrice closeAvgPrice openTotalPos closeTotalPos pnl netProfit totalFunding openFee closeFee".split()} | {"ctime": ("$.times.ctime", "bigint"), "utime": ("$.times.utime", "bigint")}
_RANGE = (datetime(2024, 1, 2), datetime(2024, 1, 29))


def _at(moment: datetime) -> Column:
    return F.lit(moment).cast("timestamp_ntz")


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    """account_id, event_id, payload: events as JSON text of closed positions, two states of each, some of it broken."""
    e = F.col("event_id")
    fields = F.struct(
        F.when(F.col("account_id") % 2 == 0, "USDT-FUTURES").otherwise("USDC-FUTURES").alias("productType"),
        F.when(e % 6 == 5, "").otherwise(F.concat(F.lit("p"), F.expr("event_id div 2"))).alias("positionId"),
        F.when(e % 44 != 3, F.concat("coin", F.lit("USDT"))).alias("symbol"),
        F.when(F.expr("event_id div 2 % 2 = 0"), "long").otherwise("short").alias("holdSide"),
        F.lit("10").alias("openAvgPrice"),
        F.lit("11").alias("closeAvgPrice"),
        F.when(e % 5 == 0, "").otherwise(F.col("size")).alias("openTotalPos"),
        F.lit("4").alias("closeTotalPos"),
        F.col("amount").alias("pnl"),
        F.when(e % 4 == 0, F.col("amount")).otherwise("").alias("netProfit"),
        F.lit("0.25").alias("totalFunding"),
        F.lit("-0.5").alias("openFee"),
        F.lit("-0.25").alias("closeFee"),
        F.struct(F.when(e % 7 == 0, F.lit(0).cast("long")).otherwise(F.col("ms") - 3_600_000).cast("string").alias("ctime"), F.when(e % 46 == 2, "soon").otherwise(F.col("ms").cast("string")).alias("utime")).alias("times"),
    )
    text = F.to_json(fields)
    payload = F.when(e % 40 == 0, F.substring(text, 1, 30)).when(e % 41 == 0, F.concat(F.lit("["), text, F.lit("]"))).when(e % 43 == 0, "").when(e % 47 != 0, text)
    return _events(spark, d).select("account_id", "event_id", payload.alias("payload"))


def _read(spark: SparkSession, d: str) -> DataFrame:
    """Read once and written, whatever is asked of it then."""
    return staged(read_payloads(_payloads(spark, d), "payload", _CLOSED, required=["productType", "symbol", "utime"]), fresh_path(spark, "payloads"))


@query
def payload_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Payloads that were not taken, by what is wrong with them."""
    return rejects(_read(spark, d), "payload", ["event_id"]).groupBy("reject").agg(F.count(F.lit(1)).alias("payloads"), F.min("event_id").alias("first_id"))


@query
def venue_closed_products(spark: SparkSession, d: str) -> DataFrame:
    """Closed positions from JSON, the last state of each, with the leverage of the orders that opened them."""
    raw = accepted(_read(spark, d), "payload").withColumns({c: F.col(c).cast("string") for c in ("ctime", "utime")})
    orders = _events(spark, d).select(
        "account_id",
        F.when(F.col("account_id") % 2 == 0, "USDT-FUTURES").otherwise("USDC-FUTURES").alias("productType"),
        F.concat("coin", F.lit("USDT")).alias("symbol"),
        F.when(F.col("event_id") % 3 == 0, "net").when(F.expr("event_id div 2 % 2 = 0"), "long").otherwise("short").alias("posSide"),
        F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"),
        F.when(F.col("event_id") % 5 == 1, "close").otherwise("open").alias("tradeSide"),
        F.lit("YES").alias("reduceOnly"),
        F.when(F.col("account_id") % 3 == 0, "12.5").otherwise(F.concat((F.col("event_id") % 2 * 5).cast("string"))).alias("leverage"),
        F.col("ms").alias("cTime"),
    )
    out = venues.closed_products(raw, orders, *map(_at, _RANGE))
    return out.withColumns({c: F.round(c, 6) for c in ("margin_used", "return_percent", "net_pnl", "trading_fee")})


@query
def venue_combos(spark: SparkSession, d: str) -> DataFrame:
    """Combined bets still held: an order's lines as the legs of one, at quarters, whose products are exact in any order."""
    status = F.when(F.col("l_linestatus") == "F", "RESOLVED_WIN").otherwise("OPEN")
    leg = F.struct(F.col("l_linenumber").alias("n"), status.alias("status"), (F.col("l_partkey") % 4 / 4).alias("leg_current_price"), F.struct(F.concat(F.lit("M"), "l_partkey").alias("title"), F.lit("x").alias("outcome")).alias("market"))
    legs = views.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(leg)).alias("legs"))  # an order has a few lines
    raw = legs.select(
        (F.col("l_orderkey") % 100).alias("account_id"),
        F.concat(F.lit("c"), "l_orderkey").alias("combo_position_id"),
        F.lit("cond").alias("combo_condition_id"),
        F.when(F.col("l_orderkey") % 3 == 0, "NO").otherwise("YES").alias("side"),
        (F.col("l_orderkey") % 5).cast("double").alias("shares_balance"),
        F.lit(0.5).alias("entry_avg_price_usdc"),
        F.lit(5.0).alias("gross_entry_cost_usdc"),
        F.lit(0.25).alias("entry_fees_usdc"),
        F.lit(None).cast("double").alias("realized_payout_usdc"),
        F.lit("2026-07-01T00:00:00Z").alias("first_entry_at"),
        F.lit(None).cast("string").alias("resolved_at"),
        F.transform("legs", lambda x: F.struct(x["status"].alias("status"), x["leg_current_price"].alias("leg_current_price"), x["market"].alias("market"))).alias("legs"),
    )
    return venue_states.combo_positions(raw).select("account_id", "source_record_id", "side", "position_value_usd", "mark_price")


@query
def venue_futures_holdings(spark: SparkSession, d: str) -> DataFrame:
    """Holdings of futures accounts, valued by the stated equity, at parity, or by a ticker."""
    raw = _events(spark, d).select(
        "account_id",
        F.lit("USDT_FUTURES").alias("account_type"),
        F.col("coin").alias("marginCoin"),
        F.col("size").alias("accountEquity"),
        F.lit("1").alias("available"),
        F.when(F.col("event_id") % 4 == 0, F.col("size")).otherwise("").alias("usdtEquity"),
        F.lit("0").alias("isolatedMargin"),
        F.lit("1").alias("crossedMargin"),
        F.col("amount").alias("unrealizedPL"),
    )
    tickers = spark.createDataFrame([("BNBUSDT", "300"), ("ETHUSDT", "2000.5"), ("BADUSDT", "")], "symbol string, lastPr string")
    out = venue_states.futures_holdings(raw, tickers)
    return out.groupBy("asset", "price_source").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.round(c, 4).cast("decimal(28,4)")).cast("double").alias(c) for c in ("available", "locked", "value_usd")])


@query
def converted_equity(spark: SparkSession, d: str) -> DataFrame:
    """Equity samples in another currency, by the rate quoted last: views are quotes of one currency, clicks of another
    from the tenth on; a third has none and a default, a fourth neither."""
    events = views.read(spark, d, "events")
    kind = F.col("event_type")
    quotes = events.filter((kind == "view") | (kind == "click") & (F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"))).select(F.when(kind == "view", "USD/CNY").otherwise("USD/EUR").alias("pair"), (6 + F.col("value") / 1000).alias("rate"), F.col("ts").alias("quoted_at"))
    pair = F.element_at(F.array(*map(F.lit, ("USD/CNY", "USD/EUR", "USD/JPY", "USD/XXX"))), (F.col("snapshot_id") % 4 + 1).cast("int"))
    amounts = views.balance_snapshots(spark, d).select("account_id", "snapshot_id", "equity", "recorded_at", pair.alias("pair"))
    out = rates.converted(amounts, quotes, "equity", "recorded_at", 300, {"USD/JPY": 150.0, "USD/EUR": 0.9})
    return out.select("snapshot_id", "pair", "rate", "rate_source", "converted")


@query
def snapshots_page(spark: SparkSession, d: str) -> DataFrame:
    """The third page of position snapshots of an exchange and a month, the newest first."""
    rows = views.closed_positions(spark, d).select("account_id", F.concat_ws("-", *KEYS).alias("snapshot_id"), "symbol", "side", "size", F.col("close_time").alias("recorded_at"))
    shown = pages.snapshot_page(rows, views.accounts(spark, d), exchange="asia", symbol="brand#2", start=datetime(1996, 1, 1), end=datetime(1997, 1, 1), number=3, size=40)
    return shown.select("snapshot_id", "account_id", "symbol", "side", F.col("size").cast("double").alias("size"), "recorded_at", "total")


@query
def history_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of losses with whole records, the last closed first."""
    rows = _active_trades(spark, d).withColumn("data_completeness", F.when(F.col("l_linenumber") % 2 == 0, "COMPLETE").otherwise("PARTIAL"))
    shown = pages.history_page(rows, [*KEYS, "account_id"], result="LOSS", completeness="COMPLETE", number=2, size=30, exchange="america")
    return shown.select("account_id", *KEYS, "close_time", F.col("net_pnl").cast("double").alias("net_pnl"), "total")


@query
def job_retention(spark: SparkSession, d: str) -> DataFrame:
    """Runs that retention of ten days takes away, by their state; those that are running stay."""
    gone = quality.expired_jobs(views.sync_jobs(spark, d), _at(NOW) - F.expr("INTERVAL 10 DAYS"))
    return gone.groupBy("status").agg(F.count(F.lit(1)).alias("jobs"), F.min("job_id").alias("first_id"), F.max("started_at").alias("latest_at"))


@query
def closed_quality_issues(spark: SparkSession, d: str) -> DataFrame:
    """Findings about closed positions: leverage that is not believed, returns that do not follow from the margin."""
    rows = views.closed_positions(spark, d).select(
        "account_id",
        "symbol",
        "side",
        (F.col("leverage") * 40 - 40).alias("leverage"),
        (F.col("value_usd") / F.col("leverage")).cast("decimal(18,2)").alias("margin_used"),
        "net_pnl",
        F.when(F.col("l_linenumber") == 3, F.lit(1.5)).otherwise(F.col("net_pnl").cast("double") / (F.col("value_usd") / F.col("leverage")).cast("decimal(18,2)").cast("double") * 100).alias("return_percent"),
    )
    found = quality.closed_position_issues(rows, ["symbol", "side"])
    return found.groupBy(*[c for c in ("code", "severity") if c in found.columns]).agg(F.count(F.lit(1)).alias("issues"))


@query
def calendar_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Daily rows under days of UTC, put under the reporting day once, and asked for once more; only days that rows have
    moved to have their funding reckoned anew."""
    records = ledger.union(**views.ledger_parts(spark, d))
    table = VersionedTable(spark, fresh_path(spark, "daily"), "account_id bigint, snapshot_date date, records bigint, funding_fee decimal(28,2), updated_at timestamp_ntz", ["account_id", "snapshot_date"], "snapshot_date")
    funding = F.coalesce(F.sum(F.when(F.col("record_type") == "FUNDING_FEE", F.col("amount_usd"))), F.lit(0)).cast("decimal(28,2)").alias("funding_fee")
    stored = records.groupBy("account_id", F.to_date("record_time").alias("snapshot_date")).agg(F.count(F.lit(1)).alias("records"), funding, F.max("record_time").alias("updated_at"))
    table.upsert(stored, ["updated_at"])
    days = records.groupBy("account_id", reporting_day(F.col("record_time")).alias("snapshot_date")).agg(funding)
    for _ in range(2):
        rebuild_calendar(table, reporting_day(F.col("updated_at")), ["records", "funding_fee"], lambda keys: days.join(keys, ["account_id", "snapshot_date"], "left_semi"))
    return table.read().select("account_id", "snapshot_date", "records", F.col("funding_fee").cast("double").alias("funding_fee"), "updated_at", F.lit(table.version()).cast("long").alias("version"))


@query
def reconciliation_unrealized(spark: SparkSession, d: str) -> DataFrame:
    """Reconciliation with the change of unrealised PnL from each account's first snapshot to its last."""
    snapshots = views.balance_snapshots(spark, d).select("account_id", F.date_trunc("hour", "recorded_at").cast("timestamp_ntz").alias("recorded_at"), F.col("equity").alias("unrealized_pnl"))
    accounts = views.accounts(spark, d)
    ends = balances.unrealized_ends(snapshots, accounts, _at(NOW))
    latest = balances.latest(views.balance_snapshots(spark, d), ["account_id"], ["recorded_at", "snapshot_id"])
    closed = views.active_positions(spark, d)
    out = reconcile.reconcile(accounts, latest, closed, ledger.union(**views.ledger_parts(spark, d)), ends)
    return out.select("account_id", *[F.round(c, 4).alias(c) for c in ("equity_return", "component_return", "variance")])


@query
def trade_cycles_stated(spark: SparkSession, d: str) -> DataFrame:
    """Cycles as closed positions by what fills state; those that paid fees in another coin have an inferred entry."""
    fills = views.fills(spark, d).withColumns({"realized_pnl": F.col("price") - 50, "fee_asset": F.when(F.col("fill_id") % 9 == 0, "BNB").otherwise("usdt")})
    return cycles.stated_cycles(fills)
