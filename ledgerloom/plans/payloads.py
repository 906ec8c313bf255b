"""Queries of venue payloads: events and line items stand for what venues send, as text and epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import incremental
from ..sources import venue_states, venues, views
from .queries import query

#: Prices that stand for tickers.
TICKERS = (("BNBUSDT", "300"), ("ETHUSDT", "2000.5"), ("BADUSDT", ""))
COINS = ("BNB", "USDT", "ETH", "XYZ")


def _pick(values: tuple, by: str) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.expr(f"int({by} % {len(values)})"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    """account_id, event_id, kind, coin, amount (signed text), size (text without sign), ms."""
    money = F.col("value").cast("decimal(18,2)")
    signed = F.concat(F.when(F.expr("event_id % 3 = 0"), "-").otherwise(""), money.cast("string"))
    return views.read(spark, d, "events").select(
        F.col("user_id").alias("account_id"),
        "event_id",
        F.col("event_type").alias("kind"),
        _pick(COINS, "event_id").alias("coin"),
        signed.alias("amount"),
        money.cast("string").alias("size"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
    )


def _day() -> Column:
    """What a payload is sent for: no row holds more than an account's events of one day."""
    return (F.col("ms") / 86_400_000).cast("long").alias("day")


def _prices(spark: SparkSession, symbol: str, price: str) -> DataFrame:
    return spark.createDataFrame(list(TICKERS), f"{symbol} string, {price} string")


def _every(n: int, value: Column | str) -> Column:
    return F.when(F.col("event_id") % n == 0, value if isinstance(value, Column) else F.lit(value))


def _balances(spark: SparkSession, d: str) -> DataFrame:
    raw = _events(spark, d).select(
        "account_id",
        "event_id",
        F.col("coin").alias("asset"),
        F.col("size").alias("available"),
        F.coalesce(_every(5, "1.5"), F.lit("")).alias("locked"),
    )
    return raw


@query
def venue_valued_balances(spark: SparkSession, d: str) -> DataFrame:
    valued = venues.valued_balances(_balances(spark, d), _prices(spark, "symbol", "price").filter("price != ''"))
    return valued.groupBy("asset", "price_source").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.round(c, 4).cast("decimal(28,4)")).cast("double").alias(c) for c in ("available", "locked", "value_usd")],
    )


@query
def venue_account_summary(spark: SparkSession, d: str) -> DataFrame:
    summed = venues.account_summary(venues.valued_balances(_balances(spark, d), _prices(spark, "symbol", "price").filter("price != ''")))
    return summed.select("account_id", F.round("total_equity_usd", 3).alias("total_equity_usd"), "unvalued_asset_count")


@query
def venue_open_positions(spark: SparkSession, d: str) -> DataFrame:
    raw = _events(spark, d).select(
        "account_id",
        F.concat("coin", F.lit("USDT")).alias("symbol"),
        F.when(F.col("event_id") % 7 == 0, "0.000").otherwise(F.col("amount")).alias("positionAmt"),
        F.lit("2.5").alias("entryPrice"),
        F.lit("3").alias("markPrice"),
        (F.col("event_id") % 20).cast("string").alias("leverage"),
        F.col("amount").alias("unRealizedProfit"),
        F.lit("cross").alias("marginType"),
    )
    return venues.open_positions(raw)


@query
def venue_contract_positions(spark: SparkSession, d: str) -> DataFrame:
    raw = _events(spark, d).select(
        "account_id",
        _every(2, F.concat(F.lit("p"), "event_id")).alias("posId"),
        F.concat("coin", F.lit("-USDT-SWAP")).alias("instId"),
        F.when(F.col("event_id") % 4 == 0, "long").when(F.col("event_id") % 4 == 1, "short").otherwise("net").alias("posSide"),
        F.col("amount").alias("pos"),
        F.lit("4").alias("markPx"),
        F.lit("5").alias("avgPx"),
        F.lit("10").alias("lever"),
        F.coalesce(_every(3, "100"), F.lit("")).alias("notionalUsd"),
        F.coalesce(_every(6, "7"), F.lit("")).alias("margin"),
        F.lit("0").alias("liqPx"),
        F.lit("isolated").alias("mgnMode"),
        F.col("amount").alias("upl"),
    )
    return venue_states.contract_positions(raw)


@query
def venue_closed_history(spark: SparkSession, d: str) -> DataFrame:
    """Each position id with several states, of which the last counts."""
    raw = _events(spark, d).select(
        "account_id",
        F.expr("string(event_id div 3)").alias("posId"),
        F.lit("BTC-USDT-SWAP").alias("instId"),
        F.when(F.expr("event_id div 3 % 2 = 0"), "long").otherwise("short").alias("direction"),
        F.lit("10").alias("openAvgPx"),
        F.lit("11").alias("closeAvgPx"),
        F.col("size").alias("openMaxPos"),
        F.col("amount").alias("pnl"),
        F.lit("-0.5").alias("fee"),
        F.lit("0.25").alias("fundingFee"),
        F.col("amount").alias("realizedPnl"),
        F.lit("0.1").alias("pnlRatio"),
        F.expr("event_id div 3 * 1000").alias("cTime"),
        (F.col("event_id") * 1000).alias("uTime"),
    )
    return venues.closed_from_history(raw)


@query
def venue_product_positions(spark: SparkSession, d: str) -> DataFrame:
    raw = _events(spark, d).select(
        "account_id",
        F.when(F.col("event_id") % 2 == 0, "USDT-FUTURES").otherwise("USDC-FUTURES").alias("productType"),
        F.concat("coin", F.lit("USDT")).alias("symbol"),
        F.when(F.col("event_id") % 3 == 0, "short").otherwise("long").alias("holdSide"),
        F.when(F.col("event_id") % 5 == 0, "0").otherwise(F.col("size")).alias("total"),
        F.lit("2").alias("markPrice"),
        F.lit("1.5").alias("openPriceAvg"),
        F.when(F.col("event_id") % 4 == 0, "0").otherwise("1").alias("liquidationPrice"),
        F.lit("3").alias("leverage"),
        F.lit("crossed").alias("marginMode"),
        F.lit("9").alias("marginSize"),
        F.col("amount").alias("unrealizedPL"),
    )
    return venue_states.product_positions(raw)


def _bills(spark: SparkSession, d: str) -> DataFrame:
    names = {"purchase": "close_long", "view": "contract_settle_fee", "signup": "TRANS_FROM_OTC", "error": "trans_to_cross", "click": "open_long"}
    kind = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("kind")]
    return _events(spark, d).select(
        "account_id",
        F.concat(F.lit("b"), "event_id").alias("billId"),
        F.when(F.col("event_id") % 10 == 0, "BTC").when(F.col("event_id") % 10 == 1, "").otherwise("usdt").alias("coin"),
        "amount",
        F.coalesce(_every(4, "0.75"), F.lit("0")).alias("fee"),
        kind.alias("businessType"),
        F.col("ms").alias("cTime"),
    )


@query
def venue_business_records(spark: SparkSession, d: str) -> DataFrame:
    return venues.business_records(_bills(spark, d))


@query
def venue_business_complete(spark: SparkSession, d: str) -> DataFrame:
    return venues.business_complete(_bills(spark, d))


@query
def venue_closed_orders(spark: SparkSession, d: str) -> DataFrame:
    raw = _events(spark, d).select(
        "account_id",
        F.col("event_id").cast("string").alias("orderId"),
        F.lit("ETHUSDC").alias("symbol"),
        F.when(F.col("event_id") % 2 == 0, "Sell").otherwise("Buy").alias("side"),
        F.lit("4").alias("closedSize"),
        F.lit("10").alias("avgEntryPrice"),
        F.lit("12.5").alias("avgExitPrice"),
        F.col("amount").alias("closedPnl"),
        F.lit("0.5").alias("openFee"),
        F.lit("-0.25").alias("closeFee"),
        F.when(F.col("event_id") % 3 == 0, "0").otherwise("8").alias("leverage"),
        (F.col("ms") - 1000).alias("createdTime"),
        F.col("ms").alias("updatedTime"),
    )
    return venues.closed_from_orders(raw)


@query
def venue_wallet_updates(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("kind") == "signup", "deposit").when(F.col("kind") == "error", "withdraw").otherwise("send")
    own, other = F.lit("0xABC"), F.lit("0xdef")
    outgoing = F.col("event_id") % 2 == 0
    delta = F.struct(
        kind.alias("type"),
        F.when(outgoing, own).otherwise(other).alias("user"),
        F.when(outgoing, other).otherwise(F.when(F.col("kind") == "click", F.lit("0x0")).otherwise(own)).alias("destination"),
        F.col("amount").alias("amount"),
        _every(3, F.col("size")).alias("usdc"),
    )
    raw = _events(spark, d).select("account_id", F.concat(F.lit("h"), "event_id").alias("hash"), F.col("ms").alias("time"), delta.alias("delta"))
    return venues.wallet_updates(raw, own)


@query
def venue_perp_positions(spark: SparkSession, d: str) -> DataFrame:
    """One state of each account and day, as a venue sends it, its events as positions in a nested list."""
    position = F.struct(
        F.concat(F.when(F.col("event_id") % 2 == 0, "xyz:").otherwise(""), "coin").alias("coin"),
        F.when(F.col("event_id") % 9 == 0, "0").otherwise(F.col("amount")).alias("szi"),
        F.lit("3").alias("entryPx"),
        F.lit("-50").alias("positionValue"),
        F.lit("").alias("liquidationPx"),
        F.lit("6").alias("marginUsed"),
        F.col("amount").alias("unrealizedPnl"),
        F.struct(F.when(F.col("event_id") % 4 == 0, "cross").otherwise("isolated").alias("type"), F.lit("5").alias("value")).alias("leverage"),
    )
    states = _events(spark, d).groupBy("account_id", _day()).agg(F.collect_list(F.struct(position.alias("position"))).alias("positions"))
    return venue_states.perp_positions(states)


@query
def venue_token_balances(spark: SparkSession, d: str) -> DataFrame:
    raw = _events(spark, d).select(
        "account_id",
        F.when(F.col("coin") != "USDT", F.expr("int(event_id % 4)")).alias("token"),
        "coin",
        F.when(F.col("event_id") % 6 == 0, "0").otherwise(F.col("size")).alias("total"),
        F.lit("0").alias("hold"),
    )
    prices = spark.createDataFrame([(2, 2000.5)], "token int, price double")
    out = venue_states.spot_balances(raw, prices)
    return out.groupBy("asset", "price_source").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.round(c, 4).cast("decimal(28,4)")).cast("double").alias(c) for c in ("available", "locked", "value_usd")],
    )


def _coins(spark: SparkSession, d: str) -> DataFrame:
    """One wallet of each account and day with its events as a list of coins."""
    c = F.struct(
        F.when(F.col("event_id") % 8 == 1, "").otherwise(F.lower("coin")).alias("coin"),
        F.col("size").alias("walletBalance"),
        F.lit("1").alias("locked"),
        F.lit("0.5").alias("totalOrderIM"),
        F.lit("").alias("totalPositionIM"),
        F.when(F.col("event_id") % 3 == 0, " ").otherwise(F.col("size")).alias("usdValue"),
    )
    return _events(spark, d).groupBy("account_id", _day()).agg(F.collect_list(c).alias("coins")).withColumns({"totalEquity": F.lit("12.5"), "totalAvailableBalance": F.lit("3"), "totalInitialMargin": F.lit(""), "totalPerpUPL": F.lit("-1")})


@query
def venue_wallet_balances(spark: SparkSession, d: str) -> DataFrame:
    return venue_states.wallet_balances(_coins(spark, d))


@query
def venue_wallet_summary(spark: SparkSession, d: str) -> DataFrame:
    return venue_states.wallet_summary(_coins(spark, d))


@query
def venue_detail_balances(spark: SparkSession, d: str) -> DataFrame:
    detail = F.struct(
        F.col("coin").alias("ccy"),
        F.lit("2").alias("availEq"),
        F.col("size").alias("availBal"),
        F.lit("0.25").alias("frozenBal"),
        F.col("amount").alias("upl"),
        F.col("size").alias("eqUsd"),
    )
    wallets = _events(spark, d).groupBy("account_id", _day()).agg(F.collect_list(detail).alias("details"))
    return venue_states.detail_balances(wallets)


@query
def venue_spot_holdings(spark: SparkSession, d: str) -> DataFrame:
    raw = _events(spark, d).select(
        "account_id",
        F.lower("coin").alias("coin"),
        F.col("size").alias("available"),
        F.lit("1").alias("frozen"),
        F.lit("").alias("locked"),
        F.coalesce(_every(5, F.lit("40")), F.lit("")).alias("usdtValue"),
    )
    out = venue_states.spot_holdings(raw, _prices(spark, "symbol", "lastPr"))
    return out.groupBy("asset", "price_source").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("price_usd").alias("priced"),
        *[F.sum(F.round(c, 4).cast("decimal(28,4)")).cast("double").alias(c) for c in ("available", "locked", "value_usd")],
    )


@query
def venue_predictions(spark: SparkSession, d: str) -> DataFrame:
    raw = _events(spark, d).select(
        "account_id",
        _every(2, F.concat(F.lit("asset-number-"), "event_id")).alias("asset"),
        F.concat(F.lit("0xcondition-of-market-"), "event_id").alias("conditionId"),
        F.expr("int(event_id % 2)").alias("outcomeIndex"),
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit(" Will it happen "), F.repeat(F.lit("again "), F.expr("int(event_id % 20)")))).alias("title"),
        _every(5, "Yes").alias("outcome"),
        F.when(F.col("event_id") % 7 == 0, "0").otherwise(F.col("size")).alias("size"),
        F.col("size").alias("currentValue"),
        F.lit("0.5").alias("avgPrice"),
        F.lit("0.75").alias("curPrice"),
        F.lit("3").alias("initialValue"),
        F.col("amount").alias("cashPnl"),
        F.lit("").alias("realizedPnl"),
    )
    return venue_states.prediction_positions(raw).drop("open_time")


@query
def closed_identity_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Stored rows under ids of former times, incoming ones for some of them under those of today."""
    line = views.read(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("account_id"),
        F.expr("l_orderkey % 500").alias("a"),
        F.expr("l_partkey % 20").alias("b"),
        F.col("l_linenumber").cast("string").alias("n"),
        F.col("l_shipdate").alias("close_time"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("net_pnl"),
    )
    stored = line.select(
        "account_id",
        F.concat_ws(
            ":",
            F.when(F.expr("a % 2 = 0"), "okx").otherwise("bitget"),
            "a",
            F.when(F.expr("a % 2 = 1 and b = 3"), "symbol").otherwise(F.col("b").cast("string")),
            "n",
        ).alias("source_record_id"),
        "close_time",
        "net_pnl",
    )
    fresh = line.filter("b < 5 and a % 2 = 0").select(
        "account_id",
        F.concat_ws(":", F.lit("okx"), "a", "b").alias("source_record_id"),
        "close_time",
        (F.col("net_pnl") + 1).cast("decimal(18,2)").alias("net_pnl"),
    )
    out = incremental.upserted_closed(stored, fresh, ["close_time", "net_pnl"])
    return out.withColumn("net_pnl", F.col("net_pnl").cast("double"))


@query
def pnl_model_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A model of three exchanges, stored again when one of them is gone and another has come."""
    rows = views.accounts(spark, d).groupBy("exchange").agg(F.sum("initial_equity").cast("double").alias("total"), F.count(F.lit(1)).alias("version"))
    stored = rows.filter("exchange in ('ASIA', 'EUROPE', 'AFRICA')")
    incoming = rows.filter("exchange in ('ASIA', 'AMERICA', 'AFRICA')").withColumn("total", F.col("total") + 1)
    return incremental.upserted_present(stored, incoming, ["exchange"], ["version"], "exchange")


@query
def oldest_streams(spark: SparkSession, d: str) -> DataFrame:
    """Two streams of each active account: one with a time of its own for some, one with what is no time for others."""
    accounts = views.accounts(spark, d).filter("is_active")
    at = F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, int(account_id % 1000), 0)")
    details = F.map_from_entries(F.array(F.struct(F.lit("last_balance_sync_at").alias("key"), F.when(F.col("account_id") % 2 == 0, "2023-12-31T23:59:00").alias("value")), F.struct(F.lit("last_position_sync_at").alias("key"), F.lit("soon").alias("value"))))
    return incremental.oldest_streams(
        accounts.withColumns({"last_synced_at": at, "details": details}),
        {"last_updated_at": "last_balance_sync_at", "positions_updated_at": "last_position_sync_at"},
    )


@query
def accounts_in_order(spark: SparkSession, d: str) -> DataFrame:
    """As the pages list them: demo accounts first, then by when they were made, with their place."""
    made = F.date_add(F.lit("2024-01-01").cast("date"), F.expr("int(account_id % 97)"))
    rows = views.accounts(spark, d).withColumns({"is_demo": F.col("account_id") % 10 == 0, "created_at": made})
    return views.in_order(rows).select("place", "account_id", "is_demo", "created_at", "exchange").orderBy("place")
