"""Raw venue payloads as canonical records: classification and sign rules as expressions over explicit schemas.

Payload columns hold numbers as text, as venues send them; what does not parse counts as 0, and a price that
is missing stays NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ratios import clamp, ratio
from ..functions.text import normalize_side, normalize_symbol
from ..operators.running import running_sums
from .shared import fresh_path, staged

#: Coins taken at parity, and per venue the bill types that make each kind of record.
PARITY = ("USDT", "USDC", "FDUSD", "BUSD", "USD")
INCOME_FEES = ("COMMISSION", "INSURANCE_CLEAR", "API_REBATE", "COMMISSION_REBATE", "REFERRAL_KICKBACK")
INCOME_TRANSFERS = ("TRANSFER", "INTERNAL_TRANSFER", "COIN_SWAP_DEPOSIT", "COIN_SWAP_WITHDRAW", "CROSS_COLLATERAL_TRANSFER")
FUNDING_SUBTYPES, INTERNAL_SUBTYPES = ("173", "174"), ("318", "319")
#: Business types that make records of realized PnL, funding, deposits and withdrawals, and their coins.
BUSINESS_REALIZED = (
    "close_long", "close_short", "force_close_long", "force_close_short", "force_buy", "force_sell", "burst_long_loss_query",
    "burst_short_loss_query", "burst_buy", "burst_sell", "delivery_long", "delivery_short", "tracking_trader_income",
)
BUSINESS_FUNDING = "contract_settle_fee"
BUSINESS_DEPOSITS = ("trans_from_exchange", "trans_from_contract", "trans_from_otc", "trans_from_cross", "trans_from_isolated")
BUSINESS_WITHDRAWALS = ("trans_to_exchange", "trans_to_contract", "trans_to_otc", "trans_to_cross", "trans_to_isolated")
BUSINESS_COINS = ("USD", "USDT", "USDC")


def number(column: str | Column) -> Column:
    """Text as double, 0 for NULL or what is no number."""
    text = F.col(column) if isinstance(column, str) else column
    # A cast reads nearly all of it, many times faster than a format; 0.0 is added so that -0 is 0.
    return F.coalesce(text.try_cast("double") + 0.0, F.try_to_number(text, F.lit("S99999999999999999999.999999999999")).cast("double"), F.lit(0.0))


def moment(ms: str | Column) -> Column:
    """Epoch milliseconds as timestamp without zone, in UTC."""
    return F.timestamp_millis((F.col(ms) if isinstance(ms, str) else ms).cast("long")).cast("timestamp_ntz")


def valued_balances(balances: DataFrame, prices: DataFrame, quote: str = "USDT") -> DataFrame:
    """Balances (asset, available, locked) valued by price of asset+quote, coins at parity at 1, NULL without a price."""
    quoted = prices.select(F.col("symbol").alias("__symbol"), number("price").alias("price"))
    joined = balances.join(quoted, F.concat("asset", F.lit(quote)) == F.col("__symbol"), "left").drop("__symbol")
    amount = number("available") + number("locked")
    parity = F.col("asset").isin(*PARITY)
    source = F.when(parity, "STABLECOIN_PARITY").when(F.col("price").isNotNull(), "EXCHANGE_PRICE").otherwise("UNAVAILABLE")
    return joined.select(
        "account_id",
        "asset",
        number("available").alias("available"),
        number("locked").alias("locked"),
        F.when(parity, amount).otherwise(amount * F.col("price")).alias("value_usd"),
        source.alias("price_source"),
    )


def account_summary(valued: DataFrame) -> DataFrame:
    """Equity and what has no value, per account."""
    held = (F.col("available") != 0) | (F.col("locked") != 0)
    return valued.groupBy("account_id").agg(
        F.sum("value_usd").alias("total_equity_usd"),
        F.count_if(F.col("value_usd").isNull() & held).alias("unvalued_asset_count"),
    )


def open_positions(raw: DataFrame) -> DataFrame:
    """Position risk rows (symbol, positionAmt, entryPrice, markPrice, leverage, unRealizedProfit, marginType) of a
    size other than 0; the side is the sign of the size."""
    size = number("positionAmt")
    return raw.filter(size != 0).select(
        "account_id",
        "symbol",
        normalize_symbol(F.col("symbol")).alias("normalized_symbol"),
        F.when(size > 0, "LONG").otherwise("SHORT").alias("side"),
        F.abs(size).alias("position_size"),
        number("entryPrice").alias("entry_price"),
        number("markPrice").alias("mark_price"),
        (F.abs(size) * number("markPrice")).alias("position_value_usd"),
        number("leverage").alias("leverage"),
        number("unRealizedProfit").alias("unrealized_pnl"),
    )


def income_records(raw: DataFrame) -> DataFrame:
    """Income rows (tranId, asset, income, incomeType, time) as ledger records.

    Fees are positive when paid; a transfer is a deposit or a withdrawal by its sign; types that are not known
    make no record. `supported` is false for known records in other than parity coins, which have no USD amount.
    """
    income, kind = number("income"), F.col("incomeType")
    record = F.when(kind == "REALIZED_PNL", "REALIZED_PNL").when(kind == "FUNDING_FEE", "FUNDING_FEE").when(kind.isin(*INCOME_FEES), "TRADING_FEE").when(
        kind.isin(*INCOME_TRANSFERS),
        F.when(income >= 0, "DEPOSIT").otherwise("WITHDRAWAL"),
    )
    amount = F.when(record == "TRADING_FEE", -income).when(record == "WITHDRAWAL", -income).otherwise(income)
    out = raw.withColumn("record_type", record).withColumn("amount_usd", amount).filter("record_type is not null")
    return out.select(
        "account_id",
        F.col("tranId").cast("string").alias("source_record_id"),
        "asset",
        moment("time").alias("record_time"),
        "record_type",
        "amount_usd",
        F.col("asset").isin(*PARITY).alias("supported"),
    )


def bill_records(raw: DataFrame) -> DataFrame:
    """Bills (billId, ccy, pnl, fee, balChg, subType, ts) as up to three records each: realized PnL, funding, fee;
    or a deposit or withdrawal for a bill of none that is not internal."""
    pnl, fee, change = number("pnl"), number("fee"), number("balChg")
    funding, internal = F.col("subType").isin(*FUNDING_SUBTYPES), F.col("subType").isin(*INTERNAL_SUBTYPES)
    entry = lambda suffix, kind, amount, when: F.when(
        when,
        F.struct(F.concat_ws(":", "billId", F.lit(suffix)).alias("source_record_id"), F.lit(kind).alias("record_type"), amount.alias("amount_usd")),
    )
    none = ~funding & (pnl == 0) & (fee == 0) & ~internal
    entries = F.array(
        entry("funding", "FUNDING_FEE", F.when(pnl != 0, pnl).otherwise(change), funding),
        entry("pnl", "REALIZED_PNL", pnl, ~funding & (pnl != 0)),
        entry("fee", "TRADING_FEE", -fee, ~funding & (fee != 0)),
        entry("deposit", "DEPOSIT", change, none & (change > 0)),
        entry("withdrawal", "WITHDRAWAL", -change, none & (change < 0)),
    )
    held = raw.select(
        "account_id",
        F.col("ccy").alias("asset"),
        moment("ts").alias("record_time"),
        F.explode(F.filter(entries, lambda x: x.isNotNull())).alias("x"),
    )
    return held.select("account_id", "asset", "record_time", "x.*")


def _business(raw: DataFrame) -> DataFrame:
    kind, amount, fee = F.lower(F.coalesce(F.nullif("businessType", F.lit("")), F.lit("unknown"))), number("amount"), number("fee")
    cash = kind.isin(*BUSINESS_DEPOSITS, *BUSINESS_WITHDRAWALS)
    entry = lambda suffix, name, value, when: F.when(
        when,
        F.struct(
            F.concat_ws(":", F.coalesce(F.nullif("billId", F.lit("")), F.col("cTime").cast("string")), F.lit(suffix)).alias("source_record_id"),
            name.alias("record_type"),
            value.alias("amount_usd"),
        ),
    )
    entries = F.array(
        entry("pnl", F.lit("REALIZED_PNL"), amount, kind.isin(*BUSINESS_REALIZED) & (amount != 0)),
        entry("funding", F.lit("FUNDING_FEE"), amount, (kind == BUSINESS_FUNDING) & (amount != 0)),
        entry("fee", F.lit("TRADING_FEE"), -fee, fee != 0),
        entry("cash", F.when(kind.isin(*BUSINESS_DEPOSITS), "DEPOSIT").otherwise("WITHDRAWAL"), F.abs(amount), cash & (amount != 0)),
    )
    asset = F.upper(F.coalesce(F.nullif("coin", F.lit("")), F.lit("USD")))
    rows = raw.withColumns({"asset": asset, "entries": F.filter(entries, lambda x: x.isNotNull())})
    return rows.withColumn("told", F.col("asset").isin(*BUSINESS_COINS) & ((amount == 0) | (F.size("entries") > 0)))


def business_records(raw: DataFrame) -> DataFrame:
    """Bills (billId, coin, amount, fee, businessType, cTime) in dollar coins as up to two records each: realized PnL,
    funding or a cash flow by the business type, and a fee."""
    held = _business(raw).filter(F.col("asset").isin(*BUSINESS_COINS))
    return held.select(
        "account_id",
        "asset",
        moment("cTime").alias("record_time"),
        F.explode("entries").alias("x"),
    ).select("account_id", "asset", "record_time", "x.*")


def business_complete(raw: DataFrame) -> DataFrame:
    """Per account whether records tell all of its bills: none in other coins, and none of an unknown type."""
    return _business(raw).groupBy("account_id").agg(F.bool_and("told").alias("complete"))


def latest_states(raw: DataFrame, key: list[str], updated: str) -> DataFrame:
    """The last state of each position id, by its update time in milliseconds."""
    others = [c for c in raw.columns if c not in key]
    return raw.groupBy(*key).agg(F.max_by(F.struct(*others), number(updated)).alias("x")).select(*key, "x.*")


def closed_from_history(raw: DataFrame) -> DataFrame:
    """Position history (posId, instId, direction, openAvgPx, closeAvgPx, openMaxPos, pnl, fee, fundingFee,
    realizedPnl, pnlRatio, cTime, uTime): one row per position, margin from PnL over its ratio."""
    last = latest_states(raw, ["account_id", "posId", "cTime"], "uTime")
    return last.select(
        "account_id",
        F.concat_ws(":", F.lit("okx"), "posId", "cTime").alias("source_record_id"),
        F.col("instId").alias("symbol"),
        normalize_symbol(F.col("instId")).alias("normalized_symbol"),
        normalize_side(F.col("direction")).alias("side"),
        moment("cTime").alias("open_time"),
        moment("uTime").alias("close_time"),
        number("openAvgPx").alias("average_entry_price"),
        number("closeAvgPx").alias("average_exit_price"),
        number("openMaxPos").alias("max_position_size"),
        number("pnl").alias("realized_pnl"),
        number("fundingFee").alias("funding_fee"),
        (-number("fee")).alias("trading_fee"),
        number("realizedPnl").alias("net_pnl"),
        F.abs(ratio(number("realizedPnl"), number("pnlRatio"))).alias("margin_used"),
    )


def closed_from_orders(raw: DataFrame) -> DataFrame:
    """Closed PnL rows (orderId, symbol, side, closedSize, avgEntryPrice, avgExitPrice, closedPnl, openFee, closeFee,
    leverage, createdTime, updatedTime). The order closes, so the position had the other side; gross comes from
    prices, and funding is what net, gross and fees leave."""
    size, entry, exit_ = number("closedSize"), number("avgEntryPrice"), number("avgExitPrice")
    long = F.lower("side") == "sell"
    gross = (exit_ - entry) * size * F.when(long, 1.0).otherwise(-1.0)
    fees = F.abs(number("openFee")) + F.abs(number("closeFee"))
    net = number("closedPnl")
    margin = ratio(entry * size, F.when(number("leverage") > 0, number("leverage")))
    return raw.select(
        "account_id",
        F.col("orderId").alias("source_record_id"),
        "symbol",
        normalize_symbol(F.col("symbol")).alias("normalized_symbol"),
        F.when(long, "LONG").otherwise("SHORT").alias("side"),
        moment("createdTime").alias("open_time"),
        moment("updatedTime").alias("close_time"),
        entry.alias("average_entry_price"),
        exit_.alias("average_exit_price"),
        size.alias("max_position_size"),
        gross.alias("realized_pnl"),
        (net - gross + fees).alias("funding_fee"),
        fees.alias("trading_fee"),
        net.alias("net_pnl"),
        margin.alias("margin_used"),
        (ratio(net, margin) * 100).alias("return_percent"),
    )


def closed_products(raw: DataFrame, orders: DataFrame, start: Column, end: Column) -> DataFrame:
    """Position history by product type (productType, positionId, symbol, holdSide, openAvgPrice, closeAvgPrice,
    openTotalPos, closeTotalPos, pnl, netProfit, totalFunding, openFee, closeFee, ctime, utime) closed from start to end:
    the last state of each position, whatever page or product it came with, and the leverage of its opening orders.

    Orders (productType, symbol, posSide, side, tradeSide, reduceOnly, leverage, cTime) of another product do not
    count. A position without an opening time opens at start, takes all orders given, and is PARTIAL. Net
    profit is stated or the sum of its parts. Without a leverage the margin is 0 and the return is on the notional.
    """
    text = lambda name: F.trim(F.coalesce(F.col(name), F.lit("")))
    closed = F.timestamp_millis(number("utime").cast("long")).cast("timestamp_ntz")
    named = F.concat_ws(":", F.lit("bitget"), "productType", F.when(text("positionId") != "", text("positionId")).otherwise(F.concat_ws(":", F.lit("symbol"), F.when(text("symbol") != "", F.col("symbol")).otherwise("position"), number("utime").cast("long").cast("string"))))
    held = raw.withColumn("source_record_id", named).filter((closed >= start) & (closed <= end))
    last = held.groupBy("account_id", "source_record_id").agg(F.max_by(F.struct(*[c for c in raw.columns if c != "account_id"]), F.struct(number("utime"), number("netProfit"), number("pnl"))).alias("x")).select("account_id", "source_record_id", "x.*")
    last = staged(last, fresh_path(raw.sparkSession, "closed-states"))
    whole, ever = number("ctime") > 0, [F.lit(t).cast("timestamp_ntz") for t in ("1970-01-01", "2999-01-01")]
    own = last.select("account_id", "source_record_id", F.concat_ws("|", "productType", "symbol").alias("symbol"), normalize_side(F.col("holdSide")).alias("side"), F.when(whole, moment("ctime")).otherwise(ever[0]).alias("open_time"), F.when(whole, closed).otherwise(ever[1]).alias("close_time"))
    placed = orders.select("account_id", F.concat_ws("|", "productType", "symbol").alias("symbol"), number("leverage").alias("leverage"), moment("cTime").alias("ordered_at"), F.col("tradeSide").alias("trade_side"), F.col("reduceOnly").alias("reduce_only"), F.col("posSide").alias("pos_side"), "side")
    # Leverage may have a fraction; it is swept as hundredths.
    swept = inferred_leverage(own, placed.withColumn("leverage", F.round(F.col("leverage") * 100).cast("long"))).select("account_id", "source_record_id", (F.col("leverage") / 100).alias("leverage"))
    size = F.abs(F.when(text("openTotalPos") != "", number("openTotalPos")).otherwise(number("closeTotalPos")))
    entry, gross, funding, fees = number("openAvgPrice"), number("pnl"), number("totalFunding"), number("openFee") + number("closeFee")
    net = F.when(text("netProfit") != "", number("netProfit")).otherwise(gross + funding + fees)
    notional = entry * size
    margin = F.when(F.col("leverage").isNotNull(), notional / F.col("leverage")).otherwise(0.0)
    # A sign that says nothing: fees of 0 stay 0.
    return last.join(swept, ["account_id", "source_record_id"], "left").select(
        "account_id",
        "source_record_id",
        "symbol",
        normalize_symbol(F.col("symbol")).alias("normalized_symbol"),
        normalize_side(F.col("holdSide")).alias("side"),
        F.when(whole, moment("ctime")).otherwise(start).alias("open_time"),
        closed.alias("close_time"),
        entry.alias("average_entry_price"),
        number("closeAvgPrice").alias("average_exit_price"),
        size.alias("max_position_size"),
        gross.alias("realized_pnl"),
        funding.alias("funding_fee"),
        (0.0 - fees).alias("trading_fee"),
        net.alias("net_pnl"),
        "leverage",
        margin.alias("margin_used"),
        F.when(margin > 0, net / margin * 100).when(notional > 0, gross / notional * 100).otherwise(0.0).alias("return_percent"),
        F.when(whole, "COMPLETE").otherwise("PARTIAL").alias("data_completeness"),
    )


def inferred_leverage(positions: DataFrame, orders: DataFrame, before_seconds: int = 300, whole: int = 100_000) -> DataFrame:
    """Positions (side LONG or SHORT) with the leverage of the orders that opened them: placed from shortly before
    opening to closing, on the same side, opening and not only reducing, with a leverage above 0; if all have one.

    Orders (symbol, leverage, ordered_at, trade_side, reduce_only, pos_side, side): an order of pos_side "net" is on
    the side that its buying or selling opens.

    No order meets a position: both are swept along the time of their account, symbol and side. Accounts of up to `whole`
    orders and positions are swept in one window; larger ones day by day. Rows of one account and id are one position.
    """
    low = lambda name: F.lower(F.coalesce(F.col(name), F.lit("")))
    opening = low("trade_side").contains("open") | (low("reduce_only") == "no")
    side = F.when(low("pos_side") == "net", F.when(low("side") == "buy", "LONG").when(low("side") == "sell", "SHORT")).otherwise(F.upper("pos_side"))
    placed = orders.filter(opening & (F.col("leverage") > 0)).select("account_id", F.upper("symbol").alias("__symbol"), side.alias("__side"), _micros(F.col("ordered_at")).alias("__t"), F.col("leverage").cast("long").alias("__lev")).dropna()
    counts = placed.select("account_id").unionByName(positions.select("account_id")).groupBy("account_id").agg(F.count(F.lit(1)).alias("n"))
    # One row at most for each `whole` rows.
    large = staged(counts.filter(F.col("n") > whole).select("account_id"), fresh_path(positions.sparkSession, "large-accounts"))
    first = F.col("open_time") - F.expr(f"INTERVAL {before_seconds} SECONDS")
    if large.isEmpty():
        swept = _swept_whole(positions, placed, first)
    else:
        part = lambda rows, how: rows.join(F.broadcast(large), "account_id", how)
        swept = _swept_whole(part(positions, "left_anti"), part(placed, "left_anti"), first).unionByName(_swept_by_day(part(positions, "left_semi"), part(placed, "left_semi"), first))
    return swept.withColumn("leverage", F.col("leverage").cast(orders.schema["leverage"].dataType))


_SWEPT = ["account_id", "__symbol", "__side"]


def _micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def _swept_whole(positions: DataFrame, placed: DataFrame, first: Column) -> DataFrame:
    """Backwards in time each position sees the first order from `first` on, and when the leverage first changes after
    that order; both move once."""
    held = positions.withColumns({"__symbol": F.upper("symbol"), "__side": F.col("side"), "__t": _micros(first), "__hi": _micros(F.col("close_time")), "__kind": F.lit(0)})
    marks = held.unionByName(placed.distinct().withColumn("__kind", F.lit(1)), allowMissingColumns=True)
    # At one moment a position begins before an order.
    back = Window.partitionBy(*_SWEPT).orderBy(F.desc("__t"), F.desc("__kind"), F.desc("__lev"))
    order = F.col("__kind") == 1
    met = marks.withColumn("__next", F.last(F.when(order, F.struct("__t", "__lev")), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    turn = F.when(order & (F.col("__next.__lev") != F.col("__lev")), F.col("__next.__t"))
    met = met.withColumn("__turn", F.last(turn, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter("__kind = 0")
    found = F.col("__t").isNotNull() & (F.col("__next.__t") <= F.col("__hi"))
    seen = met.select(*positions.columns, F.when(found, F.col("__next.__lev")).alias("__lev"), F.when(found, F.coalesce(F.col("__turn") > F.col("__hi"), F.lit(True))).alias("__same"))
    own = Window.partitionBy("account_id", "source_record_id")
    seen = seen.withColumns({"__lo": F.min("__lev").over(own), "__hi": F.max("__lev").over(own), "__same": F.bool_and("__same").over(own)})
    told = F.col("account_id").isNotNull() & F.col("source_record_id").isNotNull() & F.col("__same") & (F.col("__lo") == F.col("__hi"))
    return seen.withColumn("leverage", F.when(told, F.col("__lo"))).drop("__lev", "__same", "__lo", "__hi")


def _swept_by_day(positions: DataFrame, placed: DataFrame, first: Column) -> DataFrame:
    """With running counts of orders and of changes of leverage, no task holds more than a day of a key: the orders of a
    position have one leverage if none of them but the first is a change, which the counts at its two ends and that
    first order tell."""
    keys, day = _SWEPT, F.floor(F.col("__t") / 86_400_000_000)
    placed = placed.groupBy(*keys, "__t", "__lev").agg(F.count(F.lit(1)).alias("__n")).withColumn("__day", day)
    # A change is an order of another leverage than the one before: within its day, or the last of the last day that has any.
    within = Window.partitionBy(*keys, "__day").orderBy("__t", "__lev")
    lasts = placed.groupBy(*keys, "__day").agg(F.max_by("__lev", F.struct("__t", "__lev")).alias("__last"))
    before = lasts.withColumn("__last", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__day")))
    previous = F.coalesce(F.lag("__lev").over(within), "__last")
    changed = placed.join(before, [*keys, "__day"]).withColumn("__changed", F.when(previous.eqNullSafe(F.col("__lev")), 0).otherwise(1).cast("long"))
    held = positions.filter(F.col("close_time") >= first).select("account_id", F.upper("symbol").alias("__symbol"), F.col("side").alias("__side"), "source_record_id", _micros(first).alias("__lo"), _micros(F.col("close_time")).alias("__hi"))
    # Three kinds of marks at a moment, in this order: a position begins, an order, a position ends.
    none, zero = lambda kind: F.lit(None).cast(kind), F.lit(0).cast("long")
    end = lambda at, kind: held.select(*keys, "source_record_id", "__lo", "__hi", F.col(at).alias("__t"), F.lit(kind).alias("__kind"), none("long").alias("__lev"), zero.alias("__one"), zero.alias("__changed"))
    marks = changed.select(*keys, none(positions.schema["source_record_id"].dataType).alias("source_record_id"), none("long").alias("__lo"), none("long").alias("__hi"), "__t", F.lit(1).alias("__kind"), "__lev", F.lit(1).cast("long").alias("__one"), "__changed")
    swept = running_sums(marks.unionByName(end("__lo", 0)).unionByName(end("__hi", 2)), keys, day, ["__t", "__kind", "__lev"], {"__orders": F.col("__one"), "__changes": F.col("__changed")})
    own = [*keys, "source_record_id", "__lo", "__hi"]
    ends = swept.filter("__kind != 1").groupBy(*own).agg(*[F.max(F.when(F.col("__kind") == kind, F.col(of))).alias(f"{of}{kind}") for of in ("__orders", "__changes") for kind in (0, 2)])
    opened = swept.filter("__kind = 1").select(*keys, F.col("__orders").alias("__rank"), "__lev", F.col("__changed").alias("__first"))
    some = ends.filter("__orders2 > __orders0").withColumn("__rank", F.col("__orders0") + 1).join(opened, [*keys, "__rank"])
    one = some.groupBy("account_id", "source_record_id").agg(F.min("__lev").alias("lo"), F.max("__lev").alias("hi"), F.bool_and(F.expr("__changes2 - __changes0 = __first")).alias("same"))
    told = positions.join(one, ["account_id", "source_record_id"], "left")
    return told.withColumn("leverage", F.when(F.col("same") & (F.col("lo") == F.col("hi")), F.col("lo"))).drop("lo", "hi", "same")


def transaction_records(raw: DataFrame) -> DataFrame:
    """Transaction log (id, transactionTime, type, currency, cashFlow, funding, fee) as up to three records each."""
    cash, funding, fee, kind = number("cashFlow"), number("funding"), number("fee"), F.col("type")
    entry = lambda suffix, name, amount, when: F.when(
        when,
        F.struct(F.concat_ws(":", "id", F.lit(suffix)).alias("source_record_id"), name.alias("record_type"), amount.alias("amount_usd")),
    )
    entries = F.array(
        entry("pnl", F.lit("REALIZED_PNL"), cash, kind.isin("TRADE", "LIQUIDATION", "DELIVERY") & (cash != 0)),
        entry("funding", F.lit("FUNDING_FEE"), funding, funding != 0),
        entry("fee", F.lit("TRADING_FEE"), fee, fee != 0),
        entry("cash", F.when(cash > 0, "DEPOSIT").otherwise("WITHDRAWAL"), F.abs(cash), kind.isin("TRANSFER_IN", "TRANSFER_OUT") & (cash != 0)),
    )
    held = raw.select(
        "account_id",
        F.col("currency").alias("asset"),
        moment("transactionTime").alias("record_time"),
        F.explode(F.filter(entries, lambda x: x.isNotNull())).alias("x"),
    )
    return held.select("account_id", "asset", "record_time", "x.*")


def wallet_updates(raw: DataFrame, wallet: Column) -> DataFrame:
    """Ledger updates (hash, time, delta struct of type, user, destination, amount, usdc) relative to a wallet:
    what it receives is a deposit, what it sends a withdrawal."""
    delta = F.col("delta")
    amount = F.abs(F.coalesce(F.when(delta["usdc"].isNotNull(), number(delta["usdc"])), number(delta["amount"])))
    own = F.lower(wallet)
    incoming = (delta["type"] == "deposit") | ((F.lower(delta["destination"]) == own) & (F.lower(delta["user"]) != own))
    outgoing = (delta["type"] == "withdraw") | ((F.lower(delta["user"]) == own) & (F.lower(delta["destination"]) != own))
    kind = F.when(incoming, "DEPOSIT").when(outgoing, "WITHDRAWAL")
    return raw.select(
        "account_id",
        F.col("hash").alias("source_record_id"),
        moment("time").alias("record_time"),
        kind.alias("record_type"),
        amount.alias("amount_usd"),
    ).filter("record_type is not null")


def combo_mark(legs: Column, side: Column, entry: Column) -> Column:
    """Product over the legs (status, price) of the chance of each: 1 and 0 for those won and lost, else the price;
    one less that for the NO side; the entry price if any open leg has no price above 0."""
    status = lambda leg: F.coalesce(F.upper(leg["status"]), F.lit(""))
    price = lambda leg: F.when(status(leg) == "RESOLVED_WIN", 1.0).when(status(leg) == "RESOLVED_LOSS", 0.0).otherwise(F.coalesce(leg["price"], F.lit(0.0)))
    chance = F.aggregate(legs, F.lit(1.0), lambda p, leg: p * clamp(price(leg), 0.0, 1.0))
    missing = F.exists(legs, lambda leg: ~status(leg).isin("RESOLVED_WIN", "RESOLVED_LOSS") & (price(leg) <= 0))
    return F.when(missing, entry).when(F.upper(side) == "NO", 1.0 - chance).otherwise(chance)


def combo_size(current: Column, gross_cost: Column, fees: Column, entry: Column) -> Column:
    """Shares bought: what is held now, or cost without fees over the entry price if that is more."""
    return F.greatest(current, F.coalesce(ratio(gross_cost - fees, entry), F.lit(0.0)))


def last_equity(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """The last row of an equity file for each account."""
    return rows.groupBy(key).agg(F.max_by(value, at).alias(value), F.max(at).alias(at))


def propagated_prices(known: DataFrame, pairs: DataFrame) -> DataFrame:
    """Prices (token, price) reached from known ones over pairs (base, quote, rate: quote per base), nearest first.

    Each round prices the tokens one pair further; it stops when none is new, after as many rounds as there are
    tokens at most. Of several ways the smallest price by (round, price) is taken. Each round is written, so lineage
    does not grow; only whether it is empty comes back.
    """
    both = pairs.select(
        F.col("base").alias("a"),
        F.col("quote").alias("b"),
        F.col("rate").alias("r"),
    ).unionByName(pairs.filter("rate != 0").select(F.col("quote").alias("a"), F.col("base").alias("b"), (1 / F.col("rate")).alias("r")))
    spark = known.sparkSession
    both, out = staged(both, fresh_path(spark, "pairs")), staged(known.select("token", "price"), fresh_path(spark, "prices"))
    while True:
        reached = both.join(out.withColumnRenamed("token", "b"), "b").select(F.col("a").alias("token"), (F.col("r") * F.col("price")).alias("price"))
        fresh = staged(reached.join(out.select("token"), "token", "left_anti").groupBy("token").agg(F.min("price").alias("price")), fresh_path(spark, "prices"))
        if fresh.isEmpty():
            break
        out = out.unionByName(fresh)
    return out
