"""Balances, account summaries, open and settled positions of each kind of venue, from payloads of stated columns.

Numbers come as text; what is missing or no number counts as 0, as for ledger records (see venues). A holding
without a price has a NULL value, and a liquidation price of 0 is none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ratios import ratio
from ..functions.text import coin_of, normalize_margin_mode, normalize_side, normalize_symbol, shortened
from .venues import combo_mark, combo_size, moment, number

#: Coins taken at parity, and account kinds whose spot side already holds all equity.
DOLLARS = ("USD", "USDT", "USDC")
UNIFIED = ("unifiedAccount", "portfolioMargin")
STREAMS = ("income", "funding", "fees", "cash_flows")


def _given(text: Column) -> Column:
    return text.isNotNull() & (text != "")


def _or_none(text: str | Column) -> Column:
    return F.nullif(number(text), F.lit(0.0))


def _total(items: str, field: str) -> Column:
    return F.coalesce(F.aggregate(items, F.lit(0.0), lambda s, x: s + number(x[field])), F.lit(0.0))


# Unified wallets with a list of details per coin, and positions counted in contracts.


def detail_summary(wallets: DataFrame) -> DataFrame:
    """One row per wallet (account_id, totalEq, details of ccy, availEq, availBal, frozenBal, upl, eqUsd)."""
    return wallets.select(
        "account_id",
        number("totalEq").alias("total_equity_usd"),
        _total("details", "availEq").alias("available_balance_usd"),
        _total("details", "frozenBal").alias("margin_balance_usd"),
        _total("details", "upl").alias("unrealized_pnl_usd"),
        F.lit(0).alias("unvalued_asset_count"),
    )


def detail_balances(wallets: DataFrame) -> DataFrame:
    held = wallets.select("account_id", F.explode("details").alias("d"))
    return held.select(
        "account_id",
        F.col("d.ccy").alias("asset"),
        F.lit("UNIFIED").alias("account_type"),
        number("d.availBal").alias("available"),
        number("d.frozenBal").alias("locked"),
        number("d.eqUsd").alias("value_usd"),
    )


def contract_positions(raw: DataFrame) -> DataFrame:
    """Positions (posId, instId, posSide, pos, markPx, avgPx, lever, notionalUsd, margin, liqPx, mgnMode, upl).

    `pos` counts contracts, so the quantity is the notional over the mark price; without either it is the count.
    A missing margin is the notional at entry over leverage.
    """
    count, mark, entry, lever = number("pos"), number("markPx"), number("avgPx"), number("lever")
    notional = F.abs(number("notionalUsd"))
    size = F.when((notional != 0) & (mark != 0), notional / F.nullif(mark, F.lit(0.0))).otherwise(F.abs(count))
    rows = raw.filter(count != 0).withColumns({"position_size": size, "mark_price": mark, "entry_price": entry})
    rows = rows.withColumn("position_value_usd", F.when(notional != 0, notional).otherwise(F.col("position_size") * F.col("mark_price")))
    known = (F.col("position_value_usd") != 0) & (F.col("entry_price") != 0) & (F.col("mark_price") != 0)
    at_entry = F.when(
        known,
        ratio(F.col("position_value_usd") * F.col("entry_price"), F.col("mark_price")),
    ).otherwise(F.col("position_size") * F.col("entry_price"))
    margin = F.when((number("margin") == 0) & (lever != 0), ratio(at_entry, lever)).otherwise(F.abs(number("margin")))
    name = F.when(_given(F.col("posId")), F.col("posId")).otherwise(F.concat_ws(":", "instId", "posSide"))
    return rows.select(
        "account_id",
        name.alias("source_record_id"),
        F.col("instId").alias("symbol"),
        normalize_symbol(F.col("instId")).alias("normalized_symbol"),
        normalize_side(F.col("posSide"), count).alias("side"),
        "position_size",
        "position_value_usd",
        "entry_price",
        "mark_price",
        _or_none("liqPx").alias("liquidation_price"),
        lever.alias("leverage"),
        normalize_margin_mode(F.col("mgnMode")).alias("margin_mode"),
        margin.alias("margin_used"),
        number("upl").alias("unrealized_pnl"),
    )


# Spot and futures accounts valued by tickers.


def _priced(rows: DataFrame, tickers: DataFrame) -> DataFrame:
    """Adds price: 1 for dollars, else that of the ticker asset+USDT, NULL without one above 0."""
    quoted = tickers.select(
        F.upper("symbol").alias("__symbol"),
        number("lastPr").alias("__price"),
    ).filter("__price > 0").groupBy("__symbol").agg(F.max("__price").alias("__price"))
    joined = rows.join(quoted, F.concat("asset", F.lit("USDT")) == F.col("__symbol"), "left")
    return joined.withColumn("price", F.when(F.col("asset").isin(*DOLLARS), 1.0).otherwise(F.col("__price"))).drop("__symbol", "__price")


def _source(given: Column, label: str) -> Column:
    return F.when(given, label).when(F.col("asset").isin(*DOLLARS), "STABLECOIN_PARITY").otherwise("SPOT_TICKER")


def spot_holdings(raw: DataFrame, tickers: DataFrame) -> DataFrame:
    """Spot assets (coin, available, frozen, locked, usdtValue): the stated value, else parity, else the ticker."""
    rows = _priced(raw.withColumn("asset", F.upper("coin")), tickers)
    free, held, given = number("available"), number("frozen") + number("locked"), _given(F.col("usdtValue"))
    value = F.when(given, number("usdtValue")).otherwise((free + held) * F.col("price"))
    return rows.select(
        "account_id",
        "asset",
        F.lit("SPOT").alias("account_type"),
        free.alias("available"),
        held.alias("locked"),
        value.alias("value_usd"),
        F.coalesce(ratio(value, free + held), F.col("price")).alias("price_usd"),
        _source(given, "USDT_VALUE").alias("price_source"),
    )


def futures_holdings(raw: DataFrame, tickers: DataFrame) -> DataFrame:
    """Futures accounts (account_type, marginCoin, accountEquity, available, usdtEquity)."""
    rows = _priced(raw.withColumn("asset", F.upper(F.coalesce(F.nullif("marginCoin", F.lit("")), F.lit("UNKNOWN")))), tickers)
    equity, free, given = number("accountEquity"), number("available"), _given(F.col("usdtEquity"))
    value = F.when(given, number("usdtEquity")).otherwise(equity * F.col("price"))
    return rows.select(
        "account_id",
        "asset",
        "account_type",
        free.alias("available"),
        F.greatest(equity - free, F.lit(0.0)).alias("locked"),
        value.alias("value_usd"),
        F.col("price").alias("price_usd"),
        _source(given, "USDT_EQUITY").alias("price_source"),
    )


def holdings_summary(spot: DataFrame, futures: DataFrame, raw_futures: DataFrame) -> DataFrame:
    """Per account: futures equity and valued spot; and what a coverage of USDT futures alone leaves out (legacy_*)."""
    equity = F.when(_given(F.col("usdtEquity")), number("usdtEquity")).otherwise(number("accountEquity"))
    margin, other = number("isolatedMargin") + number("crossedMargin"), F.col("account_type") == "USDC_FUTURES"
    sums = {"equity": equity, "available": number("available"), "margin": margin, "unrealized": number("unrealizedPL")}
    perp = raw_futures.groupBy("account_id").agg(
        *[F.sum(c).alias(n) for n, c in sums.items()],
        *[F.sum(F.when(other, c).otherwise(0.0)).alias(f"usdc_{n}") for n, c in sums.items()],
    )
    valued = spot.filter("value_usd is not null").groupBy("account_id").agg(
        F.sum("value_usd").alias("spot_equity"),
        F.sum(F.col("available") * F.coalesce("price_usd", F.lit(0.0))).alias("spot_available"),
    )
    missing = spot.select("account_id", "value_usd").unionByName(futures.select("account_id", "value_usd")).groupBy("account_id").agg(F.count_if(F.col("value_usd").isNull()).alias("unvalued_asset_count"))
    both = missing.join(perp, "account_id", "left").join(valued, "account_id", "left").na.fill(0.0)
    add = lambda a, b, name: (F.col(a) + F.col(b)).alias(name)
    return both.select(
        "account_id",
        add("equity", "spot_equity", "total_equity_usd"),
        add("available", "spot_available", "available_balance_usd"),
        F.col("margin").alias("margin_balance_usd"),
        F.col("unrealized").alias("unrealized_pnl_usd"),
        "unvalued_asset_count",
        add("usdc_equity", "spot_equity", "legacy_excluded_equity_usd"),
        add("usdc_available", "spot_available", "legacy_excluded_available_usd"),
        F.col("usdc_margin").alias("legacy_excluded_margin_usd"),
        F.col("usdc_unrealized").alias("legacy_excluded_unrealized_pnl_usd"),
    )


def product_positions(raw: DataFrame) -> DataFrame:
    """Positions of all products (productType, symbol, holdSide, total, markPrice, openPriceAvg, liquidationPrice,
    leverage, marginMode, marginSize, unrealizedPL) in one table."""
    size, mark = number("total"), number("markPrice")
    return raw.filter(size != 0).select(
        "account_id",
        F.concat_ws(":", "productType", "symbol", "holdSide").alias("source_record_id"),
        "symbol",
        normalize_symbol(F.col("symbol")).alias("normalized_symbol"),
        normalize_side(F.col("holdSide")).alias("side"),
        F.abs(size).alias("position_size"),
        F.abs(size * mark).alias("position_value_usd"),
        number("openPriceAvg").alias("entry_price"),
        mark.alias("mark_price"),
        _or_none("liquidationPrice").alias("liquidation_price"),
        number("leverage").alias("leverage"),
        normalize_margin_mode(F.col("marginMode")).alias("margin_mode"),
        number("marginSize").alias("margin_used"),
        number("unrealizedPL").alias("unrealized_pnl"),
    )


# Wallets with a coin list, linear and inverse positions.


def wallet_summary(wallets: DataFrame) -> DataFrame:
    """One row per wallet (totalEquity, totalAvailableBalance, totalInitialMargin, totalPerpUPL, coins of coin,
    walletBalance, locked, totalOrderIM, totalPositionIM, usdValue)."""
    blank = F.coalesce(F.size(F.filter("coins", lambda c: F.trim(F.coalesce(c["usdValue"], F.lit(""))) == "")), F.lit(0))
    return wallets.select(
        "account_id",
        number("totalEquity").alias("total_equity_usd"),
        number("totalAvailableBalance").alias("available_balance_usd"),
        number("totalInitialMargin").alias("margin_balance_usd"),
        number("totalPerpUPL").alias("unrealized_pnl_usd"),
        blank.alias("unvalued_asset_count"),
    )


def wallet_balances(wallets: DataFrame) -> DataFrame:
    held = wallets.select("account_id", F.explode("coins").alias("c"))
    locked = number("c.locked") + number("c.totalOrderIM") + number("c.totalPositionIM")
    return held.select(
        "account_id",
        F.upper(F.coalesce(F.nullif("c.coin", F.lit("")), F.lit("UNKNOWN"))).alias("asset"),
        F.lit("UNIFIED").alias("account_type"),
        F.greatest(number("c.walletBalance") - locked, F.lit(0.0)).alias("available"),
        locked.alias("locked"),
        number("c.usdValue").alias("value_usd"),
    )


def category_positions(raw: DataFrame) -> DataFrame:
    """Positions (category, symbol, positionIdx, side, size, markPrice, avgPrice, positionValue, leverage,
    positionIMByMp, positionIM, unrealisedPnl, liqPrice, marginMode, createdTime), one for each id: the newest, of
    those the one of most value.

    Inverse positions state margin and PnL in the coin, so both are taken times the mark price.
    """
    size, mark, lever = F.abs(number("size")), number("markPrice"), number("leverage")
    scale = F.when(F.col("category") == "inverse", mark).otherwise(1.0)
    value = F.abs(number("positionValue"))
    stated = F.abs(F.when(_given(F.col("positionIMByMp")), number("positionIMByMp")).otherwise(number("positionIM"))) * scale
    margin = F.when((stated == 0) & (lever != 0), ratio(value, lever)).otherwise(stated)
    name = F.concat_ws(":", F.lit("bybit"), "category", "symbol", F.coalesce("positionIdx", F.lit("0")))
    rows = raw.filter(size != 0).select(
        "account_id",
        name.alias("source_record_id"),
        "symbol",
        normalize_symbol(F.col("symbol")).alias("normalized_symbol"),
        normalize_side(F.col("side")).alias("side"),
        size.alias("position_size"),
        F.when(value != 0, value).otherwise(size * mark).alias("position_value_usd"),
        number("avgPrice").alias("entry_price"),
        mark.alias("mark_price"),
        _or_none("liqPrice").alias("liquidation_price"),
        lever.alias("leverage"),
        F.when(F.col("marginMode") == "ISOLATED_MARGIN", "ISOLATED").otherwise("CROSS").alias("margin_mode"),
        margin.alias("margin_used"),
        (number("unrealisedPnl") * scale).alias("unrealized_pnl"),
        moment("createdTime").alias("open_time"),
    )
    # A rank, not max_by of all columns: what nobody asks for is neither reckoned nor moved, and each task sends one row of an id.
    order = ["open_time", "position_value_usd", "side", "margin_used", "unrealized_pnl"]
    turn = Window.partitionBy("account_id", "source_record_id").orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__turn", F.row_number().over(turn)).filter("__turn = 1").select(*rows.columns)


# Spot tokens priced by a graph of markets, and perpetuals of several exchanges under one wallet.


def spot_balances(raw: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens (token int, coin, total, hold) valued by (token, price); token 0 is the dollar itself."""
    total, hold = number("total"), number("hold")
    rows = raw.withColumn("token", F.coalesce("token", F.lit(0))).join(prices.select("token", "price"), "token", "left")
    price = F.when(F.col("token") == 0, 1.0).otherwise(F.col("price"))
    return rows.filter((total != 0) | (hold != 0)).select(
        "account_id",
        F.col("coin").alias("asset"),
        F.lit("SPOT").alias("account_type"),
        (total - hold).alias("available"),
        hold.alias("locked"),
        (total * price).alias("value_usd"),
        F.when(F.col("token") == 0, "STABLECOIN_PARITY").otherwise("SPOT_MARK").alias("price_source"),
    )


def onchain_summary(spot: DataFrame, perps: DataFrame, accounts: DataFrame) -> DataFrame:
    """Per account (account_id, abstraction) of spot_balances() and perpetual states (dex, accountValue,
    totalMarginUsed, withdrawable, positions of position.unrealizedPnl). Unified accounts hold everything in spot,
    so their perpetual equity is not added again; margin and unrealized PnL still count."""
    value, margin = number("accountValue"), number("totalMarginUsed")
    free = F.greatest(F.when(_given(F.col("withdrawable")), number("withdrawable")).otherwise(value - margin), F.lit(0.0))
    pnl = F.coalesce(F.aggregate("positions", F.lit(0.0), lambda s, p: s + number(p["position"]["unrealizedPnl"])), F.lit(0.0))
    perp = perps.groupBy("account_id").agg(
        F.sum(value).alias("perp"),
        F.sum(free).alias("perp_free"),
        F.sum(margin).alias("margin_balance_usd"),
        F.sum(pnl).alias("unrealized_pnl_usd"),
    )
    whole = F.col("available") + F.col("locked")
    held = spot.filter(whole != 0)
    sums = held.groupBy("account_id").agg(
        F.sum("value_usd").alias("spot"),
        F.sum(F.greatest(F.col("available"), F.lit(0.0)) * ratio(F.col("value_usd"), whole)).alias("spot_free"),
        F.count_if(F.col("value_usd").isNull()).alias("unvalued_asset_count"),
    )
    both = accounts.select("account_id", "abstraction").join(perp, "account_id", "left").join(sums, "account_id", "left").na.fill(0)
    once = F.col("abstraction").isin(*UNIFIED)
    added = lambda a, b: F.col(b) + F.when(F.coalesce(once, F.lit(False)), 0.0).otherwise(F.col(a))
    return both.select(
        "account_id",
        added("perp", "spot").alias("total_equity_usd"),
        added("perp_free", "spot_free").alias("available_balance_usd"),
        "margin_balance_usd",
        "unrealized_pnl_usd",
        "unvalued_asset_count",
    )


def perp_positions(perps: DataFrame) -> DataFrame:
    """Open positions of perpetual states: position of coin, szi, entryPx, positionValue, liquidationPx, marginUsed,
    unrealizedPnl and leverage (type, value); the mark price is value over size."""
    rows = perps.select("account_id", F.explode("positions").alias("x")).select("account_id", "x.position.*")
    size, value = number("szi"), F.abs(number("positionValue"))
    side = normalize_side(F.lit(""), size)
    return rows.filter(size != 0).select(
        "account_id",
        F.concat_ws(":", "coin", side).alias("source_record_id"),
        F.col("coin").alias("symbol"),
        normalize_symbol(coin_of(F.col("coin")), F.lit("USDC")).alias("normalized_symbol"),
        side.alias("side"),
        F.abs(size).alias("position_size"),
        value.alias("position_value_usd"),
        number("entryPx").alias("entry_price"),
        ratio(value, F.abs(size)).alias("mark_price"),
        _or_none("liquidationPx").alias("liquidation_price"),
        number("leverage.value").alias("leverage"),
        F.when(F.col("leverage.type") == "cross", "CROSS").otherwise("ISOLATED").alias("margin_mode"),
        number("marginUsed").alias("margin_used"),
        number("unrealizedPnl").alias("unrealized_pnl"),
    )


# Prediction markets: outcome tokens, and combos of several of them.


def display_symbol(title: Column, outcome: Column) -> Column:
    return shortened(F.concat_ws(" · ", F.nullif(F.trim(title), F.lit("")), F.nullif(F.trim(outcome), F.lit(""))))


def market_symbol(condition: Column, index: Column, asset: Column) -> Column:
    """POLY-condition-outcome-asset, of the first 16 and the last 12 characters."""
    bare = F.regexp_replace(F.coalesce(condition, F.lit("")), "^0x", "")
    return F.concat_ws(
        "-",
        F.lit("POLY"),
        F.left(bare, F.lit(16)),
        F.coalesce(index, F.lit(0)).cast("string"),
        F.right(F.coalesce(asset, F.lit("")), F.lit(12)),
    )


def _named(raw: DataFrame) -> DataFrame:
    outcome = F.coalesce("outcome", F.concat(F.lit("Outcome "), F.coalesce("outcomeIndex", F.lit(0)).cast("string")))
    return raw.withColumn("symbol", display_symbol(F.coalesce("title", F.lit("Polymarket")), outcome)).withColumn(
        "normalized_symbol",
        market_symbol(F.col("conditionId"), F.col("outcomeIndex"), F.col("asset")),
    )


def prediction_positions(raw: DataFrame) -> DataFrame:
    """Outcome tokens held (asset, conditionId, outcomeIndex int, title, outcome, size, currentValue, avgPrice, curPrice,
    initialValue, cashPnl, realizedPnl): always long, unleveraged, paid in cash."""
    name = F.coalesce(F.nullif("asset", F.lit("")), F.col("conditionId"))
    return _named(raw).filter(number("size") > 0).select(
        "account_id",
        name.alias("source_record_id"),
        "symbol",
        "normalized_symbol",
        F.lit("PREDICTION").alias("market_type"),
        F.lit("LONG").alias("side"),
        number("size").alias("position_size"),
        number("currentValue").alias("position_value_usd"),
        number("avgPrice").alias("entry_price"),
        number("curPrice").alias("mark_price"),
        F.lit("CASH").alias("margin_mode"),
        number("initialValue").alias("margin_used"),
        number("cashPnl").alias("unrealized_pnl"),
        number("realizedPnl").alias("realized_pnl"),
        F.lit(None).cast("timestamp_ntz").alias("open_time"),
    )


def combos(raw: DataFrame) -> DataFrame:
    """Combos (combo_position_id, combo_condition_id, side, shares_balance, entry_avg_price_usdc, gross_entry_cost_usdc,
    entry_fees_usdc, realized_payout_usdc double; first_entry_at, resolved_at ISO text; legs of status,
    leg_current_price and market title and outcome) with names, mark price and original size."""
    told = F.transform(
        "legs",
        lambda x: F.concat_ws(
            " — ",
            F.trim(F.coalesce(x["market"]["title"], F.lit("Polymarket"))),
            F.trim(F.coalesce(x["market"]["outcome"], F.lit("Outcome 0"))),
        ),
    )
    title = F.when(F.coalesce(F.size("legs"), F.lit(0)) > 0, F.concat(F.lit("Combo: "), F.array_join(told, " + "))).otherwise("Polymarket Combo")
    legs = F.coalesce(
        F.transform("legs", lambda x: F.struct(x["status"].alias("status"), x["leg_current_price"].alias("price"))),
        F.array().cast("array<struct<status: string, price: double>>"),
    )
    side = F.coalesce(F.nullif("side", F.lit("")), F.lit("Yes"))
    identity = F.coalesce(F.nullif("combo_position_id", F.lit("")), F.col("combo_condition_id"))
    amount = {c: F.coalesce(c, F.lit(0.0)) for c in ("shares_balance", "entry_avg_price_usdc", "gross_entry_cost_usdc", "entry_fees_usdc", "realized_payout_usdc")}
    at = lambda c: F.try_to_timestamp(c).cast("timestamp_ntz")
    rows = raw.withColumns(amount)
    size = combo_size(F.col("shares_balance"), F.col("gross_entry_cost_usdc"), F.col("entry_fees_usdc"), F.col("entry_avg_price_usdc"))
    return rows.withColumns({"identity": identity, "symbol": display_symbol(title, F.initcap(side)), "normalized_symbol": F.concat(F.lit("POLY-COMBO-"), F.right(identity, F.lit(32))), "mark_price": combo_mark(legs, side, F.col("entry_avg_price_usdc")), "original_size": size, "opened_at": at(F.col("first_entry_at")), "closed_at": at(F.col("resolved_at"))})


def combo_positions(raw: DataFrame) -> DataFrame:
    """Combos still held, in the columns of prediction_positions()."""
    size, cost = F.col("shares_balance"), F.col("gross_entry_cost_usdc")
    value = size * F.col("mark_price")
    return combos(raw).filter(size > 0).select(
        "account_id",
        F.col("identity").alias("source_record_id"),
        "symbol",
        "normalized_symbol",
        F.lit("PREDICTION_COMBO").alias("market_type"),
        F.lit("LONG").alias("side"),
        size.alias("position_size"),
        value.alias("position_value_usd"),
        F.col("entry_avg_price_usdc").alias("entry_price"),
        "mark_price",
        F.lit("CASH").alias("margin_mode"),
        cost.alias("margin_used"),
        (value - cost).alias("unrealized_pnl"),
        F.lit(0.0).alias("realized_pnl"),
        F.col("opened_at").alias("open_time"),
    )


def settled_predictions(raw: DataFrame, combo_rows: DataFrame, start: Column, end: Column) -> DataFrame:
    """Positions settled from start to end: outcome tokens (also timestamp in seconds, totalBought), one row for each,
    the last by time; and resolved combos, which are complete."""
    closed = F.timestamp_seconds(F.col("timestamp").cast("long")).cast("timestamp_ntz")
    bare = F.regexp_replace(F.coalesce("conditionId", F.lit("")), "^0x", "")
    key = F.concat(
        F.lit("poly-closed:"),
        F.coalesce(F.nullif(F.trim("asset"), F.lit("")), F.concat_ws(":", bare, F.coalesce("outcomeIndex", F.lit(0)).cast("string"))),
    )
    entry, bought, pnl = number("avgPrice"), number("totalBought"), number("realizedPnl")
    token = _named(raw).select(
        "account_id",
        key.alias("source_record_id"),
        "symbol",
        "normalized_symbol",
        start.alias("open_time"),
        closed.alias("close_time"),
        entry.alias("average_entry_price"),
        number("curPrice").alias("average_exit_price"),
        bought.alias("max_position_size"),
        pnl.alias("realized_pnl"),
        F.lit(0.0).alias("trading_fee"),
        pnl.alias("net_pnl"),
        (entry * bought).alias("margin_used"),
        (ratio(pnl, entry * bought, 0.0) * 100).alias("return_percent"),
        F.lit("PARTIAL").alias("data_completeness"),
    )
    others = [c for c in token.columns if c not in ("account_id", "source_record_id")]
    token = token.filter((F.col("close_time") >= start) & (F.col("close_time") <= end))
    token = token.groupBy("account_id", "source_record_id").agg(F.max_by(F.struct(*others), F.struct("close_time", "net_pnl")).alias("x")).select("account_id", "source_record_id", "x.*")
    payout, cost, fees = F.col("realized_payout_usdc"), F.col("gross_entry_cost_usdc"), F.col("entry_fees_usdc")
    done = combos(combo_rows).filter((F.col("closed_at") >= start) & (F.col("closed_at") <= end) & _given(F.col("identity")))
    combo = done.select(
        "account_id",
        F.concat(F.lit("poly-closed:"), "identity").alias("source_record_id"),
        "symbol",
        "normalized_symbol",
        F.coalesce("opened_at", start).alias("open_time"),
        F.col("closed_at").alias("close_time"),
        F.col("entry_avg_price_usdc").alias("average_entry_price"),
        ratio(payout, F.col("original_size"), 0.0).alias("average_exit_price"),
        F.col("original_size").alias("max_position_size"),
        (payout - (cost - fees)).alias("realized_pnl"),
        fees.alias("trading_fee"),
        (payout - cost).alias("net_pnl"),
        cost.alias("margin_used"),
        (ratio(payout - cost, cost, 0.0) * 100).alias("return_percent"),
        F.lit("COMPLETE").alias("data_completeness"),
    )
    return token.unionByName(combo)


def history_bundle(parts: dict[str, DataFrame]) -> tuple[DataFrame, bool]:
    """The streams that a venue supports (of STREAMS; canonical record columns) as one table with their stream's
    name, and whether it supports any."""
    unknown = set(parts) - set(STREAMS)
    if unknown:
        raise ValueError(f"unknown streams {sorted(unknown)}")
    if not parts:
        raise ValueError("a venue without streams has no bundle")
    named = [rows.withColumn("stream", F.lit(name)) for name, rows in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named), bool(named)
