"""Venue payloads, paged and file sources, sinks and streams."""

import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans.queries import QUERIES
from ledgerloom.operators import maintenance
from ledgerloom.sources import files, paged, sinks, venue_states, venues
from ledgerloom.streaming.equity import deduplicated_errors, replayed_points

SF = "/root/testdata/sf0.001"
T = datetime(2026, 7, 1)


def fetch(start, end, cursor):
    """Two pages a slice; the second repeats its own cursor."""
    page = 0 if cursor is None else cursor
    rows = [{"id": start + page, "time": start, "note": None}]
    return rows, 1


def test_paged_source(spark):
    assert [(s.start, s.end) for s in paged.slices(0, 15 * paged.DAY_MS)] == [(0, 7 * paged.DAY_MS - 1), (7 * paged.DAY_MS, 14 * paged.DAY_MS - 1), (14 * paged.DAY_MS, 15 * paged.DAY_MS)]
    waits, calls = [], []

    def failing():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("secret")
        return "fine"

    assert paged.with_retries(failing, sleep=waits.append) == "fine" and waits == [0.25, 0.5]
    with pytest.raises(OSError, match="after 3 tries: OSError"):
        paged.with_retries(lambda: (_ for _ in ()).throw(OSError("secret")), sleep=lambda _: None)
    spark.dataSource.register(paged.PagedSource)
    df = spark.read.format("paged").schema("id long, time long").option("fetch", "tests.test_sources:fetch").option("start", 0).option("end", 10 * paged.DAY_MS).load()
    assert sorted(r.id for r in df.collect()) == [0, 1, 7 * paged.DAY_MS, 7 * paged.DAY_MS + 1]


def test_file_sources(spark, tmp_path):
    (tmp_path / "accounts.json").write_text('{"accounts": [{"exchange": "OKX", "connection_name": "a", "is_active": true}, {"exchange": "BYBIT", "connection_name": "b"}]}')
    assert [(r.place, r.exchange) for r in files.configured_accounts(spark, str(tmp_path / "accounts.json")).orderBy("place").collect()] == [(0, "OKX"), (1, "BYBIT")]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("equity.csv", "t,equity\n1,10\n2,12.5\n")
    rows = files.zipped_rows(spark, str(tmp_path), "equity.csv", ["t", "equity", "absent"])
    assert venues.last_equity(rows, "path", "line", "equity").first().equity == "12.5" and rows.filter("absent is not null").count() == 0
    assert files.demo_book(spark).count() == 120


def test_income_and_bills(spark):
    rows = [(1, 1, "USDT", "5", "REALIZED_PNL", 0), (1, 2, "USDT", "-1", "FUNDING_FEE", 0), (1, 3, "USDT", "-0.5", "COMMISSION", 0), (1, 4, "USDT", "-3", "TRANSFER", 0), (1, 5, "BNB", "10", "TRANSFER", 0), (1, 6, "USDT", "1", "NEW_KIND", 0)]
    got = venues.income_records(spark.createDataFrame(rows, "account_id int, tranId long, asset string, income string, incomeType string, time long")).collect()
    assert [(r.record_type, r.amount_usd, r.supported) for r in got] == [("REALIZED_PNL", 5, True), ("FUNDING_FEE", -1, True), ("TRADING_FEE", 0.5, True), ("WITHDRAWAL", 3, True), ("DEPOSIT", 10, False)]
    bills = [(1, "a", "USDT", "2", "-0.1", "1.9", "3", "0"), (1, "b", "USDT", "-0.4", "0", "-0.4", "173", "0"), (1, "c", "USDT", "0", "0", "7", "11", "0"), (1, "d", "USDT", "0", "0", "7", "318", "0")]
    got = venues.bill_records(spark.createDataFrame(bills, "account_id int, billId string, ccy string, pnl string, fee string, balChg string, subType string, ts string")).collect()
    assert sorted((r.source_record_id, r.record_type, r.amount_usd) for r in got) == [("a:fee", "TRADING_FEE", 0.1), ("a:pnl", "REALIZED_PNL", 2), ("b:funding", "FUNDING_FEE", -0.4), ("c:deposit", "DEPOSIT", 7)]


def test_closed_positions(spark):
    row = [(1, "BTCUSDT", "o", "Sell", "2", "100", "110", "18.5", "0.5", "0.5", "5", "0", "1000")]
    c = venues.closed_from_orders(spark.createDataFrame(row, "account_id int, symbol string, orderId string, side string, closedSize string, avgEntryPrice string, avgExitPrice string, closedPnl string, openFee string, closeFee string, leverage string, createdTime string, updatedTime string")).first()
    assert (c.side, c.realized_pnl, c.funding_fee, c.return_percent) == ("LONG", 20, -0.5, 46.25)
    history = "account_id int, cTime string, uTime string, instId string, posId string, direction string, openAvgPx string, closeAvgPx string, openMaxPos string, pnl string, fee string, fundingFee string, realizedPnl string, pnlRatio string"
    states = [(1, "0", "5", "BTC-USDT-SWAP", "p", "long", "1", "2", "3", "9", "-1", "0", "8", "0.5"), (1, "0", "9", "BTC-USDT-SWAP", "p", "long", "1", "2", "3", "61", "-0.8", "0", "60.2", "0.5")]
    c = venues.closed_from_history(spark.createDataFrame(states, history))
    assert c.count() == 1 and (c.first().net_pnl, c.first().margin_used, c.first().normalized_symbol) == (60.2, 120.4, "BTC-USDT-PERP")


def test_balances_and_combos(spark):
    held = spark.createDataFrame([(1, "USDT", "5", "1"), (1, "BTC", "2", "0"), (1, "ODD", "1", "0")], "account_id int, asset string, available string, locked string")
    prices = spark.createDataFrame([("BTCUSDT", "100")], "symbol string, price string")
    got = {r.asset: (r.value_usd, r.price_source) for r in venues.valued_balances(held, prices).collect()}
    assert got == {"USDT": (6, "STABLECOIN_PARITY"), "BTC": (200, "EXCHANGE_PRICE"), "ODD": (None, "UNAVAILABLE")}
    assert venues.account_summary(venues.valued_balances(held, prices)).first().asDict() == {"account_id": 1, "total_equity_usd": 206, "unvalued_asset_count": 1}
    legs = spark.createDataFrame([([("RESOLVED_WIN", None), ("OPEN", 0.8)], "YES"), ([("OPEN", 0.25), ("OPEN", 2.0)], "NO"), ([("RESOLVED_LOSS", None), (None, None)], "YES")], "legs array<struct<status: string, price: double>>, side string")
    assert [r[0] for r in legs.select(venues.combo_mark(F.col("legs"), F.col("side"), F.lit(0.5))).collect()] == [0.8, 0.75, 0.5]
    delta = "account_id int, hash string, time long, delta struct<type: string, user: string, destination: string, amount: string, usdc: string>"
    moves = [(1, "a", 0, ("send", "0xME", "0xyou", "5", None)), (1, "b", 0, ("send", "0xyou", "0xme", "6", None)), (1, "c", 0, ("other", "x", "y", "1", None)), (1, "d", 0, ("deposit", None, None, None, "7"))]
    got = venues.wallet_updates(spark.createDataFrame(moves, delta), F.lit("0xMe")).collect()
    assert [(r.source_record_id, r.record_type, r.amount_usd) for r in got] == [("a", "WITHDRAWAL", 5), ("b", "DEPOSIT", 6), ("d", "DEPOSIT", 7)]


def test_sinks(spark, tmp_path):
    table = str(tmp_path / "table")
    rows = lambda data: spark.createDataFrame(data, "k int, v string, at int, day date")
    day = datetime(2026, 7, 1).date()
    sinks.upsert(rows([(1, "a", 1, day), (2, "b", 1, day + timedelta(days=1))]), table, ["k", "day"], ["at"], "day")
    for _ in range(2):
        sinks.upsert(rows([(1, "c", 2, day)]), table, ["k", "day"], ["at"], "day")
    assert sorted((r.k, r.v) for r in spark.read.parquet(table).collect()) == [(1, "c"), (2, "b")]
    sinks.export_csv(rows([(1, "=x", 1, day), (2, "y", 2, day)]), str(tmp_path / "csv"), [F.desc("at")], ["k", "v"], most=1)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).collect()[0].v == "y"
    model, made = str(tmp_path / "model"), []

    def compute():
        made.append(1)
        return spark.createDataFrame([(len(made),)], "n int")

    values = [sinks.read_model(spark, model, T + timedelta(seconds=s), 60, compute).first().n for s in (0, 120, 121)]
    assert values == [1, 1, 2]
    sinks.audit(spark, str(tmp_path / "audit"), T, "RETENTION", "SUCCESS", {"jobs": "1"})
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 1


def test_a_table_that_cannot_be_read_is_not_empty(spark, tmp_path):
    assert sinks.stored(spark, str(tmp_path / "none"), "k int").count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_text("no table")
    rows = spark.createDataFrame([(1, 1, T.date())], "k int, at int, day date")
    with pytest.raises(Exception, match="(?i)parquet|footer|file"):
        sinks.upsert(rows, str(tmp_path / "bad"), ["k", "day"], ["at"], "day")
    assert (tmp_path / "bad" / "part-0.parquet").read_text() == "no table"


def test_stream_equals_batch(spark):
    want = {tuple(r) for r in QUERIES["equity_points_5m"](spark, SF).select("bucket_time", "total_equity", "account_count").collect()}
    got = replayed_points(spark, SF).select("bucket_time", F.col("total_equity").cast("double"), "account_count")
    assert {tuple(r) for r in got.collect()} == want


def test_error_stream(spark, tmp_path):
    rows = [(1, "NET", "down", T), (1, "NET", "down", T + timedelta(minutes=30)), (1, "NET", "up", T)]
    spark.createDataFrame(rows, "account_id int, error_type string, message string, occurred_at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("account_id int, error_type string, message string, occurred_at timestamp").parquet(str(tmp_path / "in"))
    deduplicated_errors(stream).writeStream.format("memory").queryName("kept_errors").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("kept_errors").count() == 2


def test_contract_and_product_positions(spark):
    columns = "account_id int, posId string, instId string, posSide string, pos string, markPx string, avgPx string, lever string, notionalUsd string, margin string, liqPx string, mgnMode string, upl string"
    rows = [(1, "", "BTC-USDT-SWAP", "net", "-3", "50", "40", "4", "100", "", "0", "cross", "1"), (1, "p", "ETH-USDT-SWAP", "long", "0", "1", "1", "1", "1", "1", "1", "cross", "1")]
    p = venue_states.contract_positions(spark.createDataFrame(rows, columns)).collect()
    assert [(x.source_record_id, x.side, x.position_size, x.position_value_usd, x.margin_used, x.liquidation_price) for x in p] == [("BTC-USDT-SWAP:net", "SHORT", 2, 100, 20, None)]
    wallet = spark.createDataFrame([(1, "10", [("BTC", "1", "2", "3", "4", "5"), ("USDT", "1", None, "x", "", "6")])], "account_id int, totalEq string, details array<struct<ccy: string, availEq: string, availBal: string, frozenBal: string, upl: string, eqUsd: string>>")
    s = venue_states.detail_summary(wallet).first()
    assert (s.total_equity_usd, s.available_balance_usd, s.margin_balance_usd, s.unrealized_pnl_usd) == (10, 2, 3, 4)
    assert sorted((b.asset, b.available, b.locked, b.value_usd) for b in venue_states.detail_balances(wallet).collect()) == [("BTC", 2, 3, 5), ("USDT", 0, 0, 6)]


def test_ticker_holdings(spark):
    tickers = spark.createDataFrame([("btcusdt", "100"), ("ODDUSDT", "0")], "symbol string, lastPr string")
    spot = spark.createDataFrame([(1, "btc", "1", "0.5", "0.5", ""), (1, "usdt", "5", "0", "0", None), (1, "odd", "1", "0", "0", None), (1, "x", "2", "0", "0", "8")], "account_id int, coin string, available string, frozen string, locked string, usdtValue string")
    valued = venue_states.spot_holdings(spot, tickers)
    assert {r.asset: (r.value_usd, r.price_usd, r.price_source) for r in valued.collect()} == {"BTC": (200, 100, "SPOT_TICKER"), "USDT": (5, 1, "STABLECOIN_PARITY"), "ODD": (None, None, "SPOT_TICKER"), "X": (8, 4, "USDT_VALUE")}
    raw = spark.createDataFrame([(1, "USDT_FUTURES", "USDT", "10", "4", "10", "1", "1", "2"), (1, "USDC_FUTURES", "USDC", "7", "9", "", "0", "3", "1")], "account_id int, account_type string, marginCoin string, accountEquity string, available string, usdtEquity string, isolatedMargin string, crossedMargin string, unrealizedPL string")
    futures = venue_states.futures_holdings(raw, tickers)
    assert {r.asset: (r.locked, r.value_usd, r.price_source) for r in futures.collect()} == {"USDT": (6, 10, "USDT_EQUITY"), "USDC": (0, 7, "STABLECOIN_PARITY")}
    s = venue_states.holdings_summary(valued, futures, raw).first()
    assert (s.total_equity_usd, s.available_balance_usd, s.margin_balance_usd, s.unvalued_asset_count) == (230, 13 + 100 + 5 + 8, 5, 1)
    assert (s.legacy_excluded_equity_usd, s.legacy_excluded_margin_usd, s.legacy_excluded_unrealized_pnl_usd) == (220, 3, 1)
    initial = spark.createDataFrame([(1, 100.0, None), (2, 100.0, 2)], "account_id int, equity double, coverage_version int")
    excluded = spark.createDataFrame([(1, 20.0), (2, 20.0)], "account_id int, equity double")
    wider = maintenance.with_wider_coverage(initial, excluded)
    assert sorted(tuple(r) for r in maintenance.with_wider_coverage(wider, excluded).collect()) == [(1, 120.0, 2), (2, 100.0, 2)]


def test_wallets_and_perpetuals(spark):
    wallet = spark.createDataFrame([(1, "9", "8", "7", "6", [("btc", "10", "1", "2", "3", "5"), ("eth", "1", "1", "1", "1", " ")])], "account_id int, totalEquity string, totalAvailableBalance string, totalInitialMargin string, totalPerpUPL string, coins array<struct<coin: string, walletBalance: string, locked: string, totalOrderIM: string, totalPositionIM: string, usdValue: string>>")
    assert tuple(venue_states.wallet_summary(wallet).first()) == (1, 9, 8, 7, 6, 1)
    assert sorted((b.asset, b.available, b.locked) for b in venue_states.wallet_balances(wallet).collect()) == [("BTC", 4, 6), ("ETH", 0, 3)]
    columns = "account_id int, category string, symbol string, positionIdx string, side string, size string, markPrice string, avgPrice string, positionValue string, leverage string, positionIMByMp string, positionIM string, unrealisedPnl string, liqPrice string, marginMode string, createdTime string"
    row = (1, "inverse", "BTCUSD", "0", "Sell", "3", "50", "40", "150", "5", "", "0.1", "0.2", "0", "REGULAR_MARGIN", "0")
    p = venue_states.category_positions(spark.createDataFrame([row, row], columns)).collect()
    assert [(x.side, x.margin_used, x.unrealized_pnl, x.margin_mode) for x in p] == [("SHORT", 5, 10, "CROSS")]
    spot = venue_states.spot_balances(spark.createDataFrame([(1, 0, "USDC", "10", "4"), (1, 3, "HYPE", "2", "0"), (1, 9, "ODD", "1", "0"), (2, 0, "USDC", "5", "0")], "account_id int, token int, coin string, total string, hold string"), spark.createDataFrame([(3, 20.0)], "token int, price double"))
    position = "struct<coin: string, szi: string, entryPx: string, positionValue: string, liquidationPx: string, marginUsed: string, unrealizedPnl: string, leverage: struct<type: string, value: string>>"
    perps = spark.createDataFrame([(n, "", "100", "30", None, [(("xyz:BTC", "-2", "40", "100", None, "30", "7", ("cross", "3")),)]) for n in (1, 2)], f"account_id int, dex string, accountValue string, totalMarginUsed string, withdrawable string, positions array<struct<position: {position}>>")
    accounts = spark.createDataFrame([(1, "unifiedAccount"), (2, None)], "account_id int, abstraction string")
    got = {r.account_id: (r.total_equity_usd, r.available_balance_usd, r.margin_balance_usd, r.unrealized_pnl_usd, r.unvalued_asset_count) for r in venue_states.onchain_summary(spot, perps, accounts).collect()}
    assert got == {1: (50, 46, 30, 7, 1), 2: (105, 75, 30, 7, 0)}
    p = venue_states.perp_positions(perps).first()
    assert (p.source_record_id, p.side, p.mark_price, p.normalized_symbol, p.margin_mode) == ("xyz:BTC:SHORT", "SHORT", 50, "BTC-USDC-PERP", "CROSS")


def test_predictions_and_bundles(spark):
    columns = "account_id int, asset string, conditionId string, outcomeIndex int, title string, outcome string, size string, currentValue string, avgPrice string, curPrice string, initialValue string, cashPnl string, realizedPnl string, timestamp long, totalBought string"
    tokens = spark.createDataFrame([(1, "a" * 20, "0x" + "c" * 40, 1, " Rain ", "Yes", "4", "3", "0.5", "0.75", "2", "1", "2", 100, "10"), (1, "a" * 20, "0x" + "c" * 40, 1, " Rain ", "Yes", "0", "3", "0.5", "1", "2", "1", "3", 200, "10")], columns)
    p = venue_states.prediction_positions(tokens).collect()
    assert [(x.symbol, x.normalized_symbol, x.position_value_usd) for x in p] == [("Rain · Yes", "POLY-" + "c" * 16 + "-1-" + "a" * 12, 3)]
    combo = "account_id int, combo_position_id string, combo_condition_id string, side string, shares_balance double, entry_avg_price_usdc double, gross_entry_cost_usdc double, entry_fees_usdc double, realized_payout_usdc double, first_entry_at string, resolved_at string, legs array<struct<status: string, leg_current_price: double, market: struct<title: string, outcome: string>>>"
    legs = [("RESOLVED_WIN", None, ("A", "x")), ("OPEN", 0.8, ("B", "y"))]
    rows = spark.createDataFrame([(1, "held", "c", "YES", 10.0, 0.48, 5.0, 0.2, None, "2026-07-01T00:00:00Z", None, legs), (1, "done", "c", "YES", 0.0, 0.48, 5.0, 0.2, 10.0, "2026-07-01T00:00:00Z", "2026-07-02T00:00:00Z", legs)], combo)
    c = venue_states.combo_positions(rows).collect()
    assert [(x.symbol, round(x.mark_price, 9), round(x.position_value_usd, 9), round(x.unrealized_pnl, 9)) for x in c] == [("Combo: A — x + B — y · Yes", 0.8, 8, 3)]
    moments = [F.lit(t).cast("timestamp_ntz") for t in ("1970-01-01 00:00:00", "2026-07-03 00:00:00")]
    s = {x.source_record_id: x for x in venue_states.settled_predictions(tokens, rows, *moments).collect()}
    assert set(s) == {"poly-closed:" + "a" * 20, "poly-closed:done"} and s["poly-closed:" + "a" * 20].net_pnl == 3
    done = s["poly-closed:done"]
    assert (round(done.realized_pnl, 9), done.trading_fee, done.net_pnl, round(done.max_position_size, 9)) == (5.2, 0.2, 5, 10)
    part = spark.createDataFrame([(1, 2.0)], "account_id int, amount_usd double")
    bundle, supported = venue_states.history_bundle({"income": part, "fees": part})
    assert supported and sorted(r.stream for r in bundle.collect()) == ["fees", "income"]
    with pytest.raises(ValueError, match="unknown streams"):
        venue_states.history_bundle({"other": part})
