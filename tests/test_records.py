"""Raw payloads, closed positions by product, rates, pages, calendar: what their queries do not reach."""

from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.calendar import reporting_day, try_moment
from ledgerloom.operators import balances, cycles, pages, positions, rates, running
from ledgerloom.sources import sinks, venues
from ledgerloom.sources.commits import VersionedTable
from ledgerloom.sources.migrations import rebuild_calendar
from ledgerloom.sources.payload_json import accepted, read_payloads, rejects

T = datetime(2026, 7, 1)


def test_payloads_and_rejects(spark):
    fields = {"id": ("$.id", "bigint"), "amount": ("$.sums[0].amount", "decimal(10,2)"), "note": ("$.note", "string")}
    given = {
        1: '{"id": 7, "sums": [{"amount": "12.5"}], "note": "x"}',
        2: '{"id": "8", "sums": [{"amount": 3}], "more": {"deep": true}}',
        3: '{"id": 9, "sums": []}',
        4: '{"sums": [{"amount": 1}]}',
        5: '{"id": null, "sums": [{"amount": 1}]}',
        6: '{"id": "nine"}',
        7: '{"id": 1, "sums": [{"amount": {"x": 1}}]}',
        8: '{"id": 1',
        9: "[1]",
        10: "  ",
        11: None,
        12: '{"id": " "}',
        13: "12",
    }
    raw = spark.createDataFrame([(k, v, 0) for k, v in given.items()], "k int, body string, n int")
    read = read_payloads(raw, "body", fields, required=["id"])
    good = {r.k: (r.id, r.amount and float(r.amount), r.note) for r in accepted(read, "body").collect()}
    assert good == {1: (7, 12.5, "x"), 2: (8, 3.0, None), 3: (9, None, None)}
    bad = {r.k: r.reject for r in rejects(read, "body", ["k"]).collect()}
    assert bad == {4: "MISSING id", 5: "MISSING id", 6: "TYPE id", 7: "TYPE amount", 8: "NOT_JSON", 9: "NOT_AN_OBJECT", 10: "NO_TEXT", 11: "NO_TEXT", 12: "MISSING id", 13: "NOT_AN_OBJECT"}
    with pytest.raises(ValueError, match="without a path"):
        read_payloads(raw, "body", fields, required=["other"])


HISTORY = "account_id int, productType string, positionId string, symbol string, holdSide string, openAvgPrice string, closeAvgPrice string, openTotalPos string, closeTotalPos string, pnl string, netProfit string, totalFunding string, openFee string, closeFee string, ctime string, utime string"
ORDERS = "account_id int, productType string, symbol string, posSide string, side string, tradeSide string, reduceOnly string, leverage string, cTime string"


def test_closed_products(spark):
    base = (1, "USDT-FUTURES", "position-1", "BTCUSDT", "long", "32000", "32500", "0.01", "0.01", "5", "4.7", "-0.1", "-0.08", "-0.12", "1785059143881", "1785080589858")
    at = lambda **new: tuple(new.get(c.split()[0], v) for c, v in zip(HISTORY.split(", "), base, strict=True))
    rows = [
        at(utime="1785080000000", netProfit="1.2"),
        base,
        at(positionId="", netProfit="", ctime="0", openTotalPos="", closeTotalPos="-0.02"),
        at(productType="USDC-FUTURES", positionId="other"),
        at(positionId="late", utime="1885080000000"),
        at(positionId="none", holdSide="short"),
    ]
    orders = [(1, "USDT-FUTURES", "BTCUSDT", "long", "buy", "open", "NO", "20", "1785059143881"), (1, "USDC-FUTURES", "BTCUSDT", "net", "buy", "", "no", "12.5", "1785059143881"), (1, "USDC-FUTURES", "BTCUSDT", "long", "buy", "close", "YES", "3", "1785059143881")]
    start, end = (F.lit(x).cast("timestamp_ntz") for x in (datetime(2026, 7, 26, 11), datetime(2026, 7, 27)))
    got = {r.source_record_id: r for r in venues.closed_products(spark.createDataFrame(rows, HISTORY), spark.createDataFrame(orders, ORDERS), start, end).collect()}
    assert set(got) == {"bitget:USDT-FUTURES:position-1", "bitget:USDT-FUTURES:symbol:BTCUSDT:1785080589858", "bitget:USDC-FUTURES:other", "bitget:USDT-FUTURES:none"}
    first = got["bitget:USDT-FUTURES:position-1"]
    assert (first.normalized_symbol, first.side, first.average_entry_price, first.average_exit_price, first.max_position_size, first.realized_pnl, first.funding_fee, first.net_pnl, first.leverage, first.margin_used, first.data_completeness) == ("BTC-USDT-PERP", "LONG", 32000, 32500, 0.01, 5, -0.1, 4.7, 20, 16, "COMPLETE")
    assert first.trading_fee == pytest.approx(0.2) and first.return_percent == pytest.approx(29.375)
    bare = got["bitget:USDT-FUTURES:symbol:BTCUSDT:1785080589858"]
    assert (bare.data_completeness, bare.open_time, bare.max_position_size, bare.leverage) == ("PARTIAL", datetime(2026, 7, 26, 11), 0.02, 20)
    assert bare.net_pnl == pytest.approx(4.7)
    assert got["bitget:USDC-FUTURES:other"].leverage == 12.5
    none = got["bitget:USDT-FUTURES:none"]
    assert (none.leverage, none.margin_used) == (None, 0) and none.return_percent == pytest.approx(5 / 320 * 100)


def test_rates_by_age_and_fallback(spark):
    quotes = spark.createDataFrame([("A", 7.0, T), ("A", 7.5, T), ("A", -1.0, T + timedelta(seconds=5)), ("A", None, T), ("A", 8.0, T + timedelta(days=3))], "pair string, rate double, quoted_at timestamp_ntz")
    rows = [("A", 1, T - timedelta(seconds=1)), ("A", 2, T), ("A", 3, T + timedelta(seconds=60)), ("A", 4, T + timedelta(seconds=61)), ("A", 5, T + timedelta(days=2)), ("A", 6, T + timedelta(days=3, seconds=1)), ("B", 7, T), (None, 8, T), ("A", 9, None)]
    amounts = spark.createDataFrame(rows, "pair string, n int, at timestamp_ntz")
    got = {r.n: (r.rate, r.rate_source, r.converted) for r in rates.converted(amounts, quotes, "n", "at", 60, {"A": 2.0}).collect()}
    assert got == {1: (2, "DEFAULT", 2), 2: (7.5, "QUOTE", 15), 3: (7.5, "QUOTE", 22.5), 4: (7.5, "STALE", 30), 5: (7.5, "STALE", 37.5), 6: (8, "QUOTE", 48), 7: (None, None, None), 8: (None, None, None), 9: (2, "DEFAULT", 18)}
    assert running.latest_before(amounts.limit(0), quotes, ["pair"], "at", "quoted_at", ["rate"]).count() == 0
    assert amounts.select(balances.cny(F.col("n"), 7.0).alias("c")).first().c == 7.0


def test_pages_are_checked(spark):
    rows = spark.createDataFrame([(1, n, "BTC", T + timedelta(minutes=n)) for n in range(7)], "account_id int, snapshot_id int, symbol string, recorded_at timestamp_ntz")
    accounts = spark.createDataFrame([(1, "OKX", True)], "account_id int, exchange string, is_active boolean")
    page = pages.snapshot_page(rows, accounts, exchange="okx", symbol="btc", start=T + timedelta(minutes=1), number=2, size=4).collect()
    assert [(r.snapshot_id, r.total) for r in page] == [(2, 6), (1, 6)]
    assert pages.snapshot_page(rows, accounts, account_id=2).collect() == []
    for bad in ({"number": 0}, {"size": 501}, {"size": 0}):
        with pytest.raises(ValueError, match="pages count from 1"):
            pages.snapshot_page(rows, accounts, **bad)
    for name in ("result", "completeness"):
        with pytest.raises(ValueError, match=f"{name} must be one of"):
            pages.history_page(rows, [], **{name: "MAYBE"})


def test_the_calendar_is_rebuilt_once(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "daily"), "account_id int, snapshot_date date, funding_fee int, updated_at timestamp_ntz", ["account_id", "snapshot_date"], "snapshot_date")
    at = datetime(2026, 7, 30, 16, 30)
    rows = [(1, date(2026, 7, 30), -9, at), (2, date(2026, 7, 30), -5, at - timedelta(hours=2))]
    table.upsert(spark.createDataFrame(rows, table.schema), ["updated_at"])
    asked = []

    def compute(keys):
        asked.extend(tuple(r) for r in keys.collect())
        return keys.withColumn("funding_fee", F.lit(-1))

    assert tuple(rebuild_calendar(table, reporting_day(F.col("updated_at")), ["funding_fee"], compute)) == (2, 1, 0, 1, 1)
    assert sorted((r.account_id, r.snapshot_date, r.funding_fee) for r in table.read().collect()) == [(1, date(2026, 7, 31), -1), (2, date(2026, 7, 30), -5)]
    assert asked == [(1, date(2026, 7, 31))]
    assert rebuild_calendar(table, reporting_day(F.col("updated_at")), ["funding_fee"], compute) is None and len(asked) == 1


def test_cycles_of_stated_fills(spark):
    columns = "fill_id int, order_id int, account_id int, symbol string, side string, quantity decimal(18,0), price decimal(18,2), fee decimal(18,4), realized_pnl decimal(18,2), fee_asset string, time timestamp_ntz"
    make = lambda i, side, q, p, fee, pnl, asset, symbol: (i, i, 1, symbol, side, Decimal(q), Decimal(p), Decimal(fee), Decimal(pnl), asset, T + timedelta(minutes=i))
    fills = [make(1, "BUY", 4, 10, "0.1", 0, "USDT", "A"), make(2, "SELL", 4, 12, "0.1", 8, "usdc", "A")]
    # Opened at 10, but a fee in BNB: the entry is what the stated PnL of 6 on 4 at 12 tells.
    fills += [make(3, "BUY", 4, 10, "0.1", 0, "BNB", "B"), make(4, "SELL", 4, 12, "0.2", 6, None, "B")]
    # A short, closed by a fill that opens a long with what is left: half of its fee, all of its PnL.
    fills += [make(5, "SELL", 3, 20, "0.1", 0, "USDT", "C"), make(6, "BUY", 6, 18, "0.2", 6, "USDT", "C"), make(7, "SELL", 3, 17, "0", 1, "BNB", "C")]
    got = {(r.symbol, r.side): (r.entry_price, r.exit_price, r.realized_pnl, round(r.trading_fee, 6), r.complete, r.source_record_id) for r in cycles.stated_cycles(spark.createDataFrame(fills, columns)).collect()}
    assert got == {
        ("A", "LONG"): (10, 12, 8, 0.2, True, "binance:A:LONG:2"),
        ("B", "LONG"): (10.5, 12, 6, 0.2, False, "binance:B:LONG:4"),
        ("C", "SHORT"): (20, 18, 6, 0.2, True, "binance:C:SHORT:6"),
        ("C", "LONG"): (18, 17, 1, 0.1, True, "binance:C:LONG:7"),
    }


def test_unrealized_ends(spark):
    snapshots = spark.createDataFrame([(1, T - timedelta(days=1), 99.0), (1, T, -20.0), (1, T, 5.0), (1, T + timedelta(days=1), 4.0), (1, T + timedelta(days=9), 50.0), (2, T, None)], "account_id int, recorded_at timestamp_ntz, unrealized_pnl double")
    accounts = spark.createDataFrame([(1, T), (2, T), (3, T)], "account_id int, tracking_started_at timestamp_ntz")
    got = balances.unrealized_ends(snapshots, accounts, F.lit(T + timedelta(days=2)).cast("timestamp_ntz")).collect()
    assert sorted(map(tuple, got)) == [(1, -15.0, 4.0), (2, 0.0, 0.0)]


def test_small_measures(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    lit = F.lit
    assert value(positions.price_change_percent(lit(100), lit(110), lit("LONG"))) == 10 and value(positions.price_change_percent(lit(100), lit(110), lit("SHORT"))) == -10
    assert value(positions.price_change_percent(lit(0), lit(1), lit("LONG"))) in (None, 0)
    assert value(positions.closed_margin(lit(0.0), lit(10.0), lit(-4.0), lit(8))) == 5 and value(positions.closed_margin(lit(3.0), lit(10.0), lit(4.0), lit(8))) == 3
    assert value(try_moment(lit("2026-07-01T00:00:00Z"))) == T and value(try_moment(lit("soon"))) is None
    rows = spark.createDataFrame([(1, "old"), (2, "old"), (3, None)], "n int, v string")
    assert [r.v for r in sinks.relabelled(rows, "v", "old", "new", F.col("n") == 1).orderBy("n").collect()] == ["new", "old", None]
    nested = balances.with_assets(spark.createDataFrame([(1,), (2,)], "account_id int"), spark.createDataFrame([(1, "B", 2.0), (1, "A", 1.0)], "account_id int, asset string, value double"))
    assert {r.account_id: [tuple(a) for a in r.assets] for r in nested.collect()} == {1: [("A", 1.0), ("B", 2.0)], 2: []}
