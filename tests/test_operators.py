"""Operators on small frames with known results."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import calendar, text
from ledgerloom.operators import balances, cycles, equity, incremental, ledger, ops, pnl, positions, quality, reconcile, risk, running, trades

T = datetime(2026, 7, 1)
MIN = timedelta(minutes=1)


def one(df):
    return df.first()


def test_symbols_sides_and_ids(spark):
    spelled = ["BTCUSDT", "BTC-USDT-SWAP", "BTC/USDT:USDT", "BTC", "ETH_USDC", " eth/usd ", "USDT", "ABCBUSD"]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in spelled], "s string").select(text.normalize_symbol(F.col("s"))).collect()]
    assert got == ["BTC-USDT-PERP"] * 4 + ["ETH-USDC-PERP", "ETH-USD-PERP", "USDT-USDT-PERP", "ABCB-USD-PERP"]
    sides = spark.createDataFrame([("Buy", 1.0), ("short", 1.0), ("net", -2.0), ("net", None)], "s string, n double").select(text.normalize_side(F.col("s"), F.col("n"))).collect()
    assert [r[0] for r in sides] == ["LONG", "SHORT", "SHORT", "LONG"]
    ids = spark.createDataFrame([("okx:a:12:34", "bitget:1:symbol:4", "x:9"), ("okx:a:b:34", "bitget:1:77:4", "poly-closed:x:9")], "o string, b string, p string")
    got = [tuple(r) for r in ids.select(text.canonical_okx_id(F.col("o")), text.canonical_bitget_id(F.col("b")), text.canonical_market_id(F.col("p"))).collect()]
    assert got == [("okx:a:12", "bitget:1:symbol:4", "poly-closed:x"), ("okx:a:b:34", "bitget:1:77", "poly-closed:x:9")]
    cells = spark.createDataFrame([("=1",), ("\tx",), ("ok",), (None,)], "c string").select(text.csv_cell(F.col("c"))).collect()
    assert [r[0] for r in cells] == ["'=1", "'\tx", "ok", None]
    long = spark.range(1).select(text.shortened(F.lit("x" * 90)), text.shortened(F.lit("x" * 80))).first()
    assert (len(long[0]), long[0][-3:], len(long[1])) == (80, "...", 80)


def test_reporting_days(spark):
    rows = spark.createDataFrame([(datetime(2026, 8, 10, 15, 59),), (datetime(2026, 8, 10, 16, 1),)], "t timestamp_ntz")
    assert [str(r[0]) for r in rows.select(calendar.reporting_day(F.col("t"))).collect()] == ["2026-08-10", "2026-08-11"]
    assert calendar.is_day_aligned(datetime(2026, 7, 1, 16), datetime(2026, 7, 2, 15, 59, 59))
    assert not calendar.is_day_aligned(datetime(2026, 7, 1, 16), datetime(2026, 7, 2, 15, 59, 59, 1)) and calendar.is_day_aligned(None, None)
    month = spark.range(1).select(calendar.months_before(F.lit("2024-03-31").cast("date"), 1)).first()[0]
    assert str(month).startswith("2024-02-29")


def test_ledger_totals(spark):
    schema = "record_id string, account_id long, record_time timestamp_ntz, amount_usd decimal(18,2)"
    part = lambda rows, extra="": spark.createDataFrame(rows, schema + extra)
    from decimal import Decimal as D

    parts = {
        "income": part([("income", 1, T, D(5), "REALIZED_PNL")], ", income_type string"),
        "funding": part([("funding", 1, T, D(-1))]),
        "fees": part([("fee", 1, T, D("0.5"))]),
        "cash": part([("deposit", 1, T, D(10), "DEPOSIT"), ("withdrawal", 1, T, D(3), "WITHDRAW")], ", flow_type string"),
    }
    accounts = spark.createDataFrame([(1, "OKX", "main", True)], "account_id long, exchange string, connection_name string, is_active boolean")
    closed = spark.createDataFrame([(1, D(6), T)], "account_id long, realized_pnl decimal(18,2), close_time timestamp_ntz")
    records = ledger.filtered(ledger.union(**parts), accounts)
    assert records.count() == 5
    assert {r.record_id: float(r.signed_amount_usd) for r in records.collect()} == {"income": 5, "funding": -1, "fee": -0.5, "deposit": 10, "withdrawal": -3}
    want = {"realized_pnl": 6, "funding_fee": -1, "trading_fee": 0.5, "deposits": 10, "withdrawals": 3, "net_cash_flow": 7, "net_realized": 4.5, "net_effect": 11.5}
    assert one(ledger.summary(records, closed)).asDict() == want
    preagg = ledger.daily(ledger.union(**parts), closed, accounts)
    assert preagg.count() == 5 and one(ledger.daily_summary(preagg)).asDict() == want
    assert one(ledger.summary(records, closed, "DEPOSIT")).realized_pnl == 0
    assert ledger.filtered(ledger.union(**parts), accounts, record_type="cash_flow", exchange="okx").count() == 2
    later = ledger.union(**(parts | {"fees": part([("late", 1, T + timedelta(days=1), D(2))])})).withColumn("record_date", calendar.reporting_day(F.col("record_time")))
    assert incremental.affected([later.filter("record_id = 'late'")], ["account_id", "record_date"]).count() == 1


def test_daily_series(spark):
    rows = [(1, "OKX", f"2026-07-0{i}", a, r, f, t, e, 0) for i, a, r, f, t, e in ((1, 10, 4, 1, 0.5, 110), (2, 7, -1, -2, 0.25, 107), (3, 12, 3, 0, 0.25, 112))]
    frame = spark.createDataFrame(rows, "account_id int, exchange string, day string, investment_return int, realized_pnl int, funding_fee int, trading_fee double, equity_usd int, net_cash_flow int").withColumn("snapshot_date", F.to_date("day"))
    points = pnl.daily_points(frame).orderBy("snapshot_date").collect()
    assert [p.investment_return for p in points] == [10, -3, 5] and [p.cumulative_return for p in points] == [10, 7, 12]
    week = pnl.rollup(pnl.daily_points(frame), "week").collect()
    assert [(str(w.period_start), w.investment_return, w.cumulative_return, w.realized_pnl, w.funding_fee, w.trading_fee) for w in week] == [("2026-06-29", 12, 12, 6, -1, 1)]
    stats = one(pnl.day_stats(pnl.daily_points(frame)))
    assert (stats.best_day, stats.worst_day, stats.profitable_days, stats.losing_days) == (10, -3, 2, 1)
    fall = spark.createDataFrame(list(enumerate([100, 120, 90, 110])), "snapshot_date int, equity_usd int")
    assert one(pnl.max_drawdown(fall)).max_drawdown == 25
    assert one(pnl.max_drawdown(fall.limit(0))).max_drawdown == 0
    period = pnl.period_pnl(*map(F.lit, (1000, 2000, 300, 100, 700, -25, 30, 50, 200)))
    assert spark.range(1).select(*[c.alias(k) for k, c in period.items()]).first().asDict() == {"net_cash_flow": 200, "investment_return": 800, "trading_pnl": 645, "unrealized_change": 150}


def test_profit_loss_and_risk(spark):
    rows = spark.createDataFrame([("LONG", 7), ("SHORT", -3)], "side string, net_pnl int")
    assert one(trades.profit_and_loss(rows)).asDict() == {"total_profit": 7, "total_loss": 3, "net_pnl": 4}
    whole = {r.side: r for r in trades.quality_by_side(rows).collect()}["ALL"]
    assert (whole.win_rate, whole.payoff_ratio, whole.profit_factor, whole.long_short_ratio) == (50, pytest.approx(7 / 3), pytest.approx(7 / 3), 1)
    none = {r.side: r for r in trades.quality_by_side(rows.limit(0)).collect()}
    assert all(r.trade_count == 0 and r.payoff_ratio is None for r in none.values())
    levels = [(25, 0, 0, None, "HIGH"), (0, 50, 0, None, "HIGH"), (0, 0, 0, 10, "HIGH"), (15, 0, 0, None, "MEDIUM"), (0, 0, 50, 30, "MEDIUM"), (14, 34, 49, 21, "LOW")]
    got = spark.createDataFrame(levels, "d int, c int, m int, l int, want string").select(risk.level(F.col("d"), F.col("c"), F.col("m"), F.col("l")), "want").collect()
    assert all(r[0] == r[1] for r in got)
    assert one(spark.createDataFrame([(40, 100)], "m int, e int").agg(risk.margin_utilization(F.col("m"), F.col("e")).alias("u"))).u == 40


def test_margin(spark):
    args = [F.lit(x) for x in (982.00756496, 55.157, 54.312, 1.0, 20.0, 3.0)]
    assert spark.range(1).select(positions.margin_used(*args)).first()[0] == pytest.approx(982.00756496 * 55.157 / 54.312 / 20)
    reported = [F.lit(x) for x in (982.0, 55.0, 54.0, 1.0, 0.0, -3.0)]
    assert spark.range(1).select(positions.margin_used(*reported)).first()[0] == 3
    old = spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], "symbol string, size int, baseline int")
    new = spark.createDataFrame([("a", 5, 99), ("c", 3, 30)], "symbol string, size int, baseline int")
    assert sorted(map(tuple, positions.merged(old, new, ["symbol"], ["baseline"]).collect())) == [("a", 5, 10), ("c", 3, 30)]


def test_latest_batch_and_failures(spark):
    assets = spark.createDataFrame([(1, T, "USDT", 100), (1, T + MIN, "USDT", 120), (1, T + MIN, "BTC", 5)], "account_id int, at timestamp_ntz, asset string, n int")
    assert {r.asset: r.n for r in balances.latest_batch(assets, ["account_id"], "at").collect()} == {"BTC": 5, "USDT": 120}
    jobs = spark.createDataFrame([(i, 1, s, T + i * MIN, 1) for i, s in enumerate(("SUCCESS", "FAILED", "FAILED", "RUNNING"))], "job_id int, account_id int, status string, started_at timestamp_ntz, duration_ms int")
    state = one(ops.account_runs(jobs))
    assert (state.latest_status, state.last_success_at, state.consecutive_failures) == ("RUNNING", T, 2)
    many = spark.createDataFrame([(i, 1, "SUCCESS", T + timedelta(seconds=s), 1) for i, s in enumerate((0, 30, 59, 60, 100, 121))], "job_id long, account_id int, status string, started_at timestamp_ntz, duration_ms int")
    assert sorted(r.job_id for r in ops.thinned(many).collect()) == [0, 3, 5]
    unvalued = spark.createDataFrame([("LDUSDT", 0.36, 0.0, None), ("X", 0.0, 0.0, None), ("BTC", 1.0, 0.0, 2.0)], "asset string, available double, locked double, value_usd double")
    assert [r.asset for r in balances.unvalued(unvalued).collect()] == ["LDUSDT"]


def test_equity_curve_and_backfill(spark):
    hour = datetime(2026, 7, 1, 2)
    accounts = spark.createDataFrame([(1, True, hour - timedelta(days=1)), (2, True, hour - timedelta(days=1))], "account_id int, is_active boolean, tracking_started_at timestamp_ntz")
    snaps = spark.createDataFrame([(1, 1, 100, hour + MIN), (2, 2, 200, hour - 6 * MIN)], "account_id int, snapshot_id int, equity int, recorded_at timestamp_ntz")
    filled = {r.bucket_time: r for r in equity.backfilled(snaps, accounts).collect()}
    at = filled[hour]
    assert (at.total_equity, at.account_count, at.stale_account_count) == (300, 2, 1) and len(filled) == 1
    curve = spark.createDataFrame([(T, 100), (T + 10 * MIN, 110)], "bucket_time timestamp_ntz, total_equity int")
    got = one(pnl.change(curve, "bucket_time", "total_equity"))
    assert (got.change_amount, got.change_percent) == (10, 10)
    assert one(pnl.change(curve.limit(0), "bucket_time", "total_equity")).change_percent is None


def fills_of(spark, rows):
    from decimal import Decimal as D

    data = [(1, "S", i, side, D(q), D(p), D(str(fee)), T + i * MIN) for i, (side, q, p, fee) in enumerate(rows)]
    return spark.createDataFrame(data, "account_id int, symbol string, fill_id long, side string, quantity decimal(18,0), price decimal(18,2), fee decimal(22,5), time timestamp_ntz")


def test_one_way_cycle(spark):
    rows = fills_of(spark, [("BUY", 2, 100, 0.1), ("BUY", 1, 110, 0.05), ("SELL", 1, 120, 0.05), ("SELL", 2, 90, 0.1)])
    c = one(cycles.closed_cycles(rows))
    assert c.entry_price == pytest.approx(103.3333333) and c.exit_price == 100 and c.max_size == 3
    assert c.realized_pnl == -10 and c.trading_fee == pytest.approx(0.3) and c.net_pnl == pytest.approx(-10.3) and c.side == "LONG"
    funding = spark.createDataFrame([(1, T + 2 * MIN, -0.2), (1, T + timedelta(days=1), -9.0)], "account_id int, record_time timestamp_ntz, amount_usd double")
    assert one(cycles.with_funding(cycles.closed_cycles(rows), funding, ["account_id"])).net_pnl == pytest.approx(-10.5)


def test_flip_closes_and_opens(spark):
    rows = fills_of(spark, [("BUY", 2, 10, 1), ("SELL", 5, 12, 1), ("BUY", 3, 11, 1), ("SELL", 1, 5, 0)])
    got = sorted(cycles.closed_cycles(rows).collect(), key=lambda r: r.cycle)
    assert [(c.side, c.max_size, c.realized_pnl) for c in got] == [("LONG", 2, 4), ("SHORT", 3, 3)]
    assert [c.trading_fee for c in got] == [pytest.approx(1.4), pytest.approx(1.6)]


def test_hedge_cycle_with_orphan(spark):
    rows = fills_of(spark, [("SELL", 2, 10, 0), ("BUY", 3, 10, 0), ("SELL", 2, 12, 0), ("SELL", 9, 13, 0)]).withColumn("position_side", F.lit("LONG"))
    got = sorted(cycles.hedge_cycles(rows).collect(), key=lambda r: r.close_time)
    assert [(c.data_completeness, c.max_size, c.realized_pnl) for c in got] == [("PARTIAL", 2, None), ("COMPLETE", 3, pytest.approx(7))]


def test_reconciliation(spark):
    accounts = spark.createDataFrame([(1, "OKX", True, 100)], "account_id int, exchange string, is_active boolean, initial_equity int")
    latest = spark.createDataFrame([(1, 125)], "account_id int, equity int")
    closed = spark.createDataFrame([(1, 5, 5, 0)], "account_id int, realized_pnl int, net_pnl int, trading_fee int")
    none = spark.createDataFrame([], "account_id int, record_type string, amount_usd int")
    unrealized = spark.createDataFrame([(1, -20.0, 0.0)], "account_id int, initial_unrealized double, current_unrealized double")
    row = one(reconcile.reconcile(accounts, latest, closed, none, unrealized))
    assert (row.component_return, row.variance, row.status) == (25, 0, "MATCHED")
    assert one(reconcile.totals(reconcile.reconcile(accounts.limit(0), latest, closed, none))).status == "MATCHED"
    updates = spark.createDataFrame([(1, 1, "COMPLETE", False), (1, 2, "PARTIAL", False), (1, 3, "COMPLETE", False), (2, 1, "PARTIAL", False), (2, 2, "COMPLETE", True)], "k int, at int, status string, authoritative boolean")
    assert {r.k: r.status for r in reconcile.sticky_fold(updates, ["k"], ["at"]).collect()} == {1: "PARTIAL", 2: "COMPLETE"}


def test_quality_and_retention(spark):
    rows = spark.createDataFrame([(1, "S", "LONG", 0, 5.0, 1.0, 20.0), (1, "S", "SHORT", 201, -1.0, 1.0, 0.0), (1, "T", "LONG", 5, 10.0, 1.0, 50.0)], "account_id int, symbol string, side string, leverage int, margin_used double, unrealized_pnl double, unrealized_percent double")
    codes = sorted((r.code, r.entity) for r in quality.open_position_issues(rows).collect())
    assert codes == [("INVALID_LEVERAGE", "S LONG"), ("INVALID_LEVERAGE", "S SHORT"), ("NON_POSITIVE_MARGIN", "S SHORT"), ("RETURN_MISMATCH", "T LONG")]
    snaps = spark.createDataFrame([(1, "old", T), (1, "old-unsummarized", T + timedelta(days=3)), (1, "new", T + timedelta(days=100))], "account_id int, id string, recorded_at timestamp_ntz")
    days = spark.createDataFrame([(1, T)], "account_id int, t timestamp_ntz").select("account_id", calendar.reporting_day(F.col("t")).alias("snapshot_date"))
    day = calendar.reporting_day(F.col("recorded_at"))
    assert [r.id for r in quality.expired_snapshots(snaps, days, day, F.lit(T + timedelta(days=90)).cast("timestamp_ntz")).collect()] == ["old"]
    assert quality.expired_snapshots(snaps, days, day, None).count() == 0


def test_incremental(spark):
    stored = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "k int, v string, at int")
    once = incremental.upserted(stored, new, ["k"], ["at"])
    assert sorted(map(tuple, once.collect())) == [(1, "a", 1), (2, "d", 3), (3, "e", 1)]
    assert sorted(map(tuple, incremental.upserted(once, new, ["k"], ["at"]).collect())) == sorted(map(tuple, once.collect()))
    sums = running.running_sums(spark.createDataFrame([(k, i, i // 3) for k in (1, 2) for i in range(10)], "k int, i int, c int"), ["k"], F.col("c"), ["i"], {"s": F.col("i")})
    assert {(r.k, r.i): r.s for r in sums.collect()} == {(k, i): i * (i + 1) // 2 for k in (1, 2) for i in range(10)}
    queue = spark.createDataFrame([(1, "PENDING", 0, T, T), (2, "FAILED", 1, T - MIN, T - 20 * MIN), (3, "FAILED", 1, T, T - MIN), (4, "PENDING", 5, T, T)], "item_id int, status string, attempts int, created_at timestamp_ntz, updated_at timestamp_ntz")
    assert [r.item_id for r in incremental.work_queue(queue, F.lit(T).cast("timestamp_ntz"), 10).collect()] == [2, 1]


def test_error_runs(spark):
    at = [T, T + 30 * MIN, T + 60 * MIN, T + 61 * MIN, T + 90 * MIN, T + 122 * MIN]
    rows = [(1, "NET", "down", t) for t in at] + [(1, "NET", "up", T + MIN), (2, "NET", "down", T + MIN)]
    kept = ops.error_runs(spark.createDataFrame(rows, "account_id int, error_type string, message string, occurred_at timestamp_ntz")).collect()
    assert sorted((r.account_id, r.message, r.occurred_at) for r in kept) == [(1, "down", T), (1, "down", T + 61 * MIN), (1, "down", T + 122 * MIN), (1, "up", T + MIN), (2, "down", T + MIN)]
