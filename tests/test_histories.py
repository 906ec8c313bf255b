"""What hangs on all that came before, against folds over whole histories."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import cycles, equity, ops, reconcile, running

T = datetime(2026, 7, 1)


@pytest.mark.parametrize("seed", range(3))
def test_spaced_rows(spark, seed):
    rng = random.Random(seed)
    apart = rng.choice([1, 60, 3600, 50_000])
    rows = []
    for key in ("a", "b", None):
        at = 0
        for _ in range(rng.choice([1, 60, 300])):
            at += rng.choice([0, 1, apart // 3, apart, apart + 1, 86_400]) if rng.random() < 0.98 else 40 * 86_400
            rows.append((key, rng.randrange(1000), T + timedelta(seconds=at)))
    rows.append(("a", 5, None))
    kept = []
    for key in ("a", "b", None):
        last = None
        for row in sorted((r for r in rows if r[0] == key and r[2]), key=lambda r: (r[2], r[1])):
            if last is None or row[2] - last > timedelta(seconds=apart):
                kept.append(row)
                last = row[2]
    df = spark.createDataFrame(rows, "k string, id int, at timestamp_ntz").repartition(3)
    got = running.spaced(df, ["k"], "at", ["id"], apart * 1_000_000)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(kept, key=str)
    assert running.spaced(df.limit(0), ["k"], "at", ["id"], 5).count() == 0


def test_one_key_of_many_moments(spark):
    """Linear in the rows of a hot key: 400,000 moments of one key, of which every fifth is kept."""
    df = spark.range(400_000).select(F.lit("a").alias("k"), F.col("id"), F.timestamp_seconds(1_700_000_000 + F.col("id")).cast("timestamp_ntz").alias("at"))
    got = running.spaced(df, ["k"], "at", ["id"], 4_000_000).agg(F.count(F.lit(1)), F.sum(F.col("id") % 5), F.max("id")).first()
    assert tuple(got) == (80_000, 0, 399_995)


def test_only_runs_of_the_type_are_thinned(spark):
    rows = [(i, 1, "SUCCESS", kind, T + timedelta(seconds=s)) for i, (kind, s) in enumerate((("POSITIONS", 0), ("FULL", 5), ("POSITIONS", 10), ("FULL", 12), (None, 13), ("POSITIONS", 70)))] + [(9, 1, "FAILED", "POSITIONS", T)]
    jobs = spark.createDataFrame(rows, "job_id long, account_id int, status string, job_type string, started_at timestamp_ntz")
    assert sorted(r.job_id for r in ops.thinned(jobs).collect()) == [0, 1, 3, 4, 5]


def test_sticky_states(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for k in range(200):
        state = None
        for at in range(rng.randrange(1, 7)):
            status, sure = rng.choice(["COMPLETE", "PARTIAL", "COMPLETE", "FAILED"]), rng.choice([True, False, False, None])
            state = status if state is None or not (state == "PARTIAL" and status == "COMPLETE" and not sure) else "PARTIAL"
            rows.append((k, at, status, sure))
        want[k] = state
    got = reconcile.sticky_fold(spark.createDataFrame(rows, "k int, at int, status string, authoritative boolean").repartition(5), ["k"], ["at"])
    assert {r.k: r.status for r in got.collect()} == want


@pytest.mark.parametrize("seed", range(3))
def test_hedge_cycles(spark, seed):
    rng = random.Random(seed)
    fills, want = [], []
    for side in ("LONG", "SHORT"):
        now = None
        for i in range(80):
            opens, q, p, at = rng.random() < 0.45, rng.randrange(1, 5), rng.randrange(1, 50), T + timedelta(hours=7 * i)
            fills.append((1, "S", side, i, at, ("BUY" if side == "LONG" else "SELL") if opens else ("SELL" if side == "LONG" else "BUY"), Decimal(q), Decimal(p)))
            if opens:
                now = now or {"open": at, "size": 0, "max": 0, "oq": 0, "on": 0, "cq": 0, "cn": 0}
                now["size"] += q
                now["max"] = max(now["max"], now["size"])
                now["oq"], now["on"] = now["oq"] + q, now["on"] + q * p
            elif now is None:
                want.append((side, at, at, q, None, "PARTIAL"))
            else:
                taken = min(q, now["size"])
                now["size"], now["cq"], now["cn"] = now["size"] - taken, now["cq"] + taken, now["cn"] + taken * p
                if now["size"] == 0:
                    pnl = (now["cn"] / now["cq"] - now["on"] / now["oq"]) * now["cq"] * (1 if side == "LONG" else -1)
                    want.append((side, now["open"], at, now["max"], round(pnl, 6), "COMPLETE"))
                    now = None
    df = spark.createDataFrame(fills, "account_id int, symbol string, position_side string, fill_id long, time timestamp_ntz, side string, quantity decimal(18,0), price decimal(18,2)")
    got = [(r.position_side, r.open_time, r.close_time, r.max_size, None if r.realized_pnl is None else round(r.realized_pnl, 6), r.data_completeness) for r in cycles.hedge_cycles(df.repartition(4)).collect()]
    assert sorted(got, key=str) == sorted(((*w[:3], float(w[3]), *w[4:]) for w in want), key=str)


def test_expected_accounts_of_the_backfill(spark):
    starts = [T + timedelta(minutes=m) for m in (-500, 3, 5, 9, 10, 11, 3000)]
    accounts = spark.createDataFrame([(i, True, s) for i, s in enumerate(starts)] + [(99, False, T)], "account_id int, is_active boolean, tracking_started_at timestamp_ntz")
    snaps = spark.createDataFrame([(0, i, 1, T + timedelta(minutes=m)) for i, m in enumerate((0, 5, 11, 4000))], "account_id int, snapshot_id int, equity int, recorded_at timestamp_ntz")
    got = {r.bucket_time: r.expected for r in equity.coverage(snaps, accounts).collect()}
    assert got == {b: sum(s < b + timedelta(minutes=5) for s in starts) for b in (T + timedelta(minutes=m) for m in (0, 5, 10, 4000))}


def test_fills_without_an_order_stay_apart(spark):
    rows = [(i, order, side, "BUY", asset, q, 10, 1, 2, T + timedelta(seconds=i)) for i, (order, side, asset, q) in enumerate([(None, None, None, 1), (None, None, None, 2), ("", "long", "bnb", 3), ("7", "LONG", "USDT", 1), ("7", "long", "usdt", 3), ("7", "SHORT", "USDT", 1), ("7", "LONG", "BNB", 1), ("8", "LONG", "BNB", 0)])]
    df = spark.createDataFrame([(1, "S", *r) for r in rows], "account_id int, symbol string, fill_id long, order_id string, position_side string, side string, fee_asset string, quantity int, price int, fee int, realized_pnl int, time timestamp_ntz")
    got = sorted((r.order_key, r.position_side, r.fee_asset, r.quantity, r.realized_pnl, r.fills) for r in cycles.merged_orders(df).collect())
    assert got == [("7", "LONG", "BNB", 1, 2, 1), ("7", "LONG", "USDT", 4, 4, 2), ("7", "SHORT", "USDT", 1, 2, 1), ("trade:0", "BOTH", "USDT", 1, 2, 1), ("trade:1", "BOTH", "USDT", 2, 2, 1), ("trade:2", "LONG", "BNB", 3, 2, 1)]
    assert cycles.merged_orders(df.drop("position_side", "fee_asset", "realized_pnl")).filter("position_side = 'BOTH' and fee_asset = 'USDT' and realized_pnl = 0").count() == 4


def test_funding_of_closed_positions_stands_in(spark):
    accounts = spark.createDataFrame([(1, "OKX", True, 100), (2, "OKX", True, 100)], "account_id int, exchange string, is_active boolean, initial_equity int")
    latest = spark.createDataFrame([(1, 125)], "account_id int, equity int")
    closed = spark.createDataFrame([(n, 5, 5, 1, -3) for n in (1, 2)], "account_id int, realized_pnl int, net_pnl int, trading_fee int, funding_fee int")
    ledger = spark.createDataFrame([(2, "FUNDING_FEE", 4)], "account_id int, record_type string, amount_usd int")
    assert {r.account_id: (r.funding_fee, r.trading_fee) for r in reconcile.reconcile(accounts, latest, closed, ledger).collect()} == {1: (-3, 1), 2: (4, 1)}


def test_what_details_state_of_components(spark):
    accounts = spark.createDataFrame([(1, "OKX", True, "CONNECTED", T, None, {"income": "COMPLETE", "equity": "FAILED"}), (2, "OKX", True, "ERROR", T, T, None), (3, "POLYMARKET", True, "CONNECTED", T, T, {"funding": "COMPLETE"})], "account_id int, exchange string, is_active boolean, connection_status string, last_synced_at timestamp_ntz, full_synced_at timestamp_ntz, details map<string,string>")
    rows = lambda name: spark.createDataFrame([(1, T), (3, T)], f"account_id int, {name} timestamp_ntz")
    ledger = spark.createDataFrame([(1, "WITHDRAWAL", T), (1, "DEPOSIT", T), (1, "REALIZED_PNL", T), (3, "FUNDING_FEE", T)], "account_id int, record_type string, record_time timestamp_ntz")
    out = reconcile.completeness(accounts, rows("recorded_at"), rows("recorded_at"), rows("updated_at").limit(0), rows("close_time"), ledger)
    got = {(r.account_id, r.component): (r.status, r.record_count, r.last_synced_at) for r in out.collect()}
    assert len(got) == 24
    assert got[1, "equity"] == ("FAILED", 1, T) and got[1, "positions"] == ("COMPLETE", 0, T) and got[1, "balances"] == ("COMPLETE", 1, T)
    assert got[1, "realized_pnl"] == ("COMPLETE", 1, None) and got[1, "cash_flow"] == ("PARTIAL", 2, None) and got[1, "closed_positions"] == ("PARTIAL", 1, T)
    assert got[2, "equity"] == ("PARTIAL", 0, T) and got[2, "balances"] == ("PARTIAL", 0, T) and got[2, "trading_fee"] == ("PARTIAL", 0, T)
    assert got[3, "realized_pnl"] == ("PARTIAL", 1, T) and got[3, "funding_fee"] == ("UNSUPPORTED", 0, None)
    assert out.filter("component = 'funding_fee' and latest_record_at is not null").count() == 0


def test_running_least(spark):
    df = spark.createDataFrame([(k, i, i // 4, (i * 7) % 11 - 3) for k in (1, 2) for i in range(20)], "k int, i int, c int, v int")
    got = {(r.k, r.i): r.low for r in running.running_least(df, ["k"], F.col("c"), ["i"], {"low": F.col("v")}).collect()}
    assert got == {(k, i): min((j * 7) % 11 - 3 for j in range(i + 1)) for k in (1, 2) for i in range(20)}
