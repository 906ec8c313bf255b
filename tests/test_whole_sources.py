"""Sources and sinks that leave nothing out, however much there is."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import incremental
from ledgerloom.sources import paged, shared, sinks, venues

T = datetime(2026, 7, 1)


def upstream(total, size):
    """Rows of one a millisecond in pages of `size`."""

    def fetch(start, end, cursor):
        at = start if cursor is None else cursor
        rows = [{"id": i, "time": i} for i in range(at, min(at + size, min(end + 1, total)))]
        return rows, at + size if at + size < min(end + 1, total) else None

    return fetch


def test_slices_of_too_many_pages_are_halved():
    got = [r["id"] for r in paged.pages(upstream(1000, 3), paged.Slice(0, 999), most=5)]
    assert got == list(range(1000))
    endless = lambda start, end, cursor: ([{"id": 1}], (cursor or 0) + 1)
    with pytest.raises(ValueError, match="more than 5 pages"):
        list(paged.pages(endless, paged.Slice(0, 9), most=5))


def test_short_pages_offsets_and_order():
    calls = []

    def fetch(start, end, offset, size):
        calls.append(offset)
        return [{"id": f"{i % 7}", "time": str(100 - i)} for i in range(offset, min(offset + size, 12))]

    rows = list(paged.pages(paged.offset_pages(fetch, 5), paged.Slice(0, 200)))
    assert len(rows) == 12 and calls == [0, 5, 10]
    assert [r["time"] for r in paged.tidied(iter(rows), paged.Slice(90, 98), None, "time")] == [str(t) for t in range(90, 99)]
    assert [r["id"] for r in paged.tidied(iter(rows), paged.Slice(0, 200), "id", "time")] == list("6543210")
    stops = list(paged.pages(lambda s, e, c: ([{"id": c}] * (2 if c is None else 1), (c or 0) + 1), paged.Slice(0, 9), size=2))
    assert len(stops) == 3


def test_prices_reach_any_distance(spark):
    pairs = spark.createDataFrame([(i + 1, i, 2.0) for i in range(14)], "base int, quote int, rate double")
    known = spark.createDataFrame([(0, 1.0)], "token int, price double")
    assert {r.token: r.price for r in venues.propagated_prices(known, pairs).collect()} == {i: 2.0**i for i in range(15)}


def test_upsert_keeps_every_stored_partition(spark, tmp_path):
    table = str(tmp_path / "table")
    days = [date(2026, 1, 1) + timedelta(days=i) for i in range(40)] + [None]
    make = lambda v, some: spark.createDataFrame([(k, f"{v}{k}", 1, d) for k, d in some], "k int, v string, at int, day date")
    sinks.upsert(make("a", [(k, d) for d in days for k in (1, 2)]), table, ["k", "day"], ["at"], "day")
    sinks.upsert(make("b", [(1, d) for d in days]), table, ["k", "day"], ["at"], "day")
    got = spark.read.parquet(table)
    assert got.count() == 82 and {r.v for r in got.collect()} == {"b1", "a2"}
    sinks.upsert(make("c", []), table, ["k", "day"], ["at"], "day")
    assert spark.read.parquet(table).count() == 82


def test_leverage_is_that_of_opening_orders_of_the_side(spark):
    positions = spark.createDataFrame([(1, "btcusdt", f"p{i}", side, T, T + timedelta(days=90)) for i, side in enumerate(("LONG", "SHORT"))], "account_id int, symbol string, source_record_id string, side string, open_time timestamp_ntz, close_time timestamp_ntz")
    day = timedelta(days=1)
    orders = [
        (5, T - timedelta(seconds=300), "open_long", None, "long", "buy"),
        (5, T + 60 * day, None, "NO", "net", "buy"),
        (7, T + day, "close", "YES", "long", "buy"),
        (0, T + day, "open", None, "long", "buy"),
        (9, T - timedelta(seconds=301), "open", None, "long", "buy"),
        (3, T + 90 * day, "open", None, "short", "sell"),
        (4, T + 90 * day, "close", "no", "net", "sell"),
        (8, T + 91 * day, "open", None, "short", "sell"),
    ]
    placed = spark.createDataFrame([(1, "BTCUSDT", *o) for o in orders], "account_id int, symbol string, leverage int, ordered_at timestamp_ntz, trade_side string, reduce_only string, pos_side string, side string")
    got = {r.source_record_id: r.leverage for r in venues.inferred_leverage(positions, placed).collect()}
    assert got == {"p0": 5, "p1": None}
    assert {r.source_record_id: r.leverage for r in venues.inferred_leverage(positions, placed.filter("leverage != 4")).collect()} == {"p0": 5, "p1": 3}


def test_what_is_needed_in_between_is_deleted(spark, monkeypatch):
    app = spark.sparkContext.applicationId
    monkeypatch.setattr(shared, "_TAKEN", {app: []})
    path = shared.fresh_path(spark, "between")
    assert shared.staged(spark.range(3), path).count() == 3 and shared.exists(spark, path)
    shared.drop_taken("another")
    assert shared.exists(spark, path)
    shared.drop_taken(app)
    assert not shared.exists(spark, path) and shared._TAKEN == {}


def test_leverage_against_brute_force(spark):
    rng = random.Random(3)
    minute = timedelta(minutes=1)
    held = [(rng.randrange(2), "btc", f"p{i}", "LONG", T + rng.randrange(9000) * minute, None) for i in range(120)]
    held = [(*h[:5], h[4] + rng.choice([-10, 0, 3, 400, 4000]) * minute) for h in held]
    placed = [(rng.randrange(2), "BTC", rng.choice([3, 3, 3, 5]), T + rng.randrange(9000) * minute, "open", None, "long", "buy") for _ in range(150)]
    want = {}
    for h in held:
        near = {o[2] for o in placed if o[0] == h[0] and h[4] - 5 * minute <= o[3] <= h[5]}
        want[h[2]] = near.pop() if len(near) == 1 else None
    positions = spark.createDataFrame(held, "account_id int, symbol string, source_record_id string, side string, open_time timestamp_ntz, close_time timestamp_ntz")
    orders = spark.createDataFrame(placed, "account_id int, symbol string, leverage int, ordered_at timestamp_ntz, trade_side string, reduce_only string, pos_side string, side string")
    got = {r.source_record_id: r.leverage for r in venues.inferred_leverage(positions, orders).collect()}
    assert got == want and len(set(want.values())) == 3


def test_business_records(spark):
    rows = [("1", "usdt", "5", "0.1", "close_long"), ("2", "USDC", "-1", "0", "contract_settle_fee"), ("3", "", "-7", "", "trans_to_cross"), ("4", "USDT", "2", "0", "unheard_of"), ("5", "BTC", "1", "0", "close_long"), ("6", "USDT", "0", "0", "unheard_of"), ("", "USDT", "3", "0", "TRANS_FROM_OTC")]
    raw = spark.createDataFrame([(1 if r[0] not in "45" or not r[0] else 2, *r, 9) for r in rows], "account_id int, billId string, coin string, amount string, fee string, businessType string, cTime long")
    got = sorted((r.source_record_id, r.asset, r.record_type, r.amount_usd) for r in venues.business_records(raw).collect())
    assert got == [("1:fee", "USDT", "TRADING_FEE", -0.1), ("1:pnl", "USDT", "REALIZED_PNL", 5), ("2:funding", "USDC", "FUNDING_FEE", -1), ("3:cash", "USD", "WITHDRAWAL", 7), ("9:cash", "USDT", "DEPOSIT", 3)]
    assert {r.account_id: r.complete for r in venues.business_complete(raw).collect()} == {1: True, 2: False}


def test_closed_positions_keep_one_identity(spark):
    schema = "account_id int, source_record_id string, close_time int, net_pnl int"
    stored = spark.createDataFrame([(1, "okx:a:5:1", 1, 10), (1, "okx:a:5:2", 2, 11), (1, "bitget:b:symbol:3", 1, 12), (2, "okx:a:5", 1, 13)], schema)
    incoming = spark.createDataFrame([(1, "okx:a:5", 1, 20), (1, "bitget:b:77:9", 1, 21)], schema)
    once = incremental.upserted_closed(stored, incoming, ["close_time"])
    want = [(1, "bitget:b:77", 1, 21), (1, "bitget:b:symbol:3", 1, 12), (1, "okx:a:5", 1, 20), (2, "okx:a:5", 1, 13)]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, incremental.upserted_closed(once, incoming, ["close_time"]).collect())) == want
    model = spark.createDataFrame([("A", 1, 1), ("B", 1, 1)], "exchange string, v int, at int")
    new = spark.createDataFrame([("A", 2, 2), ("C", 1, 1)], "exchange string, v int, at int")
    assert sorted(map(tuple, incremental.upserted_present(model, new, ["exchange"], ["at"], "exchange").collect())) == [("A", 2, 2), ("C", 1, 1)]


def test_small_helpers_of_upkeep(spark):
    now = F.lit(T).cast("timestamp_ntz")
    cursors = spark.createDataFrame([("a", None, 60), ("b", T - timedelta(seconds=59), 60), ("c", T - timedelta(seconds=60), 60), ("d", T - timedelta(seconds=4), 1)], "stream string, last_success_at timestamp_ntz, every_seconds int")
    assert sorted(r.stream for r in incremental.due(cursors, now).collect()) == ["a", "c"]
    starts = spark.createDataFrame([(T, None), (T, T - timedelta(hours=1)), (T, T)], "cursor timestamp_ntz, opened timestamp_ntz").select(incremental.read_from(F.col("cursor"), 5, F.col("opened")).alias("at"))
    assert [r["at"] for r in starts.collect()] == [T - timedelta(minutes=5), T - timedelta(hours=1), T - timedelta(minutes=5)]
    rows = spark.createDataFrame([(1, T), (1, T - timedelta(days=9)), (2, T)], "account_id int, record_time timestamp_ntz")
    periods = spark.createDataFrame([(1, True, T - timedelta(days=1)), (1, False, T - timedelta(days=99)), (2, False, T)], "account_id int, is_active boolean, started_at timestamp_ntz")
    assert [tuple(r) for r in incremental.within_period(rows, periods, now).collect()] == [(1, T)]
    after, gone = incremental.replaced(rows, rows.filter("account_id = 2"), ["account_id"])
    assert after.count() == 1 and gone.count() == 2
    accounts = spark.createDataFrame([({"s": "2026-06-01T00:00:00"}, T), ({"s": "no time"}, T - timedelta(days=90)), (None, None)], "details map<string,string>, last_synced_at timestamp_ntz")
    assert tuple(incremental.oldest_streams(accounts, {"s": "s", "other": "o"}).first()) == (T - timedelta(days=90), T - timedelta(days=90))


def test_only_one_machine_may_lack_a_shared_folder(spark, monkeypatch):
    class Elsewhere:
        class sparkContext:  # noqa: N801
            master = "local-cluster[2,1,1024]"

            @staticmethod
            def getConf():
                return {}

        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Elsewhere)
    assert shared.shared_dir(spark)
