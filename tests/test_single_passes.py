"""Lines of large tables are moved and read once where one pass gives the result."""

import json
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.operators import maintenance, quality, trades
from ledgerloom.plans.queries import QUERIES
from ledgerloom.sources import venue_states, venues, views
from ledgerloom.sources.payload_json import read_payloads
from ledgerloom.streaming.folds import Reductions

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_orders_meet_accounts_before_lines(spark):
    joins = plan(QUERIES["trade_extremes"](spark, SF))
    assert 0 < joins.index("l_orderkey") and joins.index("(l_orderkey") < joins.index("(o_custkey")
    want = trades.active_only(views.closed_positions(spark, SF), views.accounts(spark, SF))
    got = views.active_positions(spark, SF)
    assert got.columns == want.columns
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and not got.isEmpty()


def test_rules_read_positions_once(spark):
    rows = spark.createDataFrame([(1, "A", "LONG", 0, 5.0, 1.0, 50.0), (2, "A", "LONG", 300, -1.0, 1.0, 0.0), (3, "B", "SHORT", None, 10.0, 1.0, 10.0), (4, "B", "SHORT", 5, None, 1.0, 1.0)], "account_id int, symbol string, side string, leverage int, margin_used double, unrealized_pnl double, unrealized_percent double")
    found = quality.open_position_issues(rows)
    assert plan(found).count("LogicalRDD") == 1
    assert sorted((r.account_id, r.code) for r in found.collect()) == [(1, "INVALID_LEVERAGE"), (1, "RETURN_MISMATCH"), (2, "INVALID_LEVERAGE"), (2, "NON_POSITIVE_MARGIN"), (3, "INVALID_LEVERAGE")]


def test_duplicates_meet_the_one_that_stays_in_one_pass(spark):
    rows = spark.createDataFrame([(1, 1, 5, None), (1, 2, 4, None), (1, 3, 3, "x"), (2, 4, 1, "x"), (None, 5, 2, "x"), (None, 6, 1, "x")], "g int, id int, at int, note string")
    gone = maintenance.duplicate_plan(rows, ["g"], [F.desc("at")], ["id", "note"])
    assert "Join" not in plan(gone)
    # The one that stays has a null in its key, and so has a group.
    assert sorted(r.id for r in gone.collect()) == [2, 3, 6]


def test_columns_of_positions_that_nobody_asks_for_are_not_reckoned(spark):
    fields = ["category", "symbol", "positionIdx", "side", "size", "markPrice", "avgPrice", "positionValue", "leverage", "positionIMByMp", "positionIM", "unrealisedPnl", "liqPrice", "marginMode", "createdTime"]
    make = lambda value, made: (1, "linear", "P", "0", "Buy", "1", "1", "1", value, "1", "", "0", "1", "7", "", made)
    got = venue_states.category_positions(spark.createDataFrame([make("2", "1"), make("9", "1"), make("50", "0")], "account_id int, " + ", ".join(f"{f} string" for f in fields)))
    assert "liqPrice" not in plan(got.select("side")).split("LogicalRDD")[0]
    assert [(r.position_value_usd, r.liquidation_price) for r in got.collect()] == [(9.0, 7.0)]


def test_numbers(spark):
    given = {"1": 1.0, " 2.5 ": 2.5, "-0": 0.0, "+3": 3.0, "1e3": 1000.0, "": 0.0, None: 0.0, "x": 0.0, "12345678901234567890123": 12345678901234567890123.0, ".5": 0.5, "0.1234567890123": 0.1234567890123}
    rows = spark.createDataFrame([(k, v) for k, v in given.items()], "t string, v double").select("v", venues.number("t").alias("n")).collect()
    assert [r.n for r in rows] == [r.v for r in rows] and str(rows[2].n) == "0.0"
    # The format is asked only for what a cast does not read.
    text = plan(spark.createDataFrame([("1",)], "t string").select(venues.number("t").alias("n")))
    assert text.index("cast(t") < text.index("try_to_number")


def test_a_snapshot_is_one_value():
    show = lambda *held: [json.dumps([{"position": p, "size": s} for p, s in held])]
    fold = Reductions()
    state, out = fold.take(None, 1, show(("A", "2"), ("B", "1")))
    state, out = fold.take(state, 2, show(("A", "1.5")))
    assert [(x["position"], Decimal(x["after"])) for x in map(json.loads, out)] == [("A", Decimal("1.5")), ("B", Decimal(0))]
    state, out = fold.take(state, 3, show())
    assert [json.loads(x)["position"] for x in out] == ["A"] and state == "{}"


def test_leverage_is_swept_without_a_join(spark):
    orders = spark.sql("""select id % 3 as account_id, if(id % 2 = 0, 'a', 'A') as symbol, timestamp_micros(id * 7919 % 4000 * 60000000) as ordered_at, cast(1 + id div 150 % 3 as int) as leverage,
        if(id % 5 = 0, null, 'open_long') as trade_side, 'yes' as reduce_only, if(id % 7 = 0, null, if(id % 3 = 1, 'net', 'long')) as pos_side, if(id % 11 = 0, 'sell', 'buy') as side from range(600)""")
    positions = spark.sql("""select if(id % 31 = 0, null, id % 4) as account_id, if(id % 29 = 0, null, 'A') as symbol, if(id % 37 = 0, null, concat('p', id div 2)) as source_record_id, if(id % 6 = 0, 'SHORT', 'LONG') as side,
        if(id % 23 = 0, null, timestamp_micros(id * 104729 % 4000 * 60000000)) as open_time, if(id % 19 = 0, null, timestamp_micros((id * 104729 % 4000 + id % 40 - 2) * 60000000)) as close_time from range(400)""")
    got = venues.inferred_leverage(positions, orders)
    assert "Join" not in plan(got)
    by_day = venues.inferred_leverage(positions, orders, whole=0)
    mixed = venues.inferred_leverage(positions, orders, whole=230)
    assert got.exceptAll(by_day).isEmpty() and by_day.exceptAll(got).isEmpty() and got.exceptAll(mixed).isEmpty() and mixed.exceptAll(got).isEmpty()
    positions.createOrReplaceTempView("held_positions")
    orders.createOrReplaceTempView("placed_orders")
    want = spark.sql("""with o as (select account_id, upper(symbol) as symbol, if(pos_side = 'net', if(side = 'buy', 'LONG', 'SHORT'), upper(pos_side)) as side, ordered_at, leverage from placed_orders where trade_side is not null),
        one as (select p.account_id, p.source_record_id, if(min(o.leverage) = max(o.leverage), min(o.leverage), null) as leverage from held_positions p join o on o.account_id = p.account_id and o.symbol = p.symbol and o.side = p.side
            and o.ordered_at between p.open_time - interval 300 seconds and p.close_time group by all)
        select p.*, one.leverage from held_positions p left join one using (account_id, source_record_id)""").select(*got.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert 30 < got.filter("leverage is not null").count() < 350


def test_lines_meet_orders_once_for_leverage(spark):
    assert "l_shipdate" not in plan(QUERIES["leverage_inference"](spark, SF))


def test_duplicates_are_told_by_lines_alone(spark, tmp_path):
    for name in ("orders", "part"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").limit(1)
    lines.withColumn("l_orderkey", F.lit(-1).cast("long")).crossJoin(spark.range(3)).drop("id").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["duplicate_detector"](spark, str(tmp_path))
    assert "Join" not in plan(got)
    # Their order is not there.
    assert [(r.l_orderkey, r.row_count) for r in got.collect()] == [(-1, 3)]


def test_a_field_of_a_payload_is_read_once(spark):
    rows = spark.createDataFrame([(1, ' {"a": " x ", "b": "7"}'), (2, '{"a": {"c": 1}, "b": 1}'), (3, '{"a": null, "b": 1}'), (4, '[{"a": "x"}]'), (5, '{"a": "x", "b": "soon"}'), (6, "\n\t{}"), (7, '"a"'), (8, '{"a": "x", "b": ""}'), (9, " "), (10, "{")], "id int, text string")
    got = read_payloads(rows, "text", {"a": ("$.a", "string"), "b": ("$.b", "bigint")}, required=["a"])
    assert max(plan(got).count("$.b, LongType"), plan(got).count("$.b, bigint")) == 1
    assert {r.id: (r.reject, r.a, r.b) for r in got.collect()} == {
        1: (None, " x ", 7), 2: (None, '{"c":1}', 1), 3: ("MISSING a", None, None), 4: ("NOT_AN_OBJECT", None, None), 5: ("TYPE b", None, None),
        6: ("MISSING a", None, None), 7: ("NOT_AN_OBJECT", None, None), 8: (None, "x", None), 9: ("NO_TEXT", None, None), 10: ("NOT_JSON", None, None),
    }
