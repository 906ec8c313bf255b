"""Every named query against its DuckDB SQL on the smallest tables, and what the plans must not hold."""

import re
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract
from ledgerloom.plans.oracles import ORACLES
from ledgerloom.plans.queries import QUERIES
from ledgerloom.plans.upkeep import STREAMED

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{SF}/{name}.parquet").exists():
            con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return None
    if hasattr(value, "isoformat"):
        return str(pd.Timestamp(value))
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    try:
        return value if isinstance(value, str) else f"{float(value):.9g}"
    except (TypeError, ValueError):
        return str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(plain(v) for v in r) for r in frame.astype(object).itertuples(index=False)) if len(frame.columns) else []


def key(row):
    return tuple((v is not None, v or "") for v in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert name in ORACLES
    want = duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a = sorted((tuple(plain(v) for v in r) for r in got[sorted(got.columns)].astype(object).itertuples(index=False)), key=key)
    b = sorted((tuple(plain(v) for v in r) for r in want[sorted(want.columns)].astype(object).itertuples(index=False)), key=key)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"equity_points_streaming", "price_graph"} - set(STREAMED)))
def test_plans_stay_in_the_jvm(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Python|Pandas|ArrowEval|CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["ledger_cash_flow_by_exchange"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "props" not in plan


def test_contract(spark):
    assert contract.entry(spark).count() == 3
    assert set(contract.oracle_sql()) <= set(contract.queries())
