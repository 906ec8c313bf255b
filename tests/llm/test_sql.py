"""The text queries that SQL can express, against it on the smallest tables."""

import duckdb
import pytest

from ledgerloom.llm.oracles import ORACLES
from ledgerloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.sql(ORACLES[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got[columns].astype(str).to_numpy())) == sorted(map(tuple, want[columns].astype(str).to_numpy()))
