"""Versioned tables: what commits answer, and that a commit that fails changes nothing."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources.commits import Commit, Conflict, VersionedTable

SCHEMA = "account int, day date, equity decimal(10,2), at timestamp_ntz, tags map<string,string>"
T, DAY = datetime(2026, 7, 1), date(2026, 7, 1)


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "table"), SCHEMA, ["account", "day"], "day")


def rows(spark, *given):
    """(account, day number or None, equity, minutes)."""
    made = [(a, None if d is None else DAY + timedelta(days=d), e, None if m is None else T + timedelta(minutes=m), {"m": str(m)}) for a, d, e, m in given]
    return spark.createDataFrame(made, "account int, day date, equity int, at timestamp_ntz, tags map<string,string>")


def held(df):
    return sorted(((r.account, r.day and (r.day - DAY).days, int(r.equity)) for r in df.collect()), key=str)


def test_first_of_day_says_whether_it_inserted(spark, table):
    assert table.insert_new(rows(spark, (1, 0, 10, 5), (1, 0, 11, 3), (2, 0, 20, 1)), ["at"]) == Commit(1, 2)
    assert table.insert_new(rows(spark, (1, 0, 12, 1)), ["at"]) == Commit(1, 0, 0, 1)
    assert table.insert_new(rows(spark, (1, 0, 12, 1), (1, 1, 13, 9), (3, 0, 30, 1)), ["at"]) == Commit(2, 2, 0, 1)
    assert held(table.read()) == [(1, 0, 11), (1, 1, 13), (2, 0, 20), (3, 0, 30)]
    assert held(table.read(1)) == [(1, 0, 11), (2, 0, 20)]


def test_upsert(spark, table):
    assert table.upsert(rows(spark, (1, 0, 10, 5), (1, 0, 11, 7), (2, None, 20, 1)), ["at"]) == Commit(1, 2)
    assert table.upsert(rows(spark, (1, 0, 9, 1), (2, None, 20, 1)), ["at"]) == Commit(2, 0, 1, 1)
    assert held(table.read()) == [(1, 0, 9), (2, None, 20)]
    # The latest stays whatever order batches come in.
    assert table.upsert(rows(spark, (1, 0, 5, 0)), ["at"], latest=True) == Commit(2, 0, 0, 1)
    assert table.upsert(rows(spark, (1, 0, 6, 2)), ["at"], latest=True) == Commit(3, 0, 1, 0)
    assert table.upsert(rows(spark), ["at"]) == Commit(3)


def test_only_touched_partitions_are_written_again(spark, table):
    table.upsert(rows(spark, *[(1, d, d, 0) for d in range(4)]), ["at"])
    before = table._manifest()["parts"]
    table.upsert(rows(spark, (1, 2, 9, 0)), ["at"])
    after = table._manifest()["parts"]
    assert sum(before[p] != after[p] for p in before) == 1 and set(before) == set(after)


def test_replace_deletes_what_is_gone(spark, table):
    assert table.replace(rows(spark, (1, 0, 1, 0), (2, 0, 2, 0), (3, 1, 3, 0)), ["at"]) == Commit(1, 3)
    assert table.replace(rows(spark, (1, 0, 1, 0), (2, 0, 5, 0), (4, 2, 4, 0)), ["at"]) == Commit(2, 1, 1, 1, 1)
    assert held(table.read()) == [(1, 0, 1), (2, 0, 5), (4, 2, 4)]
    assert table.replace(rows(spark), ["at"]) == Commit(3, 0, 0, 0, 3)
    assert held(table.read()) == [] and held(table.read(1)) == [(1, 0, 1), (2, 0, 2), (3, 1, 3)]


def test_a_write_that_fails_half_way_leaves_the_table(spark, table, monkeypatch):
    table.upsert(rows(spark, *[(a, d, 1, 0) for a in range(20) for d in range(3)]), ["at"])
    before = held(table.read())
    bad = rows(spark, *[(a, d, 2, 0) for a in range(20) for d in range(3)])
    # Some partitions are written when the row of another one fails.
    stop = F.when((F.col("account") == 7) & (F.col("day") == F.lit(DAY + timedelta(days=1))), F.raise_error(F.lit("lost"))).otherwise(F.col("equity"))
    broken = VersionedTable(spark, table.store.root, SCHEMA, ["account", "day"], "day")
    monkeypatch.setattr(broken, "_content", lambda: F.struct(*[stop.cast("decimal(10,2)").alias("equity") if c == "equity" else F.col(c) for c in broken.others]))
    with pytest.raises(Exception, match="lost"):
        broken.upsert(bad, ["at"])
    assert held(table.read()) == before and table.version() == 1

    def dies(manifest):
        raise OSError("the driver is gone")

    monkeypatch.setattr(table, "publish", dies)
    with pytest.raises(OSError, match="gone"):
        table.upsert(bad, ["at"])
    monkeypatch.undo()
    assert held(table.read()) == before
    assert table.upsert(bad, ["at"]) == Commit(2, 0, 60)


def test_two_writers(spark, table):
    table.upsert(rows(spark, (1, 0, 1, 0)), ["at"])
    other = VersionedTable(spark, table.store.root, SCHEMA, ["account", "day"], "day")
    publish = other.publish

    def late(manifest):
        table.upsert(rows(spark, (2, 0, 2, 0)), ["at"])
        publish(manifest)

    other.publish = late
    with pytest.raises(Conflict):
        other.upsert(rows(spark, (3, 0, 3, 0)), ["at"])
    assert held(table.read()) == [(1, 0, 1), (2, 0, 2)] and not table.store.names("aside")


def test_batches_of_a_stream_count_once(spark, table):
    first = rows(spark, (1, 0, 1, 0))
    assert table.upsert(first, ["at"], batch=("s", 0)) == Commit(1, 1)
    assert table.upsert(rows(spark, (1, 0, 9, 0)), ["at"], batch=("s", 0)) == Commit(1)
    assert table.upsert(first, ["at"], batch=("s", 1)) == Commit(2, 0, 0, 1)
    assert table.upsert(first, ["at"], batch=("t", 0)) == Commit(3, 0, 0, 1)


def test_bootstrap_and_vacuum(spark, table):
    assert table.bootstrap(lambda: rows(spark, (1, 0, 1, 0), (1, 1, 1, 0)), ["at"]) == Commit(1, 2)
    assert table.bootstrap(lambda: 1 / 0, ["at"]) is None
    for n in range(2, 5):
        table.upsert(rows(spark, (1, 0, n, 0)), ["at"])
    assert table.vacuum(keep=1) == 2 and held(table.read()) == [(1, 0, 4), (1, 1, 1)] and table.versions() == [4]


def test_keys_alone_and_a_partition_that_is_no_key(spark, tmp_path):
    only = VersionedTable(spark, str(tmp_path / "only"), "a int, b string", ["a", "b"], "b")
    two = spark.createDataFrame([(1, "x/y=z"), (1, "x/y=z"), (2, None)], "a int, b string")
    assert only.insert_new(two, []) == Commit(1, 2) and only.insert_new(two, []) == Commit(1, 0, 0, 2)
    with pytest.raises(ValueError, match="must be a key"):
        VersionedTable(spark, "x", "a int, b int", ["a"], "b")
