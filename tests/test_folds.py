"""Folds kept by a stream equal the batch operators for files in any order, and their state ends."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import ops, reconcile
from ledgerloom.streaming.folds import OrderedFold, Reductions, Spaced, Sticky, flush, keyed, replayed

T = datetime(2024, 1, 1)
HOUR = 3_600_000_000


def stream(spark, path, rows, files, seed):
    """Rows dealt to files in any order, then the one that ends the waiting."""
    held = rows.collect()
    random.Random(seed).shuffle(held)
    for n in range(files):
        spark.createDataFrame(held[n::files], rows.schema).coalesce(1).write.mode("append").parquet(path)
    flush(spark).coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.mark.parametrize("seed", [1, 2])
def test_spaced_errors(spark, tmp_path, seed):
    rng = random.Random(seed)
    errors = spark.createDataFrame([(rng.randrange(3), "NET", rng.choice(["down", None]), T + timedelta(seconds=rng.randrange(90_000))) for _ in range(300)], "account_id int, error_type string, message string, occurred_at timestamp_ntz")
    rows = keyed(errors, ["account_id", "error_type", "message"], "occurred_at", [], F.lit("x"))
    got = replayed(spark, stream(spark, f"file://{tmp_path}/in", rows, 2, seed), Spaced(HOUR), "2 days", maxFilesPerTrigger=1)
    out = sorted(((json.loads(r.key)["account_id"], json.loads(r.key)["message"], r.at_us) for r in got.collect()), key=str)
    want = ops.error_runs(errors).select("account_id", "message", F.unix_micros(F.col("occurred_at").cast("timestamp")).alias("us"))
    assert out == sorted(map(tuple, want.collect()), key=str)


def test_sticky_status(spark, tmp_path):
    rng = random.Random(4)
    rows = [(a, T + timedelta(minutes=rng.randrange(200)), i, rng.choice(["PARTIAL", "COMPLETE", "COMPLETE", "UNSUPPORTED"]), rng.choice([True, False, None])) for i, a in enumerate([1, 2, 3] * 40)]
    updates = spark.createDataFrame(rows, "account_id int, at timestamp_ntz, job_id int, status string, authoritative boolean")
    value = F.concat_ws("|", "status", F.coalesce(F.col("authoritative").cast("string"), F.lit("false")))
    got = replayed(spark, stream(spark, f"file://{tmp_path}/in", keyed(updates, ["account_id"], "at", ["job_id"], value), 2, 7), Sticky(), "1 day", maxFilesPerTrigger=1)
    last = {json.loads(r.key)["account_id"]: r.value for r in got.groupBy("key").agg(F.max_by("value", "at_us").alias("value")).collect()}
    assert last == {r.account_id: r.status for r in reconcile.sticky_fold(updates, ["account_id"], ["at", "job_id"]).collect()}


def test_reductions():
    fold, show = Reductions(), lambda *given: [json.dumps({"position": p, "size": s}) for p, s in given]
    state, out = fold.take(None, 1, show(("A", "2"), ("A", "-1.5"), ("B", "1")))
    assert out == []
    state, out = fold.take(state, 2, show(("A", "3.5"), ("B", "0.5"), ("C", "1"), (None, None)))
    assert [json.loads(o) for o in out] == [{"position": "B", "before": "1", "after": "0.5"}]
    state, out = fold.take(state, 3, show((None, None)))
    assert [json.loads(o)["position"] for o in out] == ["A", "B", "C"] and state == "{}"


class Store:
    """Values or lists of one key, as Spark's handle gives them."""

    def __init__(self):
        self.held = []

    exists = lambda self: bool(self.held)
    get = lambda self: self.held

    def appendList(self, rows):  # noqa: N802  Spark's name
        self.held = self.held + rows

    def put(self, rows):
        self.held = rows

    update = put

    def clear(self):
        self.held = []


class Handle:
    def __init__(self):
        self.stores, self.timers = {}, []
        self.registerTimer = self.timers.append

    def getListState(self, name, schema):  # noqa: N802  Spark's name
        return self.stores.setdefault(name, Store())

    getValueState = getListState  # noqa: N815  Spark's name


def test_state_waits_for_the_watermark_and_ends():
    import pandas as pd

    handle, processor = Handle(), OrderedFold(Spaced(10_000))
    processor.init(handle)
    watermark = lambda ms: type("V", (), {"getCurrentWatermarkInMs": lambda self: ms})()
    rows = pd.DataFrame({"at_us": [9_500, 2_000, 30_000], "tie": ["", "", ""], "value": ["b", "a", "c"]})
    assert list(processor.handleInputRows(("k",), iter([rows]), watermark(0))) == [] and handle.timers == [2]
    (out,) = processor.handleExpiredTimer(("k",), watermark(11), None)
    assert out["value"].tolist() == ["a"] and [r[0] for r in handle.stores["pending"].held] == [30_000] and 30 in handle.timers
    (out,) = processor.handleExpiredTimer(("k",), watermark(30), None)
    assert out["value"].tolist() == ["c"] and not handle.stores["pending"].held and handle.timers[-1] == 41
    assert list(processor.handleExpiredTimer(("k",), watermark(41), None)) == []
    assert not handle.stores["state"].held
