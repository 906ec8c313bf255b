"""The replay does not depend on how the events lie in files."""

import os
import random
from datetime import datetime, timedelta

import pytest

from ledgerloom.operators import equity
from ledgerloom.sources import views
from ledgerloom.streaming.equity import replayed_points

T = datetime(2024, 1, 1)


@pytest.mark.parametrize("order", ["reverse", "shuffled"])
def test_replay_of_several_files_equals_the_batch(spark, tmp_path, order):
    # Two snapshots of the account in each bucket, 20 days, one event stated twice.
    events = [(k, T + timedelta(days=k // 2, minutes=k % 2), 1, "view", float(k), None) for k in range(40)]
    events.append(events[7])
    if order == "reverse":
        events.reverse()
    else:
        random.Random(5).shuffle(events)
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    for n in range(3):
        part = spark.createDataFrame(events[n::3] if order == "shuffled" else events[n * 14 : (n + 1) * 14], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
        part.coalesce(1).write.parquet(str(tmp_path / f"p{n}"))
        (file,) = (tmp_path / f"p{n}").glob("part-*.parquet")
        os.rename(file, folder / f"{n}.parquet")
        os.utime(folder / f"{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    want = equity.points(views.balance_snapshots(spark, str(tmp_path)))
    columns = ["bucket_time", "total_equity", "account_count"]
    got = replayed_points(spark, str(tmp_path))
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
