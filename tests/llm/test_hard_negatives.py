import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import hard_negatives as h
from ledgerloom.llm.hard_negatives import grouped, highest, mine, scores

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, is_anchor, scale=256):
    rows = [(i, [math.floor(scale * c) for c in v], label) for i, v, label in rows if v and label is not None and i is not None and all(c is not None and math.isfinite(c) for c in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for at, (i, v, label) in enumerate(rows):
        if not is_anchor(i):
            continue
        scored = [(-dot(v, w), j, other) for k, (j, w, other) in enumerate(rows) if k != at]
        for s, j, _ in sorted(x for x in scored if x[2] == label)[:5]:
            band = sorted(x[:2] for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s)
            out += [(i, j, rank, other, -s, -score) for rank, (score, other) in enumerate(band[:10], 1)]
    return sorted(out)


def clustered(rng, n, size=6, centres=5, spread=0.15, lengths=(0.5, 1.5)):
    middle = rng.normal(size=(centres, size))
    rows = []
    for i in range(n):
        v = middle[rng.integers(centres)] + spread * rng.normal(size=size)
        rows.append((int(i), [float(c) for c in v / np.linalg.norm(v) * rng.uniform(*lengths)], int(rng.integers(4))))
    return rows


def mined(spark, rows, by=7, schema=SCHEMA):
    return sorted(tuple(r) for r in mine(spark.createDataFrame(rows, schema), F.col("vec_id") % by == 0).collect())


@pytest.fixture
def small(monkeypatch):
    """Many pivots, groups, splits and chunks on few rows."""
    for name, value in {"CELL_ROWS": 12, "ANCHORS": 5, "CHUNK": 40, "LEAST_CHUNK": 30, "BLOCK": 3, "AROUND": 3}.items():
        monkeypatch.setattr(h, name, value)


@pytest.mark.parametrize("seed", [0, 1])
def test_against_brute_force(spark, small, seed):
    rng = np.random.default_rng(seed)
    rows = clustered(rng, 240, spread=(0.05, 0.6)[seed])
    rows += [(1000 + i, rows[7][1], 2) for i in range(25)] + [(7, rows[7][1], 1), (2000, [0.0] * 6, 1), (2002, [0.0] * 6, 1)]
    rows += [(49, None, 1), (56, rows[3][1], None), (63, [float("nan")] * 6, 1), (70, [None] * 6, 1), (None, rows[3][1], 1), (77, [float("inf")] * 6, 0), (84, [], 0)]
    want = brute(rows, lambda i: i % 7 == 0)
    assert len(want) > 400 and mined(spark, rows) == want


def test_bounds_spare_work_and_lose_nothing(spark, small, monkeypatch):
    rows = clustered(np.random.default_rng(5), 300, centres=8, spread=0.02, lengths=(1.0, 1.0))
    counted = []
    keep = h._copied

    def watch(*args):
        out = keep(*args)
        counted.append((out.count(), args[0].count() * sum(args[3])))
        return out

    monkeypatch.setattr(h, "_copied", watch)
    assert mined(spark, rows) == brute(rows, lambda i: i % 7 == 0)
    (near, all_near), (band, all_band) = counted
    assert near < 0.5 * all_near and band < all_band


def test_production_sizes_and_float_entries(spark):
    rows = clustered(np.random.default_rng(2), 200, size=16)
    narrow = [(i, np.float32(v).tolist(), label) for i, v, label in rows]
    docs = spark.createDataFrame([(*r, 1.0, "c") for r in narrow], "vec_id int, embedding array<float>, label long, dist double, cell string")
    assert sorted(tuple(r) for r in mine(docs, F.col("vec_id") % 7 == 0).collect()) == brute(narrow, lambda i: i % 7 == 0)


def test_few_rows_and_none(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 0)]) == [] and mined(spark, [(1, [1.0], 0), (2, [1.0], 0)]) == []
    assert mined(spark, [(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.5, 0.5], 1), (3, [-1.0, 0.0], 1)]) == [(0, 1, 1, 2, 65536, 32768)]
    assert mined(spark, [(0, [1.0, 0.0], 0), (1, [-1.0, 0.0], 0), (2, [-0.5, 0.5], 1)]) == []
    assert mined(spark, [(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [0.0, -1.0], 1)]) == [(0, 1, 1, 2, 0, 0)]


def test_vectors_of_another_size_take_no_part(spark):
    rows = clustered(np.random.default_rng(3), 60, size=3)
    assert mined(spark, rows + [(700, [1.0, 2.0], 1)]) == brute(rows, lambda i: i % 7 == 0)


def test_highest():
    rng = np.random.default_rng(1)
    for big in (1, 2**58):
        scored, allowed = rng.integers(-3, 4, (20, 9)) * big, rng.random((20, 9)) < 0.5
        at, column = highest(scored, allowed, 4)
        for i in range(20):
            assert sorted(column[at == i].tolist()) == sorted(sorted(np.flatnonzero(allowed[i]).tolist(), key=lambda j: (-scored[i, j], j))[:4])


def test_scores_are_exact():
    a = np.array([[2**30, 1], [3, -5]], np.int64)
    assert scores(a, a).tolist() == [[2**60 + 1, 3 * 2**30 - 5], [3 * 2**30 - 5, 34]]


def test_groups_of_anchors(monkeypatch):
    monkeypatch.setattr(h, "ANCHORS", 10)
    group, splits = grouped(np.array([4, 35, 0, 5]), np.abs(np.subtract.outer([0, 9, 1, 2], [0, 9, 1, 2])).astype(float))
    assert group == [0, 1, 0, 0] and splits == [1, 4]
