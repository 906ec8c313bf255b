import math

import numpy as np
import pytest

from ledgerloom.llm import whitening
from ledgerloom.llm.whitening import deviations, fit, integer_rows, whitened_rows

SCHEMA = "vec_id long, embedding array<double>"


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    spread = rng.normal(size=(400, 6)) @ rng.normal(size=(6, 6)) + 50
    return [(i, v.tolist()) for i, v in enumerate(spread)]


def by_hand(rows, k):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows], object)
    n, sums = len(x), x.sum(axis=0)
    exact = n * x - sums
    centred = exact.astype(float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return (exact**2).sum(axis=1), centred @ axes / np.sqrt(values), values / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("k", [3, 32])
def test_against_numpy(spark, vectors, k):
    odd = [(1, None), (2, []), (3, [1.0] * 5 + [None]), (4, [float("nan")] + [1.0] * 5), (5, [float("-inf")] + [1.0] * 5), (6, [1.0] * 4)]
    docs = spark.createDataFrame([(*r, "t", 9) for r in vectors + odd], f"{SCHEMA}, x string, n int")
    out = whitened_rows(docs, components=k).collect()
    deviation, whitened, explained = by_hand(vectors, k)
    assert len(out) == len(vectors) * min(k, 6) and {r.n for r in out} == {len(vectors)}
    turns = {}
    for r in out:
        want = whitened[r.vec_id, r.component - 1]
        assert r.deviation == deviation[r.vec_id]
        assert abs(abs(r.whitened) - abs(want)) < 1e-8 and math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-9)
        if abs(want) > 1e-3:
            turns.setdefault(r.component, set()).add(r.whitened * want > 0)
    assert all(len(t) == 1 for t in turns.values())
    assert len({r.identity_error for r in out}) == 1 and 0 <= out[0].identity_error < 1e-9


def test_a_large_mean_and_a_small_spread(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [3e7 + float(a) / 8, float(b)]) for i, (a, b) in enumerate(rng.integers(0, 9, (300, 2)))]
    out = whitened_rows(spark.createDataFrame(rows, SCHEMA)).collect()
    deviation, whitened, _ = by_hand(rows, 2)
    assert all(r.deviation == deviation[r.vec_id] for r in out)
    assert max(abs(abs(r.whitened) - abs(whitened[r.vec_id, r.component - 1])) for r in out) < 1e-9


def test_rows_that_do_not_spread(spark):
    assert whitened_rows(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitened_rows(spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA)).collect() == []
    assert whitened_rows(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).collect() == []
    line = whitened_rows(spark.createDataFrame([(i % 5, [float(i), 2.0 * i, 7.0]) for i in range(50)] + [(None, [9.0, 18.0, 7.0])], SCHEMA)).collect()
    assert len(line) == 51 and {r.component for r in line} == {1} and math.isclose(line[0].explained, 1.0)


def test_float_entries_and_repeated_rows(spark):
    docs = spark.createDataFrame([(7, [0.1, -0.26]), (7, [0.1, -0.26]), (8, [0.5, 0.3])], "vec_id int, embedding array<float>")
    rows = integer_rows(docs)
    assert sorted(r.x for r in rows.collect()) == [[1_000_006, 999_983]] * 2 + [[1_000_032, 1_000_019]]
    assert fit(rows).sums.tolist() == [3_000_044, 2_999_985]
    assert len(whitened_rows(docs).collect()) == 3


def test_deviations_are_exact_or_null():
    large = np.array([[2**31, 2**30], [2**33, 5], [3, 4]])
    assert deviations(large) == [2**62 + 2**60, None, 25]
    assert deviations(large[2:]) == [25]


def test_too_many_dimensions(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MOST_DIMENSIONS", 2)
    with pytest.raises(ValueError, match="3 dimensions"):
        whitened_rows(spark.createDataFrame([(1, [1.0, 2.0, 3.0])], SCHEMA))
