import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.mixing import _permuted, block_draws, mix, shard_counts, targets


def filled(sizes, weights=(5, 2, 1)):
    """Targets by rounds, as stated."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    full = [False] * len(sizes)
    while True:
        left = sum(sizes) - sum(3 * s for s, f in zip(sizes, full) if f)
        share = sum(x for x, f in zip(w, full) if not f)
        out = [3.0 * s if f else left * x / share for s, f, x in zip(sizes, full, w)]
        more = [not f and t > 3 * s for t, s, f in zip(out, sizes, full)]
        if not any(more):
            return out
        full = [f or m for f, m in zip(full, more)]


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 100, 100, 1, 5000], [7], [0, 3, 900], [1, 1, 1, 1, 1000, 3, 2, 2]])
def test_targets(spark, sizes):
    rows = [(f"s{i}", s) for i, s in enumerate(sizes)]
    got = {r.source: r.target for r in targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(filled(sizes))


def test_permutations():
    for n in (1, 2, 3, 5, 17, 64, 1000):
        for key in (1, 99):
            k = np.arange(n)
            assert sorted(_permuted(k, np.full(n, n), np.full(n, key))) == list(range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    sources = ["b", "a", None, "é", "Z", "hot"]
    rows = [(i, "w " * rng.choice([0, 1, 3, 40, 700, 2000]), rng.choice([*sources, "hot", "hot"]), 1.0) for i in range(500)]
    rows += [(3, None, "a", 0.0), (3, "again and again", "a", 0.0), (None, "x y", "tiny", 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target double")


def test_mix(docs):
    out = mix(docs).collect()
    rows = docs.collect()
    assert len(out) == len(rows)
    size = {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    ordered = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip([size[s] for s in ordered], filled([size[s] for s in ordered]), strict=True))
    taken = {}
    for r in out:
        assert r.taken <= 3 * r["size"]
        assert r.target == pytest.approx(want[r.source_size])
        assert sum((s.end - s.start) * s.times for s in r.spans or []) == r.taken
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
    for s, n in taken.items():
        if s > 5000:
            assert n == pytest.approx(want[s], rel=0.03)
    key = ("doc_id", "size", "taken")
    again = sorted((tuple(r[k] for k in key) for r in mix(docs).collect()), key=str)
    assert again == sorted((tuple(r[k] for k in key) for r in out), key=str)


def test_no_words_and_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r["size"], r.taken) for r in mix(blank).collect()] == [(0, 0), (0, 0)]
    assert mix(blank.withColumn("source", F.lit(None).cast("string"))).count() == 2


def test_shards_draw_whole_counts():
    slots = np.array([9000, 900, 90, 10])
    drawn = shard_counts(slots, 100, (1, 2))
    assert (drawn.sum(axis=0) == slots).all() and (drawn.sum(axis=1) == 100).all() and (drawn >= 0).all()
    # Of the spread of multinomial counts: the first source's has a deviation of 3, a quota would have none.
    assert 2 < drawn[:, 0].std() < 4 and drawn[:, 1].std() > 2
    assert (shard_counts(slots, 100, (1, 2)) == drawn).all() and (shard_counts(slots, 100, (1, 3)) != drawn).any()


@pytest.mark.parametrize("slots", [4, 1024])
def test_draws_against_targets(spark, slots):
    plan = spark.createDataFrame([(0, 1000, 3000.0), (1, 640, 100.0), (2, 5, 5.0), (3, 0, 0.0), (4, 33, 60.0)], "rank int, source_size long, target double")
    drawn = block_draws(plan, block=8, slots=slots).collect()
    times = {}
    for r in drawn:
        times.setdefault(r.rank, {})[r.block] = r.times
    assert times[0] == dict.fromkeys(range(125), 3)
    assert len(times[1]) == sum(times[1].values()) == round(100 / 8) and set(times[1]) <= set(range(80))
    assert times[2] == {0: 1} and 3 not in times
    assert sum(times[4].values()) == round(60 * 5 / 33) and set(times[4].values()) <= {1, 2} and len(times[4]) == 5


def test_reruns_agree_for_any_split_of_the_rows(spark, docs):
    rows = [(i % 90, f"w{i % 7} " * (i % 50), f"s{i % 4}") for i in range(400)] + [(5, "same " * 40, "s1")] * 3
    make = lambda order, n: spark.createDataFrame(order, "doc_id long, text string, source string").repartition(n)
    seen = [sorted(map(tuple, mix(make(order, n)).select("doc_id", "size", "target", "taken").collect())) for order, n in ((rows, 1), (rows[::-1], 5), (rows[200:] + rows[:200], 3))]
    assert seen[0] == seen[1] == seen[2] and sum(r[3] for r in seen[0]) > 0
