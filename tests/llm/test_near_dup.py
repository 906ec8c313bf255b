import random

import numpy as np
import pytest

from ledgerloom.llm import near_dup
from ledgerloom.llm.graph import components
from ledgerloom.llm.near_dup import Frequencies, counted_keys, document_frequencies, near_duplicates, prefix, sketch
from ledgerloom.llm.shingles import shingle_sets


def words(text):
    return (text or "").encode().lower().split()


def sets_of(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [sets_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), doc) if x is not None), default=None)
    return sorted(((doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows)), key=str)


def edited(rng, text, share):
    w = text.split()
    for _ in range(max(1, int(len(w) * share))):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    make = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    texts = [make(rng.randrange(0, 120)) for _ in range(40)]
    base, passage = make(90), make(40)
    texts += [edited(rng, base, share) for share in [0.01] * 30 + [0.02] * 20 + [0.03] * 20]
    texts += [passage + " " + make(k) for k in range(0, 40, 2)] + [passage] * 5
    texts += [t for t in texts[:10] for _ in range(3)]
    texts += [None, "", " \n", "a b", "A  B", "a b c d e", "A b C d E", "x y z w v", "É é é é é", "é é é é é"]
    rng.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)] + [(100_001, "a b"), (100_001, "q r s t u v"), (None, "a b c d e")]


def test_against_brute_force(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, digest string, n int")
    out = near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == brute(rows)
    kept = [r.component_id for r in out if r.kept and r.n_shingles]
    assert len(kept) == len(set(kept)) and {r.component_id for r in out if r.n_shingles} == set(kept)


def test_against_brute_force_when_all_is_frequent(spark, rows, monkeypatch):
    monkeypatch.setattr(near_dup, "FREQUENT", 2)
    monkeypatch.setattr(near_dup, "MOST_FREQUENT", 50)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("worth", [0.0, 1.0])
def test_against_brute_force_when_shingles_are_dealt_in_cells(spark, rows, monkeypatch, worth):
    monkeypatch.setattr(near_dup, "CELL", 3)
    monkeypatch.setattr(near_dup, "WORTH", worth)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()), key=str) == brute(rows)


def test_a_shingle_of_all_documents_is_sent_once():
    rng = np.random.default_rng(2)
    hot = np.uint64(12345678901234567890)
    few, many = (np.concatenate([np.full(n, hot), rng.integers(0, 2**63, 50, dtype=np.uint64)]) for n in (10, 200_000))
    for given in (few, many):
        keys, n = counted_keys(given, 10)
        assert len(keys) == 51 and n.sum() == len(given) and (np.diff(keys.astype(object)) > 0).all()
        assert n[keys == hot >> np.uint64(22)].tolist() == [len(given) - 50]


def test_frequencies_against_counters(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "FLUSH", 200)
    monkeypatch.setattr(near_dup, "FREQUENT", 3)
    rng = random.Random(1)
    texts = ["to all of them common " + " ".join(rng.choice("abcdef") for _ in range(rng.randrange(12))) for _ in range(300)]
    df = spark.createDataFrame([(t.encode(),) for t in texts], "text binary").repartition(3)
    known = document_frequencies(df, len(texts))
    every = np.concatenate(list(shingle_sets([t.encode() for t in texts])))
    values, n = np.unique(every, return_counts=True)
    assert n.max() == 300 and known.of(values).tolist() == np.where(n >= 3, n, 0).tolist()
    assert known.shared(values[n > 1]).all()


def test_prefixes_of_similar_sets_share_enough():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 2**63, int(rng.integers(0, 5)), dtype=np.uint64)]))
        common = np.intersect1d(a, b)
        if not len(common) or 100 * len(common) < 80 * len(np.union1d(a, b)):
            continue
        bits = np.zeros(1 << 13, np.uint8)
        at = np.concatenate([common, a[:3]]) >> np.uint64(48)
        np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(int), (np.uint8(128) >> (at & np.uint64(7)).astype(np.uint8)))
        often = np.sort(rng.choice(common, min(len(common), int(rng.integers(0, 30))), replace=False))
        known = Frequencies(8, 16, bits, np.unique(often >> np.uint64(24)), rng.integers(32, 5000, len(np.unique(often >> np.uint64(24)))))
        la, _, pa_ = prefix(a, known)
        lb, _, pb_ = prefix(b, known)
        assert len(np.intersect1d(pa_, pb_)) >= min(la, lb)
        differ = sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(sketch(a), sketch(b), strict=True))
        assert differ <= len(np.setxor1d(a, b))


def test_shingles_of_long_and_odd_texts():
    texts = ["a b c d e f " * 100_000, "", None, "one", "Ünder x y z q w", "x " * 7]
    got = list(shingle_sets([t.encode() if t is not None else None for t in texts]))
    assert [len(g) for g in got] == [len(sets_of(t)) for t in texts]


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_classes(spark):
    classes = spark.createDataFrame([(i, i // 3 * 3) for i in range(30)], "node long, root long")
    got = {r.node: r.root for r in components(spark.createDataFrame([(1, 5), (10, 3), (20, 20)], "a long, b long"), classes=classes).collect()}
    assert sorted(got) == list(range(30)) and len({got[i] for i in (0, 1, 2, 3, 4, 5, 9, 10, 11)}) == 1
    assert got[20] == got[18] and len(set(got.values())) == 8


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert len({got[i] for i in range(61)}) == 1 and got[100] == got[101] != got[0]
