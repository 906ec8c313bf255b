import hashlib
import random

import numpy as np
import pytest

from ledgerloom.llm import order_minhash as o
from ledgerloom.llm.order_minhash import edited, fingerprint_edits, fingerprints, likeness, read, signature, written

MASK = 2**64 - 1


def mixed(x):
    x = (x ^ x >> 31) * 0x7FB5D329728EA185 & MASK
    x = (x ^ x >> 27) * 0x81DADEF4BC2DD44D & MASK
    return x ^ x >> 33


STEPS = [mixed(i) | 1 for i in range(1, 9)]


def kmer(codes):
    width, at = 1, 0
    codes = [c + 1 for c in codes] + [0] * (o.KMER - len(codes))
    while width < o.KMER:
        codes = [(codes[i] * STEPS[at] + codes[i + width]) & MASK for i in range(len(codes) - width)]
        width, at = width * 2, at + 1
    return mixed(codes[0]) >> 64 - o.HASH_BITS


def brute(text):
    """Every permutation sorts all numbered k-mers."""
    seen, elements = {}, []
    for i in range(len(text)):
        piece = text[i : i + o.KMER]
        number, h = seen.get(piece, 0), kmer([ord(c) for c in piece])
        seen[piece] = number + 1
        elements.append((mixed((h * STEPS[6] + number) & MASK) >> 64 - o.HASH_BITS if number else h, i))
    out = []
    for j in range(o.SKETCHES if text else 0):
        number = j << o.HASH_BITS - 6
        least = sorted(elements, key=lambda e: (e[0] ^ number, e[1]))[: o.TUPLE]
        entry = len(least)
        for h, _ in sorted(least, key=lambda e: e[1]):
            entry = mixed((entry * STEPS[7] + h) & MASK)
        out.append(entry >> 48)
    return out


def texts():
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "née", "δέλτα", "🙂x", "zz"]) + str(rng.randrange(40)) for _ in range(n))
    base = prose(60)
    return [prose(n) for n in (1, 2, 9, 40, 200, 900)] + [base, base[:-3], base + "!", None, "", "a", "ab", "abcdefg", "abcdefgh", "a" * 700, "ab " * 1500, "\n \t"]


def test_signature_against_brute_force():
    for text in filter(None, texts()):
        assert signature(text).tolist() == brute(text)
    assert signature("").tolist() == []


def test_more_elements_than_are_sorted_and_long_places(monkeypatch):
    text = next(t for t in reversed(texts()) if t and len(t) > 4000)
    want = brute(text)
    for most in (1, 64, 300, 10**6):
        monkeypatch.setattr(o, "SORTED", most)
        assert signature(text).tolist() == want
    monkeypatch.setattr(o, "_PLACES", np.uint64(1000))
    assert signature(text).tolist() == want


def test_likeness_falls_with_edits_and_moves():
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**5)}" for _ in range(300)]
    near = lambda other: likeness(signature(" ".join(words)), signature(" ".join(other)))
    changed = [near([f"x{i}" if i % step == 0 else w for i, w in enumerate(words)]) for step in (100, 30, 8, 1)]
    assert near(words) == 1.0 and changed == sorted(changed, reverse=True) and changed[0] > 0.7 and changed[-1] == 0
    shuffled = [words[i : i + 3] for i in range(0, 300, 3)]
    rng.shuffle(shuffled)
    kept = near(sum(shuffled, []))
    # Sets of k-mers are nearly as alike as when nothing has moved, but half of the pairs have turned about.
    assert kept < 0.55
    assert likeness(signature(""), signature("")) == 1.0 and likeness(signature(""), signature("a")) == 0.0


def by_hand(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    out = []
    for i, (doc, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        q = len(text) // 4
        after = text[: len(text) - q] + following[:q]
        own = signature(text)
        out.append((doc, len(text), hashlib.sha256(after.encode()).hexdigest(), written(own), written(signature(after)), likeness(own, signature(after)), likeness(own, signature(following))))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 7])
def test_against_a_sorted_list(spark, parts):
    rows = [((i * 7) % 19, t) for i, t in enumerate(texts())] + [(None, "no id"), (None, "none either"), (3, "twice"), (3, "twice"), (3, "thrice")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, part string, n_chars int, sha string")
        got = [tuple(r) for r in fingerprint_edits(docs).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(got, key=str) == by_hand(rows)


def test_one_document_and_none(spark):
    schema = "doc_id long, text string"
    assert fingerprint_edits(spark.createDataFrame([], schema)).collect() == []
    (one,) = fingerprint_edits(spark.createDataFrame([(4, "abcdefghijklmnop")], schema)).collect()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcdefghijklabcd").hexdigest()
    (none,) = fingerprint_edits(spark.createDataFrame([(4, None)], schema)).collect()
    assert (none.n_chars, none.fingerprint, none.edited_fingerprint, none.near_edited, none.near_next) == (0, "", "", 1.0, 1.0)


def test_fingerprints(spark):
    docs = spark.createDataFrame([("a", "some text"), ("b", "some text"), (None, None), ("c", "x" * 3_000_000)], "name string, body string")
    got = {r.name: (r.n_chars, r.fingerprint) for r in fingerprints(docs, "name", "body").collect()}
    assert got["a"] == got["b"] == (9, written(signature("some text"))) and got[None] == (0, "") and got["c"][0] == 3_000_000
    assert read(got["a"][1]).tolist() == brute("some text")
    assert edited("abcdefgh", "XYZ") == "abcdefXY" and edited("abcdefgh", "X") == "abcdefX" and edited("abc", "X") == "abc"
