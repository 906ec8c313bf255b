import re
import zlib
from collections import Counter
from math import log

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm.quality import BUCKETS, GOOD_LOSS, MARGIN, SMOOTHING, quality, trusted_ids

TEXTS = [
    None, "", " \n\t", "one two three", "a b c d e " * 6, "same line\nsame line\n\n\nsame line \nother words here now and then again so it goes",
    "é ñ ü # * $ % & | < > plain words to make ten of them in all", "x " * 500, " ".join(f"w{i}" for i in range(300)),
    " ".join(f"w{i}" for i in range(30)) + " " + " ".join(f"w{i}" for i in range(10, 20)), "a a a a a a b", "1 2 3 4 5 6 1 2 3 4 5 7",
]


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n)


def grams(text):
    seed = lambda x, by: xxhash.xxh64_intdigest(x, seed=by)
    hashes = [seed(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    pairs = [seed(b.to_bytes(8, "little"), seed(a.to_bytes(8, "little"), 42)) for a, b in zip(hashes, hashes[1:])]  # noqa: B905
    return [h % BUCKETS for h in hashes + pairs]


def brute_scores(rows, good):
    """Of (doc_id, text) rows: scores, and the threshold of the held-out good ones."""
    raw, target = Counter(), Counter()
    held = {i for i in good if zlib.crc32(str(i).encode()) % 5 == 0}
    for i, text in rows:
        raw.update(grams(text))
        target.update(grams(text) if i in good - held else ())
    share = sum(target.values()) / sum(raw.values())
    ratio = {b: float(f"{log((target[b] + SMOOTHING) / (raw[b] * share + SMOOTHING)):.5g}") for b in raw} if target else {}
    scores = [sum(ratio.get(b, 0.0) for b in grams(t)) / max(1, len(grams(t))) for _, t in rows]
    own = [s for (i, t), s in zip(rows, scores, strict=True) if i in held and not brute(t)[-1]]
    low, middle = (np.quantile(own, q) for q in (GOOD_LOSS, 0.5)) if own else (None, None)
    return scores, None if low is None else low - MARGIN * (middle - low)


def frames(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, "again", ""), (None, "b " * 12, "")], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(8, 1), (9, 1), (6, 1), (4, 0), (None, 1), (8, 1)], "doc_id long, quality int")
    return docs, labels


def test_against_brute_force(spark):
    docs, labels = frames(spark)
    rows = quality(docs, labels).collect()
    texts = Counter((r.doc_id, *brute(r.text)) for r in docs.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == texts
    assert not any(r.kept for r in rows if r.base_failed)


@pytest.mark.parametrize("seed", [1, 2])
def test_scores_and_threshold_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    make = lambda words: " ".join(rng.choice(words, int(rng.integers(12, 60))))
    clean, junk = [f"c{i}" for i in range(80)], [f"j{i}!!" for i in range(80)]
    rows = [(i, make(junk if i % 9 == 0 else clean)) for i in range(300)] + [(None, make(clean)), (7, make(junk)), (301, ""), (302, None)]
    good = {i for i in range(150) if i % 9}
    labels = spark.createDataFrame([(i, int(i in good)) for i in range(150)], "doc_id long, quality int")
    got = quality(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    scores, least = brute_scores(rows, good)
    for r, (i, text), want in zip(sorted(got, key=lambda r: (str(r.doc_id), r.score)), *zip(*sorted(zip(rows, scores, strict=True), key=lambda x: (str(x[0][0]), x[1]))), strict=True):
        assert r.doc_id == i and r.score == pytest.approx(want, abs=1e-4)
        assert r.kept == (not brute(text)[-1] and want >= least) or abs(want - least) < 1e-3
    kept = {r.doc_id for r in got if r.kept}
    assert not kept & set(range(0, 300, 9)) and len(kept) >= 0.97 * 266


def test_clean_rows_stay_at_every_size(spark):
    """Rows like the trusted ones stay whether they are few or many, though most of their pairs are new."""
    rng = np.random.default_rng(3)
    words = [f"c{i}" for i in range(3000)]
    for n in (60, 240, 960):
        rows = [(i, " ".join(rng.choice(words, 40))) for i in range(n)]
        labels = spark.createDataFrame([(i, 1) for i in range(0, n, 2)], "doc_id long, quality int")
        got = quality(spark.createDataFrame(rows, "doc_id long, text string"), labels).filter("doc_id % 2 = 1").agg(F.avg(F.col("kept").cast("double"))).first()[0]
        assert got > 0.9


def test_without_trusted_rows_or_documents(spark):
    docs, labels = frames(spark)
    assert {r.score for r in quality(docs, labels.filter("quality = 5")).collect()} == {0.0}
    assert quality(docs.limit(0), labels).count() == 0


def test_plan_is_native(spark):
    plan = quality(*frames(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i % 1000}" for i in range(60_000)))], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    row = quality(docs, labels).select(F.col("n_repeat_words"), "n_words").first()
    assert (row.n_repeat_words, row.n_words) == (60_000, 60_000)


def test_trusted_ids_are_those_of_the_least_hash(spark):
    labels = spark.range(30_000).select(F.col("id").alias("doc_id"), (F.col("id") % 3 > 0).cast("int").alias("quality"))
    labels = labels.union(labels.limit(50)).union(spark.createDataFrame([(None, 1)], "doc_id long, quality int"))
    hashed = labels.filter("quality = 1 and doc_id is not null").distinct().select("doc_id", F.xxhash64("doc_id").alias("h"))
    order = [r.doc_id for r in hashed.orderBy("h", "doc_id").collect()]
    for most in (10, 3000, 50_000):
        assert {r["__id"] for r in trusted_ids(labels, most=most).collect()} == set(order[:most])


def test_all_good_rows_are_trusted(spark):
    labels = spark.range(200_300).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert trusted_ids(labels).count() == 200_300


def test_few_and_many_trusted_ids_give_the_same(spark):
    from ledgerloom.llm.quality import log_ratios, threshold_of

    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in rng.integers(0, 50, 15))) for i in range(80)] + [(None, "w1 w2")], "doc_id long, text string")
    trusted = trusted_ids(spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(90)], "doc_id long, quality int"))
    few, many = (sorted(map(tuple, log_ratios(docs, trusted, broadcast=n).collect())) for n in (1000, 0))
    assert few == many and len(few) > 50
    scores = docs.select("doc_id", F.lit(False).alias("base_failed"), (F.hash("doc_id") / 7).alias("score"))
    assert threshold_of(scores, trusted) == threshold_of(scores, trusted, broadcast=0)


def test_quantiles_are_exact(spark):
    from ledgerloom.llm.quality import _quantiles

    rng = np.random.default_rng(6)
    for values in (rng.normal(size=501).round(1), rng.normal(size=500) ** 5, np.full(9, 2.5), np.array([3.0])):
        rows = spark.createDataFrame([(float(v),) for v in values], "score double")
        assert _quantiles(rows, "score", [0.005, 0.5], bins=7) == pytest.approx(list(np.quantile(values, [0.005, 0.5])), abs=1e-12)
    assert _quantiles(spark.createDataFrame([], "score double"), "score", [0.5]) is None
