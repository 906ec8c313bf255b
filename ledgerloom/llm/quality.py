"""Quality by fixed rules and by a hashed n-gram log-likelihood ratio, in DataFrame operations only.

Words and pairs of neighbouring words are hashed into BUCKETS. A multinomial over the buckets is estimated from
trusted rows, another from all rows; a document's score is the mean over its n-grams of the log of their ratio,
and every document is held against the same threshold. Both multinomials are smoothed by the same share of each
bucket, so a bucket of which too little is known to tell them apart has a ratio near 1 at every size of corpus.
The threshold is found on trusted rows that the multinomial has not seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .learning import fold

BUCKETS = 1 << 16
#: All good rows are trusted. One fold in HELD_OUT of them sets the threshold, the others make the multinomial.
HELD_OUT = 5
#: Ids that are broadcast at most; more are joined by a shuffle.
BROADCAST = 2_000_000
#: Parts of the range of scores, of which the one that holds a quantile is sorted.
BINS = 1 << 16
#: Added to each bucket, on the scale of the trusted rows' counts.
SMOOTHING = 0.5
#: The threshold lies where so many of the held-out trusted rows score lower, less a part of the way from there
#: to their median, as that quantile is itself an estimate.
GOOD_LOSS, MARGIN = 0.005, 0.25
WINDOW = 5

_SPACES = " \t\n\x0b\x0c\r"
_HAS_WORD = r"[^\x20\x09-\x0D]"


def _word_hashes(text: Column) -> Column:
    """Of every word in order; words are what white space parts."""
    trimmed = F.btrim(text, F.lit(_SPACES))
    return F.when(trimmed == "", F.expr("array()").cast("array<bigint>")).otherwise(F.transform(F.split(trimmed, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w)))


def _buckets() -> Column:
    """Of every word, then of every pair, from column `hashes`."""
    single = F.expr(f"transform(hashes, h -> cast(pmod(h, {BUCKETS}) as int))")
    pairs = F.expr(f"if(size(hashes) < 2, array(), transform(sequence(0, size(hashes) - 2), i -> cast(pmod(xxhash64(hashes[i], hashes[i + 1]), {BUCKETS}) as int)))")
    return F.concat(single, pairs)


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality", most: int | None = None) -> DataFrame:
    """(__id, held): ids of all good rows, and whether they are kept out of the multinomial.

    With `most`, only so many of the least hash. Then only ids of a low hash are sorted: by their number, a tenth more
    than `most` and a thousand lie below that, which for hashes is dozens of standard deviations from too few.
    """
    good = labels.filter(F.col(quality_col) == 1).select(F.col(id_col).alias("__id")).filter("__id is not null").distinct()
    if most is not None:
        good = cut(good, "good-ids")
        n = good.count()
        low = good if n <= most else good.filter(F.xxhash64("__id") / F.lit(2.0**64) + 0.5 <= (1.1 * most + 1000) / n)
        good = low.orderBy(F.xxhash64("__id"), "__id").limit(most)
    return cut(good.withColumn("held", fold(F.col("__id"), HELD_OUT) == 0), "trusted")


def _beside(ids: DataFrame, broadcast: int) -> DataFrame:
    """ids as the smaller side of a join: sent to all tasks while they are few, else hashed by partitions, so that the
    texts are moved once and not sorted."""
    return F.broadcast(ids) if ids.count() <= broadcast else ids.hint("shuffle_hash")


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast: int = BROADCAST) -> DataFrame:
    """(bucket, ratio) for every bucket of the corpus: at most BUCKETS rows. trusted is (__id, ...), distinct."""
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    rows = rows.join(_beside(trusted.select("__id", F.lit(1).alias("good")), broadcast), "__id", "left")
    hashed = rows.select(F.coalesce("good", F.lit(0)).alias("good"), _word_hashes(F.coalesce("__text", F.lit(""))).alias("hashes"))
    grams = hashed.select("good", F.explode(_buckets()).alias("bucket"))
    counts = cut(grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("target")), "bucket-counts", 1)
    totals = counts.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    raw, target = totals["raw"] or 0, totals["target"] or 0
    # Without trusted rows there is nothing to prefer, so every ratio is 0.
    expected = F.col("raw") * F.lit(target / raw if raw else 0.0)
    ratio = F.log((F.col("target") + SMOOTHING) / (expected + SMOOTHING)) if target else F.lit(0.0)
    return counts.select("bucket", ratio.alias("ratio"))


def _repeat_words() -> Column:
    """Words within windows of WINDOW words that the document has twice or more, from column `windows`."""
    covered = f"""
      aggregate(sequence(0, size(again) - 1), 0L,
                (total, k) -> total + if(k + 1 < size(again), least({WINDOW}, again[k + 1] - again[k]), {WINDOW}))"""
    again = """
      array_sort(transform(
        filter(transform(pairs, (p, k) -> if(p.h = get(pairs, k - 1).h or p.h = get(pairs, k + 1).h, p.i, -1)), i -> i >= 0), i -> i))"""
    # let-bindings by one-element arrays: sorted (hash, position) pairs, then the repeated positions.
    bound = f"""
      transform(array(sort_array(transform(windows, (h, i) -> named_struct('h', h, 'i', i)))),
                pairs -> transform(array({again}), again -> if(size(again) = 0, 0L, {covered}))[0])[0]"""
    return F.expr(f"if(size(array_distinct(windows)) = size(windows), 0L, {bound})")


def scored(docs: DataFrame, ratios: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score of every document."""
    # At most BUCKETS numbers, whatever the corpus, as one array literal; 0 for buckets that the corpus lacks.
    known = {r.bucket: r.ratio for r in ratios.collect()}
    table = F.split(F.lit(",".join(f"{known.get(b, 0.0):.5g}" for b in range(BUCKETS))), ",").cast("array<double>")
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(_HAS_WORD))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        _word_hashes(text).alias("hashes"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", ""))).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))[0].alias("n_dup_lines"),
    )
    at = ", ".join(f"hashes[i + {k}]" for k in range(WINDOW))
    windows = F.expr(f"if(size(hashes) < {WINDOW}, array(), transform(sequence(0, size(hashes) - {WINDOW}), i -> xxhash64({at})))")
    n, word = F.size("hashes"), lambda i: F.get(F.col("hashes"), i)
    ratio = lambda h: F.get(table, F.pmod(h, F.lit(BUCKETS)).cast("int"))
    single = F.aggregate("hashes", F.lit(0.0), lambda total, h: total + ratio(h))
    pairs = F.when(n > 1, F.aggregate(F.sequence(F.lit(0), n - 2), F.lit(0.0), lambda total, i: total + ratio(F.xxhash64(word(i), word(i + 1))))).otherwise(0.0)
    mean = (single + pairs) / F.greatest(2 * n - 1, F.lit(1))
    plain = ["doc_id", n.cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines"]
    wide = base.select(*plain, windows.alias("windows"), mean.alias("score"))
    counted = wide.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", _repeat_words().alias("n_repeat_words"), "score")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def _quantiles(rows: DataFrame, column: str, wanted: list[float], bins: int = BINS) -> list[float] | None:
    """Exact quantiles, between two values by their distance; None without rows. The driver gets the number of rows
    in each part of the range; only the parts that hold a wanted place are sorted."""
    n, low, high = rows.agg(F.count(column), F.min(column), F.max(column)).first()
    if not n:
        return None
    # All of one value are one part.
    part = F.lit(0) if low == high else F.least(F.floor((F.col(column) - low) / F.lit((high - low) / bins)), F.lit(bins - 1))
    held = rows.filter(F.col(column).isNotNull()).select(column, part.cast("int").alias("part"))
    sizes = sorted(map(tuple, held.groupBy("part").count().collect()))

    def at(place: int) -> float:
        for of, size in sizes:
            if place < size:
                return low if low == high else held.filter(F.col("part") == of).orderBy(column).offset(place).limit(1).first()[0]
            place -= size
        return high

    out = []
    for q in wanted:
        place = q * (n - 1)
        below = at(int(place))
        out.append(below if place == int(place) else below + (place - int(place)) * (at(int(place) + 1) - below))
    return out


def threshold_of(scores: DataFrame, trusted: DataFrame, broadcast: int = BROADCAST) -> float | None:
    """Where the held-out trusted rows end; None if there is none. A few numbers come to the driver."""
    ids = trusted.filter("held").select(F.col("__id").alias("doc_id"))
    held = cut(scores.filter("not base_failed").select("doc_id", "score").join(_beside(ids, broadcast), "doc_id", "left_semi").select("score"), "held-scores")
    ends = _quantiles(held, "score", [GOOD_LOSS, 0.5])
    return None if ends is None else ends[0] - MARGIN * (ends[1] - ends[0])


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float | None = None) -> DataFrame:
    """Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    One row per input row. Null text counts as empty: no words, so base_failed. A document without n-grams
    scores 0. kept is false where base_failed, else score >= threshold, which is found on held-out trusted rows
    if not given; without such rows no score is below it. With no trusted row all scores are 0. Repeated rows
    and null ids stay as they are; other columns are not read.
    """
    trusted = trusted_ids(labels, id_col)
    ratios = log_ratios(docs, trusted.filter("not held"), id_col, text_col)
    scores = cut(scored(docs, ratios, id_col, text_col), "scores")
    least = threshold_of(scores, trusted) if threshold is None else threshold
    enough = F.lit(True) if least is None else F.col("score") >= least
    return scores.withColumn("kept", ~F.col("base_failed") & enough)
