"""Language of a text, by hierarchy: the family first, then one-versus-one linear support vector machines
between the languages of that family. Features are hashed n-grams of UTF-8 bytes, read from the whole text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .learning import bounded_sample, fold, linear_svm, texts_of

#: Families by language code; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "uralic": "fi et hu",
    "indic": "hi bn mr ne gu pa ur",
    "turkic": "tr az kk uz ky",
    "semitic": "ar he mt am",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
BUCKETS, ORDERS = 1 << 16, (1, 2, 3)
#: Labelled rows of a language and of all together, at most; characters of a short example; bytes of text at once.
SAMPLE, SAMPLE_ALL, WINDOW, GROUP = 1500, 24_000, 48, 400_000
#: ASCII letters stay, lower-cased; other ASCII becomes a space; bytes of longer characters stay.
_FOLDED = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint64)


def has_letter(text: str) -> bool:
    """Whether any character is of Unicode's category L."""
    return any(map(str.isalpha, text))


def folded(text: str) -> bytes:
    return f" {text.lower()} ".encode("utf-8", "replace")


def grams(pieces: list[tuple[bytes, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of pieces (bytes, starts), for each n: the bucket of every n-gram that begins within the first `starts` bytes
    of its piece, all pieces laid end to end, and how many each piece has."""
    sizes = np.array([len(b) for b, _ in pieces])
    codes = _FOLDED[np.frombuffer(b"".join(b for b, _ in pieces), np.uint8)]
    owner = np.repeat(np.arange(len(pieces)), sizes)
    begins = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < np.repeat([n for _, n in pieces], sizes)
    key = np.zeros(len(codes), np.uint64)
    for n in ORDERS:
        key = key[: len(codes) - n + 1] * np.uint64(257) + codes[n - 1 :]
        inside = (owner[: len(key)] == owner[n - 1 :]) & begins[: len(key)]
        inside &= (codes[: len(key)] != 32) | (codes[n - 1 :] != 32)
        buckets = ((key[inside] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(48)
        yield buckets.astype(np.int64), np.bincount(owner[: len(key)][inside], minlength=len(pieces))


def segments(texts: list[str | None], keep: list[int], group_bytes: int = GROUP) -> Iterator[list[tuple[int, bytes, int]]]:
    """The kept texts in groups of about group_bytes: (index, bytes, starts). A long text comes in several pieces, each
    with what its last n-grams need of the next, so every n-gram of a text is there once however it is cut."""
    group, size, over = [], 0, max(ORDERS) - 1
    for i in keep:
        blob = folded(texts[i])
        for start in range(0, len(blob), group_bytes):
            piece = blob[start : start + group_bytes + over]
            group.append((i, piece, min(group_bytes, len(blob) - start)))
            size += len(piece)
            if size >= group_bytes:
                yield group
                group, size = [], 0
    if group:
        yield group


@dataclass
class LanguageModel:
    languages: list[str]
    families: list[str]
    pairs: list[tuple[str, str]]
    #: A column for each family (against the rest), then one for each pair of languages of one family.
    weights: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Languages and scores; `und` and 0 for null, for no letter, and where no language was learned."""
        out = [("und", 0.0)] * len(texts)
        some = [i for i, t in enumerate(texts) if t and has_letter(t)] if self.languages else []
        sums, counts = np.zeros((len(texts), len(self.weights))), np.zeros(len(texts))
        for group in segments(texts, some):
            owners = np.array([i for i, _, _ in group])
            for buckets, n in grams([(piece, starts) for _, piece, starts in group]):
                there = n > 0
                starts = (np.cumsum(n) - n)[there]
                np.add.at(counts, owners, n)
                if len(starts):
                    np.add.at(sums, owners[there], np.column_stack([np.add.reduceat(w[buckets], starts) for w in self.weights]))
        for i in some:
            out[i] = self._decide(sums[i] / counts[i] * SCALE)
        return [x[0] for x in out], [x[1] for x in out]

    def _decide(self, margins: np.ndarray) -> tuple[str, float]:
        n = len(self.families)
        soft = np.exp(margins[:n] - margins[:n].max())
        family = self.families[int(np.argmax(margins[:n]))]
        score = float(soft.max() / soft.sum())
        members = [x for x in self.languages if _FAMILY.get(x, x) == family]
        votes = dict.fromkeys(members, 0.0)
        chance = dict.fromkeys(members, 1.0)
        for (a, b), margin in zip(self.pairs, margins[n:], strict=True):
            if a in votes:
                p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
                votes[a] += (margin > 0) + p / 1000
                votes[b] += (margin <= 0) + (1 - p) / 1000
                chance[a], chance[b] = min(chance[a], p), min(chance[b], 1 - p)
        best = max(members, key=lambda x: (votes[x], x))
        return best, min(1.0, max(0.0, score * float(chance[best])))


#: Byte n-grams of a text share a mass of SCALE, so that margins of 1 are within reach.
SCALE = 20.0


def _examples(sample: DataFrame, text_col: str) -> pd.DataFrame:
    """Of each sampled row its n-gram counts, and those of two short windows, so short texts are learned too."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                middle = max(0, len(text) // 2 - WINDOW // 2)
                for piece in dict.fromkeys((text, text[:WINDOW], text[middle : middle + WINDOW])):
                    if has_letter(piece):
                        blob = folded(piece)
                        at, n = np.unique(np.concatenate([b for b, _ in grams([(blob, len(blob))])]), return_counts=True)
                        out.append((lang, at.astype("<i4").tobytes(), n.astype("<i4").tobytes()))
            yield pd.DataFrame(out, columns=["lang", "at", "n"])

    return bounded_batches(sample).select("lang", F.col(text_col).alias("text")).mapInPandas(run, "lang string, at binary, n binary").toPandas()


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> LanguageModel:
    """Fits on rows with lang not null and crc32(doc_id) mod 5 other than 0: at most `sample` of each language, and
    of all languages alike so many that they are SAMPLE_ALL at most (20 of each at least)."""
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = known.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (fold(F.col("doc_id"), 5) != 0))
    if known.isEmpty():
        return LanguageModel([], [], [], np.zeros((0, BUCKETS)))
    sample = min(sample, max(20, SAMPLE_ALL // known.select("lang").distinct().count()))
    chosen = bounded_sample(known.select("doc_id", "lang"), "lang", sample)
    got = _examples(texts_of(chosen, known.select("doc_id", "text")), "text").sort_values(["lang", "at", "n"])
    rows = []
    for at, n in zip(got["at"], got["n"], strict=True):
        counts = np.frombuffer(n, "<i4").astype(float)
        rows.append((np.frombuffer(at, "<i4"), counts / counts.sum() * SCALE))
    labels = got["lang"].to_numpy()
    languages = sorted(set(labels))
    family = np.array([_FAMILY.get(x, x) for x in labels])
    families = sorted(set(family))
    pairs = [(a, b) for a, b in combinations(languages, 2) if _FAMILY.get(a, a) == _FAMILY.get(b, b)]
    weights = [linear_svm(rows, np.where(family == f, 1.0, -1.0), BUCKETS) if len(families) > 1 else np.zeros(BUCKETS) for f in families]
    for a, b in pairs:
        of = [i for i, x in enumerate(labels) if x in (a, b)]
        weights.append(linear_svm([rows[i] for i in of], np.where(labels[of] == a, 1.0, -1.0), BUCKETS))
    return LanguageModel(languages, families, pairs, np.array(weights, np.float32))


def identify_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id, held_out (crc32(doc_id) mod 5 is 0; false for a null id), lang_pred, score, one row per input row.

    `und` with score 0 where text is null or has no letter, or nothing was learned. Other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights for each family and pair

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = held.value.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = bounded_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(fold(docs[id_col], 5) == 0, F.lit(False)).alias("held_out"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
