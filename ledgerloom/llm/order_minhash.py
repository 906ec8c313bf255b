"""Document fingerprints by order min-hash.

A text's k-mers are numbered by occurrence, so that the second time a k-mer stands in a text it is another element
than the first. Each of SKETCHES permutations picks the TUPLE elements it puts first; they are put back in the order
in which the text has them, and the tuple is hashed to one entry. Two texts agree in an entry if they have the same
least elements in the same order, so moved passages count as changes where sets of k-mers would be the same.

The permutations are h -> h xor r, h being the element's hash and r a number whose leading bits no other permutation
has: the least elements are those nearest to r in one sorted array, so a text is hashed once for all permutations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut

#: Code points of a k-mer (a power of two), elements of a tuple, entries of a fingerprint (a power of two).
KMER, TUPLE, SKETCHES = 8, 2, 64
#: Bits of an element's hash, and of its place; texts of more code points take the slower path.
HASH_BITS, PLACE_BITS = 40, 24
_PLACES = np.uint64((1 << PLACE_BITS) - 1)
_LOW = np.uint64(64 - HASH_BITS)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_STEPS = _mixed(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)
#: Of each permutation; the leading bits of hashes, and the mask of the others.
_NUMBERS = np.arange(SKETCHES, dtype=np.uint64) << np.uint64(HASH_BITS - (SKETCHES - 1).bit_length())
_REST = np.uint64((1 << (HASH_BITS - (SKETCHES - 1).bit_length())) - 1)
#: Elements that are sorted all; of more, about half as many.
SORTED = 2048


def _kmers(text: str) -> np.ndarray:
    """Hash of the k-mer at each code point; those at the end are cut short by it."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    width, at = 1, 0
    while width < KMER:
        nxt = np.zeros_like(codes)
        nxt[:-width] = codes[width:]
        codes = codes * _STEPS[at] + nxt
        width, at = 2 * width, at + 1
    return _mixed(codes) >> _LOW


def _in_order(hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both, by hash and then by place."""
    if not len(places) or places.max() <= _PLACES:
        both = np.sort(hashes << np.uint64(PLACE_BITS) | places)
        return both >> np.uint64(PLACE_BITS), both & _PLACES
    order = np.lexsort((places, hashes))
    return hashes[order], places[order]


def _elements(kmers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the numbered k-mers, their places): equal k-mers are numbered along the text; the first of them
    keeps its hash."""
    hashes, places = _in_order(kmers, np.arange(len(kmers), dtype=np.uint64))
    again = np.flatnonzero(hashes[1:] == hashes[:-1]) + 1
    if len(again):
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        number = again - first[np.searchsorted(first, again, "right") - 1]
        hashes[again] = _mixed(hashes[again] * _STEPS[6] + number.astype(np.uint64)) >> _LOW
    return hashes, places


def _least(hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the elements that each permutation puts first: a row for each, TUPLE of them or all.

    Within the block of hashes that begin as a permutation's number does, xor leaves the order as it is. Of many
    elements only those at the beginning of each block are sorted, unless they turn out to be too few.
    """
    want = min(TUPLE, len(hashes))
    if len(hashes) > SORTED:
        low = (hashes & _REST) <= np.uint64(int(_REST) * SORTED // (2 * len(hashes)))
        few, at = _in_order(hashes[low], places[low])
        starts = np.searchsorted(few, _NUMBERS)
        if np.diff(starts, append=len(few)).min() >= want:
            index = starts[:, None] + np.arange(want)
            return few[index], at[index]
    hashes, places = _in_order(hashes, places)
    starts = np.searchsorted(hashes, _NUMBERS)
    index = np.minimum(starts[:, None] + np.arange(want), len(hashes) - 1)
    for j in np.flatnonzero(np.diff(starts, append=len(hashes)) < want):  # of the blocks beside it, the nearest by xor
        index[j] = np.argsort(hashes ^ _NUMBERS[j], kind="stable")[:want]
    return hashes[index], places[index]


def signature(text: str) -> np.ndarray:
    """SKETCHES entries of 16 bits; none for the empty text."""
    if not text:
        return np.zeros(0, np.uint16)
    hashes, places = _least(*_elements(_kmers(text)))
    tuples = np.take_along_axis(hashes, np.argsort(places, axis=1), axis=1)
    mixed = np.full(SKETCHES, tuples.shape[1], np.uint64)
    for k in range(tuples.shape[1]):
        mixed = _mixed(mixed * _STEPS[7] + tuples[:, k])
    return (mixed >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal entries; 1 for two empty texts, 0 for an empty and another."""
    if len(a) != len(b):
        return 0.0
    return float((a == b).mean()) if len(a) else 1.0


def written(entries: np.ndarray) -> str:
    """Four hexadecimal digits for each entry."""
    return entries.astype(">u2").tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u2").astype(np.uint16)


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the beginning, as long, of the text that follows."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


_DONE = ["edited_sha256", "edited_fingerprint", "near_edited", "near_next"]


def _compared(text: str, own: np.ndarray, following: str, theirs: np.ndarray) -> tuple[str, str, float, float]:
    after = edited(text, following)
    entries = signature(after) if after != text else own
    return hashlib.sha256(after.encode("utf-8", "surrogatepass")).hexdigest(), written(entries), likeness(own, entries), likeness(own, theirs)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint): one row for each document; null counts as the empty text, whose fingerprint is the
    empty string. Equal texts have equal fingerprints. Ids may be null or repeat. Memory is about 60 bytes for each
    code point of the longest text. Other columns are not read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].fillna("")
            yield pd.DataFrame({id_col: batch[id_col], "n_chars": texts.str.len().astype("int64"), "fingerprint": [written(signature(t)) for t in texts]})

    kind = docs.schema[id_col].dataType.simpleString()
    return bounded_batches(docs).select(id_col, F.col(text_col).alias("text")).mapInPandas(run, f"`{id_col}` {kind}, n_chars long, fingerprint string")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, one row per
    document: its fingerprint, that of its edited text (see edited), and how like it is to that and to the
    fingerprint of the next document by ascending id; the first follows the last, so a single document follows itself.

    Null texts are empty. Documents of one id follow each other by the SHA-256 of their texts, those without an id
    stand first, and rows that repeat id and text follow each other. An empty table gives an empty result. Other
    columns are not read.

    The documents are dealt out by ranges of their ids, so that the next one mostly lies in the same task; the first
    and the last text of each range are written beside the rows and compared in a second, small step.
    """
    key = [F.col("doc_id").asc_nulls_first(), F.col("sha"), F.col("turn")]
    rows = bounded_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = rows.withColumn("sha", F.sha2("text", 256)).withColumn("turn", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(*key).sortWithinPartitions(*key).select("doc_id", "text", F.spark_partition_id().alias("part"))
    first = cut(ranged.mapInPandas(_ranges, _RANGES), "fingerprints")
    return first.filter("edge is null").select(*_RESULT).union(_across(first))


_RESULT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_RANGES = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edge string, part int, text string"


def _ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one range in order: all but the last compared with the next, then the first and the last with their texts."""
    before = first = None

    def row(doc: tuple, done: tuple = (None,) * 4, edge: str | None = None, part: int | None = None, text: str | None = None) -> tuple:
        return doc[0], len(doc[1]), done[0], written(doc[2]), *done[1:], edge, part, text

    part = None
    columns = [c.split()[0] for c in _RANGES.split(", ")]
    for batch in batches:
        out = []
        for doc_id, text, part in zip(batch["doc_id"].astype("Int64"), batch["text"], batch["part"], strict=True):
            doc = (doc_id, text, before[2] if before and before[1] == text else signature(text))
            if before:
                out.append(row(before, _compared(before[1], before[2], text, doc[2])))
            before, first = doc, first or doc
        yield _frame(out, columns)
    if before:
        yield _frame([row(first, edge="first", part=part, text=first[1]), row(before, edge="last", part=part, text=before[1])], columns)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    return out.astype({"doc_id": "Int64", "n_chars": "int64", "part": "Int32"} | {c: "float64" for c in columns if c.startswith("near_")})


def _across(ranges: DataFrame) -> DataFrame:
    """The last document of each range compared with the first of the next: one row for each range."""
    edges = ranges.filter("edge is not null")
    # One short row for each range: a few thousands at most.
    order = edges.filter("edge = 'last'").select("part", F.lead("part").over(Window.orderBy("part")).alias("to"), F.min("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("least"))
    to = order.select("part", F.coalesce("to", "least").alias("to"))
    firsts = edges.filter("edge = 'first'").select(F.col("part").alias("to"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    met = edges.filter("edge = 'last'").select("doc_id", "n_chars", "fingerprint", "text", "part").join(to, "part").join(firsts, "to")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [_compared(r.text, read(r.fingerprint), r.next_text, read(r.next_fingerprint)) for r in batch.itertuples()]
            yield batch[["doc_id", "n_chars", "fingerprint"]].assign(doc_id=batch["doc_id"].astype("Int64")).join(pd.DataFrame(done, columns=_DONE, index=batch.index))

    return met.select("doc_id", "n_chars", "fingerprint", "text", "next_text", "next_fingerprint").mapInPandas(run, "doc_id long, n_chars long, fingerprint string, edited_sha256 string, edited_fingerprint string, near_edited double, near_next double").select(*_RESULT)
