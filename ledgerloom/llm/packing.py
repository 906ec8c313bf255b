"""Harmonic packing of token sequences into windows of a fixed capacity C.

A piece of length n belongs to class k when C/(k+1) < n <= C/k, and a window of class k takes exactly k
pieces, so workers fill windows without seeing each other's. Documents may be cut, which makes the waste small:
whole windows first; what is left stays whole where k of its like leave at most LOOSE of a window, else a piece of
length C/(k+1), the largest of a class that wastes nothing, is cut off it, and so on. What is shorter than SMALLEST
goes to its own class. The fewer than k pieces that remain of each class, a bounded number, are laid end to end,
longest first, into the last windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, chunk_count, cut, running_start
from .tokens import byte_encoder

CAPACITY = 2048
SMALLEST, LOOSE = 64, 1 / 64
END_ID = 1


def cuts(n: int, capacity: int = CAPACITY, smallest: int = SMALLEST, loose: float = LOOSE) -> list[int]:
    """Lengths of the pieces of a document of n tokens: whole windows, lengths that fill a window, and a rest."""
    whole, rest = divmod(n, capacity)
    pieces = [capacity] * whole
    while rest:
        k = capacity // rest
        part = rest if rest < smallest or capacity - k * rest <= loose * capacity else capacity // (k + 1)
        pieces.append(part)
        rest -= part
    return pieces


def _pieces(docs: DataFrame, vocabulary: str, capacity: int, smallest: int, id_col: str, text_col: str) -> DataFrame:
    """One row per piece, in document order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoder(vocabulary)
        names = ["rid", "doc_id", "doc_tokens", "start", "length", "ids_crc32"]
        for batch in batches:
            rows = []
            for rid, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4")
                start = 0
                for n in cuts(len(ids), capacity, smallest):
                    rows.append((rid, doc, len(ids), start, n, zlib.crc32(ids[start : start + n].tobytes())))
                    start += n
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    rows = bounded_batches(docs).select(F.monotonically_increasing_id().alias("rid"), docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "rid long, doc_id long, doc_tokens long, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k", capacity: int = CAPACITY, smallest: int = SMALLEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document ends with id 1, so a null or empty text is one piece of one id. Each id is in one piece;
    offsets of a sequence run from 0 without gaps. Rows that repeat a doc_id are documents of their own.
    An empty table gives an empty result. Other columns are not read.
    """
    pieces = cut(_pieces(docs, vocabulary, capacity, smallest, id_col, text_col).withColumn("k", F.lit(capacity).cast("long") / F.col("length")).withColumn("k", F.floor("k")), "pieces")
    ranked = running_start(pieces, ["k"], ["rid", "start"], F.lit(1), "rank", "rid", chunk_count(pieces.count()))
    # One row for each class: at most `capacity` rows.
    classes = pieces.groupBy("k").agg(F.count(F.lit(1)).alias("n")).select("k", F.expr("n div k").alias("windows"))
    classes = classes.withColumn("base", F.coalesce(F.sum("windows").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("first_free", F.sum("windows").over(Window.partitionBy()))
    ranked = ranked.join(F.broadcast(classes), "k").withColumn("window", F.expr("rank div k"))
    inside = Window.partitionBy("k", "window").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    full = ranked.filter("window < windows").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("window")).alias("sequence_id"), F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"))

    def last_windows(rest: pd.DataFrame) -> pd.DataFrame:
        """Longest first, end to end; a piece that does not fit opens the next window."""
        rest = rest.sort_values(["length", "doc_id", "start"], ascending=[False, True, True])
        sequence, offset, at, used = [], [], int(rest["first_free"].iloc[0]), 0
        for n in rest["length"]:
            if used + n > capacity:
                at, used = at + 1, 0
            sequence.append(at)
            offset.append(used)
            used += n
        return rest.assign(sequence_id=sequence, offset=offset)[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    # Fewer than k pieces of each class remain: under capacity * (1 + ln capacity) rows, whatever the input.
    rest = ranked.filter("window >= windows").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "first_free")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return full.unionByName(rest.groupBy("first_free").applyInPandas(last_windows, schema))
