"""The operators' decisions applied to document tables: rows dropped, kept or rewritten, columns as they were.

An operator reports rows by doc_id and a digest, so rows that repeat a doc_id are still told apart; of rows
that agree in both, one stays. Null and empty texts are ordinary rows; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches
from .exact_dedup import exact_dedup, normalised
from .mixing import mix
from .near_dup import near_duplicates
from .toxicity import THRESHOLD, ToxicityModel


def row_key(doc_id: Column, digest: Column) -> Column:
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), digest)


def text_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def unused(name: str, columns: list[str]) -> str:
    """name, with as many underscores before it as keep it apart from the columns of a caller's table."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def _one_of_each(docs: DataFrame, key: Column, name: str) -> DataFrame:
    """docs with the column `name` = key and one row of each key; copies of a row go before the shuffle, so none is hot."""
    turn = unused("turn", [*docs.columns, name])
    numbered = F.row_number().over(Window.partitionBy(name).orderBy(name))
    return docs.withColumn(name, key).withColumn(turn, numbered).filter(F.col(turn) == 1).drop(turn)


def keep_rows(docs: DataFrame, digest: Column, kept: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row of docs for each key in kept (column key)."""
    name = unused("key", docs.columns)
    one = _one_of_each(docs, row_key(F.col(id_col), digest), name)
    return one.join(kept.select(F.col("key").alias(name)), name, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows that the grammar scores below the threshold; null text stays, repeated rows stay or go together."""
    terms, calibration, at = model.terms, model.calibration, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ToxicityModel(terms, calibration)
        for batch in batches:
            yield batch.filter(pa.array([own.score(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return bounded_batches(docs).mapInArrow(run, docs.schema)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row that stays of each group of equal texts: of the least doc_id, of rows alike in that too any one."""
    kept = exact_dedup(docs, id_col, text_col).filter("kept").select(row_key(F.col("doc_id"), F.col("text_sha256")).alias("key"))
    return keep_rows(docs, F.sha2(normalised(F.col(text_col)), 256), kept, id_col)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document of the smallest doc_id of each class of similar ones, of rows that repeat it any one, and all that
    link with nothing, of which rows alike in doc_id and text count once."""
    kept = near_duplicates(docs, id_col, text_col).filter("kept").select(row_key(F.col("doc_id"), F.col("text_sha256")).alias("key"))
    return keep_rows(docs, text_digest(F.col(text_col)), kept, id_col)


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str = "n_chars") -> DataFrame:
    """The documents as the mix takes them: one row for each pass in which any word of a document is taken.

    A row's text is that of the document if the pass takes all its words, else the words taken, in order. The
    words of all rows are those that mix() counts as taken. length_col, if there, is set to the new length.
    """
    # Rows that agree in doc_id, source and text have one text to give; their shares meet under one key.
    digest = F.sha2(F.concat_ws("\n", F.coalesce(F.col(source_col), F.lit("")), F.col(source_col).isNull().cast("string"), F.coalesce(F.col(text_col), F.lit(""))), 256)
    mixed = mix(docs, id_col, text_col, source_col, key=row_key(F.col(id_col), digest)).filter("taken > 0")
    name, held = unused("key", docs.columns), unused("spans", docs.columns)
    spans = mixed.groupBy(F.col("key").alias(name)).agg(F.collect_list("spans").alias(held))
    joined = _one_of_each(docs, row_key(F.col(id_col), digest), name).join(spans, name).select(*[F.col(f"`{c}`") for c in docs.columns], held)
    names, at = docs.columns, docs.columns.index(text_col)
    length = names.index(length_col) if length_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            took, texts = [], []
            for i, (text, copies) in enumerate(zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True)):
                words = None
                for spans in copies:
                    for turn in range(1, max(s["times"] for s in spans) + 1):
                        parts = [(s["start"], s["end"]) for s in spans if s["times"] >= turn]
                        words = text.encode("utf-8").split() if words is None else words
                        whole = sum(b - a for a, b in parts) == len(words)
                        texts.append(text if whole else b" ".join(w for a, b in parts for w in words[a:b]).decode("utf-8"))
                        took.append(i)
            out = batch.select(range(len(names))).take(pa.array(took, pa.int64()))
            columns = list(out.columns)
            columns[at] = pa.array(texts, columns[at].type)
            if length is not None:
                columns[length] = pa.array(map(len, texts), columns[length].type)
            yield pa.RecordBatch.from_arrays(columns, schema=out.schema)

    return bounded_batches(joined).mapInArrow(run, docs.schema)
