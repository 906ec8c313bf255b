"""Whitening of vectors: components of the exactly centred rows, and the rows projected on them.

The rows become integers x. Their sums S are exact, and so is n*x - S, from which every centred row is one division
away: no large mean is ever multiplied and taken off again. RowMatrix sums the outer products on the executors; the
matrix of one row and column for each dimension comes to the driver, which solves it and sends the components back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .vectors import common_size, finite, scaled

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Dimensions at most: the covariance of so many is 128 MB in the driver. Vectors of more are refused.
MOST_DIMENSIONS = 4096
#: Components whose share of the largest eigenvalue is less have no spread that doubles could tell from none.
LEAST_SHARE = 1e-11


@dataclass
class Whitening:
    """n rows, their sums, and the components: unit columns of falling eigenvalue, with the trace of the covariance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def integer_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x): rows with a usable vector of the size that most have, entries as longs. Written, so that what is
    fitted and what is projected are the same rows."""
    usable = vectors.select(F.col(id_col), F.col(vector_col).alias("__v")).filter(finite(F.col("__v")))
    return cut(usable.select(id_col, scaled(F.col("__v"), SCALE, SHIFT).alias("x")).filter(F.size("x") == common_size(usable, "__v")), "integer-vectors")


def _gramian(rows: DataFrame, column: Column) -> np.ndarray:
    """Sum of the outer products of an array column, by RowMatrix, in the JVM."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def column_sums(rows: DataFrame, column: str) -> list:
    """Sum of each entry of an array column; one row for each dimension comes to the driver."""
    entries = rows.select(F.posexplode(column).alias("at", "c")).groupBy("at").agg(F.sum("c").alias("s"))
    return [r["s"] for r in entries.orderBy("at").collect()]


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Components of the rows (x array<long>); none for an empty table or where all rows are the same."""
    n = rows.count()
    if n == 0:
        return Whitening(0, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 0.0)
    sums = np.array(column_sums(rows, "x"), np.int64)
    if len(sums) > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {len(sums)} dimensions; at most {MOST_DIMENSIONS} are whitened")
    totals = F.array(*[F.lit(int(s)) for s in sums])
    centred = F.zip_with("x", totals, lambda c, s: (F.lit(n) * c - s) / F.lit(float(n)))
    covariance = _gramian(rows, centred) / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    keep = min(components, int((values > max(LEAST_SHARE * values[0], 0.0)).sum()))
    axes = axes[:, :keep]
    turn = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(keep)])  # either sign is right; the largest entry is positive
    return Whitening(n, sums, axes * turn, values[:keep], float(np.trace(covariance)))


def deviations(centred: np.ndarray) -> list[int | None]:
    """Sum of squares of each row of n*x - S, exact; None beyond a long."""
    most = int(np.abs(centred).max(initial=0))
    if most <= isqrt((2**63 - 1) // max(1, centred.shape[1])):
        return (centred * centred).sum(axis=1).tolist()
    exact = [sum(c * c for c in row) for row in centred.tolist()]
    return [x if x < 2**63 else None for x in exact]


def whiten(rows: DataFrame, model: Whitening, id_col: str = "vec_id") -> DataFrame:
    """(id, deviation long, whitened array<double>), one row for each of rows (id, x): the centred row projected on
    the components, over the root of their eigenvalues."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted = held.value
        onto = fitted.components / np.sqrt(fitted.eigenvalues)
        for batch in batches:
            if len(batch):
                centred = fitted.n * np.stack(batch["x"].to_list()).astype(np.int64) - fitted.sums
                yield pd.DataFrame({id_col: batch[id_col], "deviation": pd.array(deviations(centred), "Int64"), "whitened": list(centred / fitted.n @ onto)})

    return rows.select(id_col, "x").mapInPandas(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame) -> float:
    """Largest absolute entry of the covariance of whitened rows, centred once more, minus the identity."""
    n = whitened.count()
    means = F.array(*[F.lit(float(s) / n) for s in column_sums(whitened, "whitened")])
    covariance = _gramian(whitened, F.zip_with("whitened", means, lambda c, m: c - m)) / n
    return float(np.abs(covariance - np.eye(len(covariance))).max())


def whitened_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Returns id, component (from 1), n, deviation, whitened, explained, identity_error, one row for each usable row
    and component.

    Rows with a null vector, an empty one or one that holds a null or non-finite entry are dropped, and so are those
    of another size than most have. Ids may be null or repeat: every row is projected for itself. Fewer components
    than asked for are returned where the rows spread in fewer dimensions (see LEAST_SHARE), so none for one row, for
    equal rows and for an empty table. deviation is null where it is beyond a long; entries for which n*x is beyond a
    long end the query by Spark's overflow error. Other columns are not read.
    """
    rows = integer_rows(vectors, id_col, vector_col)
    model = fit(rows, components)
    done = cut(whiten(rows, model, id_col), "whitened")
    error = identity_error(done) if len(model.eigenvalues) else 0.0
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues]).cast("array<double>")
    each = done.select(id_col, "deviation", F.posexplode("whitened").alias("__at", "whitened"))
    return each.select(id_col, (F.col("__at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("__at")).alias("explained"), F.lit(error).alias("identity_error"))
