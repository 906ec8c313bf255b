"""What the trained operators share: held-out rows and bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(doc_id.cast("string")) % n


def bounded_sample(labelled: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, label) of at most `most` rows of each label: those with the least hash of doc_id, the same on every
    run. A doc_id that several rows have is passed over, so that a sample of ids bounds the rows they stand for.

    Only ids are sorted, and of each label a few times `most` of them: those whose hash is low enough for that many
    by the label's count. Texts are joined to the sample afterwards (see texts_of).
    """
    single = labelled.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.first(label).alias(label)).filter("n = 1").drop("n")
    placed = cut(single.withColumn("__at", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(11)), 1)), "labelled-ids")
    counts = placed.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    low = placed.join(counts, label).filter(F.col("__at") / F.lit(2.0**63) <= F.lit(3.0 * most + 100) / F.col("__n"))
    turn = Window.partitionBy(label).orderBy("__at", "doc_id")
    return cut(low.withColumn("__turn", F.row_number().over(turn)).filter(F.col("__turn") <= most).select("doc_id", label), "sample")


def texts_of(sample: DataFrame, docs: DataFrame) -> DataFrame:
    """The sample (doc_id, label) with the text of its documents (doc_id, text), without ids that several of them have."""
    found = docs.select("doc_id").join(F.broadcast(sample), "doc_id")  # bounded by the sample's size
    single = cut(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("doc_id"), "sample-ids")
    return docs.join(F.broadcast(sample.join(single, "doc_id")), "doc_id")


def linear_svm(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, size: int, cost: float = 10.0, epochs: int = 12, seed: int = 3) -> np.ndarray:
    """Weights of a linear support vector machine by dual coordinate descent; each row is (indices, values)."""
    weights, alphas, rng = np.zeros(size), np.zeros(len(rows)), np.random.default_rng(seed)
    norms = np.array([max(float(v @ v), 1e-12) for _, v in rows])
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, values = rows[i]
            step = min(max(alphas[i] - (signs[i] * float(weights[at] @ values) - 1) / norms[i], 0.0), cost) - alphas[i]
            if step:
                alphas[i] += step
                weights[at] += step * signs[i] * values
    return weights


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression with an intercept last, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + keep, x.T @ (p - y) / len(x) + keep @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
