"""What the operators on vectors share: usable rows, their size, and integer entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector holds entries, none of them null, NaN or infinite; false for null."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))


def common_size(vectors: DataFrame, column: str) -> int:
    """The number of entries that most vectors have, the larger of two that are as common; 0 without rows."""
    counts = vectors.groupBy(F.size(column).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = counts.agg(F.max(F.struct("n", "d"))["d"].alias("d")).first()
    return most["d"] or 0


def scaled(vector: Column, by: int, plus: int = 0) -> Column:
    """Each entry c as the long floor(by * c) + plus, c taken as double."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(by)) * c.cast("double")) + F.lit(plus).cast("long"))
