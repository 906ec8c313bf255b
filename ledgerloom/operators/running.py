"""Running sums, least values and spaced rows over long histories without one task per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import fresh_path, staged


def running_sums(rows: DataFrame, keys: list[str], chunk: Column, order: list[str], amounts: dict[str, Column]) -> DataFrame:
    """Adds for each name the sum of its amount up to and with this row, within keys, by (chunk, order).

    `chunk` is a coarser form of the leading order column (a day of a timestamp): the window of a task holds one
    key and chunk, and what came before comes from one row per key and chunk. So a key of very many rows is
    spread over as many tasks as it has chunks.
    """
    held = rows.withColumn("__chunk", chunk).withColumns({f"__a_{n}": c for n, c in amounts.items()})
    inside = Window.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = held.groupBy(*keys, "__chunk").agg(*[F.sum(f"__a_{n}").alias(f"__s_{n}") for n in amounts])
    offsets = sums.select(*keys, "__chunk", *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in amounts])
    inner = held.withColumns({f"__i_{n}": F.sum(f"__a_{n}").over(inside) for n in amounts})
    joined = inner.join(offsets, [*keys, "__chunk"])
    return joined.withColumns({n: F.col(f"__i_{n}") + F.col(f"__o_{n}") for n in amounts}).select(*rows.columns, *amounts)


def running_least(rows: DataFrame, keys: list[str], chunk: Column, order: list[str], amounts: dict[str, Column]) -> DataFrame:
    """Adds for each name the least of its amount up to and with this row, as running_sums adds sums."""
    held = rows.withColumn("__chunk", chunk).withColumns({f"__a_{n}": c for n, c in amounts.items()})
    inside = Window.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    least = held.groupBy(*keys, "__chunk").agg(*[F.min(f"__a_{n}").alias(f"__m_{n}") for n in amounts])
    offsets = least.select(*keys, "__chunk", *[F.min(f"__m_{n}").over(before).alias(f"__o_{n}") for n in amounts])
    inner = held.withColumns({f"__i_{n}": F.min(f"__a_{n}").over(inside) for n in amounts})
    joined = inner.join(offsets, [*keys, "__chunk"])
    return joined.withColumns({n: F.least(f"__i_{n}", f"__o_{n}") for n in amounts}).select(*rows.columns, *amounts)


def latest_before(rows: DataFrame, facts: DataFrame, keys: list[str], at: str, fact_at: str, tie: list[str], chunk: str = "DAY") -> DataFrame:
    """rows with `fact`: of the facts of its keys that are not later than it the last, by (fact_at, tie), as a struct of
    all their other columns; null if there is none. Rows without a time have none.

    Within a key and chunk of time (a unit of date_trunc) it is a window; what comes before a chunk is one row for each
    key and chunk. So a key of very many rows and facts is spread over as many tasks as it has chunks.
    """
    others = [c for c in facts.columns if c not in keys]
    told = facts.filter(F.col(fact_at).isNotNull()).select(*keys, F.col(fact_at).alias("__at"), F.struct(*others).alias("fact"), F.struct(F.col(fact_at), *tie).alias("__order"))
    told = told.withColumn("__chunk", F.date_trunc(chunk, "__at"))
    asked = rows.select(*keys, F.struct(*rows.columns).alias("__row"), F.col(at).alias("__at")).withColumn("__chunk", F.date_trunc(chunk, "__at"))
    both = told.withColumn("__row", F.lit(None).cast(asked.schema["__row"].dataType)).withColumn("__kind", F.lit(0)).unionByName(asked.withColumns({"fact": F.lit(None).cast(told.schema["fact"].dataType), "__order": F.lit(None).cast(told.schema["__order"].dataType), "__kind": F.lit(1)}))
    inside = Window.partitionBy(*keys, "__chunk").orderBy("__at", "__kind", "__order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("__near", F.last("fact", ignorenulls=True).over(inside)).filter("__kind = 1")
    ends = both.groupBy(*keys, "__chunk").agg(F.max_by("fact", "__order").alias("__end"))
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    earlier = ends.select(*keys, "__chunk", F.last("__end", ignorenulls=True).over(before).alias("__earlier"))
    same = [found[k].eqNullSafe(earlier[k]) for k in [*keys, "__chunk"]]
    fact = F.when(F.col("__at").isNotNull(), F.coalesce("__near", "__earlier"))
    return found.join(earlier, same, "left").select("__row.*", fact.alias("fact"))


def following(moments: DataFrame, keys: list[str], at: str, micros: int, span: int) -> DataFrame:
    """moments (keys, at in microseconds, distinct) with `to`: the first moment of the key more than so many
    microseconds later, null if there is none.

    Each moment asks at its time plus `micros`. Questions and moments meet in spans of time: within a span the least
    moment after a question is a window of one key and span, and beyond it the first moment of the next span with any.
    """
    asked = F.col(at) + micros
    held = moments.select(*keys, F.col(at).alias("__t"), F.lit(1).alias("__kind"), F.col(at).alias("__own"))
    questions = moments.select(*keys, asked.alias("__t"), F.lit(0).alias("__kind"), F.col(at).alias("__own"))
    both = held.unionByName(questions).withColumn("__span", F.floor(F.col("__t") / span))
    later = Window.partitionBy(*keys, "__span").orderBy(F.desc("__t"), "__kind").rowsBetween(Window.unboundedPreceding, -1)
    # Backwards in time, a question stands before a moment of its own time: strictly more is asked for.
    near = both.withColumn("__to", F.min(F.when(F.col("__kind") == 1, F.col("__own"))).over(later))
    near = near.filter("__kind = 0")
    spans = held.groupBy(*keys, F.floor(F.col("__t") / span).alias("__span")).agg(F.min("__t").alias("__first"))
    # Spans with questions only take their answer from the next one with moments.
    marks = spans.unionByName(near.filter("__to is null").select(*keys, "__span", F.lit(None).cast("long").alias("__first")).distinct())
    by_span = marks.groupBy(*keys, "__span").agg(F.min("__first").alias("__first"))
    onward = Window.partitionBy(*keys).orderBy(F.desc("__span")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = by_span.select(*keys, "__span", F.min("__first").over(onward).alias("__beyond"))
    found = near.join(beyond, [*keys, "__span"], "left")
    return found.select(*keys, F.col("__own").alias(at), F.coalesce("__to", "__beyond").alias("to"))


def spaced(rows: DataFrame, keys: list[str], at: str, tie: list[str], micros: int) -> DataFrame:
    """The rows of each key that are kept when, in the order of `at` (a timestamp) and `tie`, a row is passed over
    that comes within so many microseconds, bounds included, of the last one kept. Rows without a time are left out.

    What is kept hangs on all before it, yet no task holds a whole key, nor the moments of one in an array: each
    moment points to the first that may follow it, pointers are doubled until none leads on, and from the first
    moment of each key the longest pointers are followed first, then those of half the length, and so on. So the
    number of joins grows with the logarithm of how many a key keeps. Each doubling is written.
    """
    named, spark = [f"__k{i}" for i in range(len(keys))], rows.sparkSession
    # Null keys are keys of their own.
    held = rows.withColumns({n: F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for n, k in zip(named, keys, strict=True)})
    held = held.withColumn("__at", F.unix_micros(F.col(at).cast("timestamp"))).filter("__at is not null")
    # Copies of a moment go before the shuffle.
    moments = staged(held.select(*named, "__at").distinct(), fresh_path(spark, "moments"))
    span = max(86_400_000_000, micros + 1)
    jumps = [staged(following(moments, named, "__at", micros, span).filter("to is not null"), fresh_path(spark, "jumps"))]
    while not jumps[-1].isEmpty():
        onward = jumps[-1].select(*named, F.col("__at").alias("to"), F.col("to").alias("__then"))
        jumps.append(staged(jumps[-1].join(onward, [*named, "to"]).select(*named, "__at", F.col("__then").alias("to")), fresh_path(spark, "jumps")))
    kept = moments.groupBy(*named).agg(F.min("__at").alias("__at"))
    for jump in reversed(jumps[:-1]):
        kept = staged(kept.unionByName(kept.join(jump, [*named, "__at"]).select(*named, F.col("to").alias("__at"))), fresh_path(spark, "kept"))
    # Of rows of one moment the first by `tie`.
    place = [F.struct(F.col(c).isNull(), F.col(c)) for c in tie]
    first = held.groupBy(*named, "__at").agg(F.min(F.struct(*place, F.struct(*[F.col(c) for c in rows.columns]).alias("row"))).alias("x"))
    return kept.join(first, [*named, "__at"]).select("x.row.*")
