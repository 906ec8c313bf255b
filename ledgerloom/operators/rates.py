"""Amounts in another currency, by the rate that was quoted when they were taken."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import latest_before

#: Where a rate comes from, the best first.
QUOTE, STALE, DEFAULT = "QUOTE", "STALE", "DEFAULT"


def converted(amounts: DataFrame, quotes: DataFrame, amount: str, at: str, max_age_seconds: int, default: dict[str, float]) -> DataFrame:
    """amounts (pair, ...) with rate, rate_source, rate_at and converted.

    Of quotes (pair, rate, quoted_at) the last one not later than the amount counts: as QUOTE if it is no older than
    max_age_seconds, else as STALE. Without any, the pair's default is taken as DEFAULT, and a pair without one
    stays unconverted. Quotes that are null or not above 0 are passed over; of quotes of one moment the highest
    counts. Nothing stored is changed: the result is for display.
    """
    told = quotes.filter("rate > 0").select("pair", F.col("rate").cast("double").alias("rate"), "quoted_at")
    found = latest_before(amounts, told, ["pair"], at, "quoted_at", ["rate"])
    age = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col("fact.quoted_at").cast("timestamp"))
    fallback = F.lit(None).cast("double")
    for pair, rate in default.items():
        fallback = F.when(F.col("pair") == pair, rate).otherwise(fallback)
    source = F.when(F.col("fact").isNull(), F.when(fallback.isNotNull(), DEFAULT)).when(age <= max_age_seconds * 1_000_000, QUOTE).otherwise(STALE)
    rate = F.coalesce("fact.rate", fallback)
    return found.select(*amounts.columns, rate.alias("rate"), source.alias("rate_source"), F.col("fact.quoted_at").alias("rate_at"), (F.col(amount).cast("double") * rate).alias("converted"))
