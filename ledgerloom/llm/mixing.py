"""Mixing sources to target weights.

Each source's words, laid end to end, are cut into blocks of BLOCK words. Output shards of a fixed number of
slots draw how many slots each source gets, multinomially, given what each source gets in a bundle of shards; a
source's slots, numbered over all shards, are mapped through a pseudorandom permutation of its block numbers,
one pass after the other, and joined with the blocks by number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, chunk_count, cut, running_start

WEIGHTS = (5.0, 2.0, 1.0)
#: No document is taken more often than this, so no source's target exceeds this many times its size.
PASSES = 3
BLOCK, SLOTS, SEED = 32, 1024, 20
#: Shards that are drawn together, and tasks at most.
BUNDLE, MOST_TASKS = 128, 50_000
#: Sources are a dimension: one row of each is held by the driver and in every task, and more are refused.
MOST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in text; 0 for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, WHITE))).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """Adds rank, source_size and target to one row per source: (source, source_size).

    Sources by code point, null last, weigh `weights` in turn and share the total; what exceeds passes x size is
    shared again by weight among the others. Sources fill up in the order of size / weight, so how many do
    follows from running sums, without rounds.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.col("rank") % len(weights)))
    tight = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    so_far, everything = tight.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    w = (
        ranked.withColumn("full_before", F.coalesce(F.sum(passes * F.col("source_size")).over(so_far), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(so_far), F.lit(0.0)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("rate", (F.col("total") - F.col("full_before")) / F.col("weight_left"))
        .withColumn("fills", F.col("rate") * F.col("weight") > passes * F.col("source_size"))
        # Sources fill as a prefix of this order; the first that does not fill sets the rate of all after it.
        .withColumn("settled", F.min(F.when(~F.col("fills"), F.struct(F.col("source_size") / F.col("weight"), "rank", "rate"))).over(everything))
    )
    after = F.struct(F.col("source_size") / F.col("weight"), F.col("rank")) >= F.struct(F.col("settled.col1"), F.col("settled.rank"))
    target = F.when(F.col("settled").isNull() | ~after, F.lit(1.0) * passes * F.col("source_size")).otherwise(F.col("settled.rate") * F.col("weight"))
    return w.select("source", "rank", "source_size", target.cast("double").alias("target"))


def _permuted(k: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A permutation of 0..n-1 for each key, at k: four Feistel rounds over the next power of four, walked until inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2)
    mask = (np.int64(1) << half) - 1
    out, todo = k.astype(np.int64).copy(), np.arange(len(k))
    while len(todo):
        left, right = out[todo] >> half[todo], out[todo] & mask[todo]
        for turn in range(1, 5):
            mixed = (right.astype(np.uint64) + np.uint64(turn * 0x9E3779B97F4A7C15 % 2**64) + key[todo].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed >> np.uint64(33)).astype(np.int64) & mask[todo])
        out[todo] = (left << half[todo]) | right
        todo = todo[out[todo] >= n[todo]]
    return out


def shard_counts(slots: np.ndarray, shards: int, seed: tuple[int, ...]) -> np.ndarray:
    """How many slots each source gets in each of `shards` shards of like size: (shards, sources).

    The shards' counts are multinomial draws by the sources' shares, given that they add up to `slots`: what is
    left of each source is drawn from without replacement, shard by shard.
    """
    rng, left, out = np.random.default_rng(seed), slots.copy(), []
    total = int(slots.sum())
    for shard in range(shards):
        m = total // shards + (shard < total % shards)
        drawn = rng.multivariate_hypergeometric(left, m, method="marginals")
        left = left - drawn
        out.append(drawn)
    return np.array(out)


def block_draws(plan: DataFrame, block: int = BLOCK, slots: int = SLOTS, seed: int = SEED, passes: int = PASSES) -> DataFrame:
    """(rank, block, times): how often each block is taken, from plan (rank, source_size, target).

    A task has bundles of shards, each of which knows by itself which of every source's slots are its own.
    """
    spark = plan.sparkSession
    # One row per source; the shards' draws need every source's share.
    own = plan.filter("source_size > 0 and target > 0").select("rank", "source_size", "target").toPandas().sort_values("rank")
    if own.empty:
        return spark.createDataFrame([], "rank int, block long, times long")
    ranks, sizes = own["rank"].to_numpy(np.int64), own["source_size"].to_numpy(np.int64)
    blocks = -(-sizes // block)
    wanted = np.minimum(np.rint(own["target"].to_numpy() * blocks / sizes), passes * blocks).astype(np.int64)
    total = int(wanted.sum())
    bundles = max(1, -(-total // (slots * BUNDLE)))

    def first_of(bundle: int) -> np.ndarray:
        """Of each source the slots before this bundle's, without numbers over 64 bits."""
        return wanted // bundles * bundle + wanted % bundles * bundle // bundles

    def slots_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for bundle in batch["id"].tolist():
                first = first_of(bundle)
                count = first_of(bundle + 1) - first
                shards = max(1, -(-int(count.sum()) // slots))
                drawn = shard_counts(count, shards, (seed, bundle))
                at = first + np.cumsum(drawn, axis=0) - drawn
                shard, source = np.nonzero(drawn)
                n = drawn[shard, source]
                row = np.repeat(np.arange(len(n)), n)
                k = at[shard, source][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                of, size = source[row], blocks[source[row]]
                key = (k // size + 1) * 1_000_003 + ranks[of] * 7_919 + seed
                yield pd.DataFrame({"rank": ranks[of].astype(np.int32), "block": _permuted(k % size, size, key)})

    dealt = spark.range(0, bundles, 1, min(bundles, MOST_TASKS))
    return dealt.mapInPandas(slots_of, "rank int, block long").groupBy("rank", "block").agg(F.count(F.lit(1)).alias("times"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, slots: int = SLOTS, seed: int = SEED, weights: tuple[float, ...] = WEIGHTS, key: Column | None = None) -> DataFrame:
    """Returns rid, key, doc_id, size, source_size, target, taken, spans (array of start, end, times: words taken).

    One row per input row, rid numbering them; key is whatever the caller wants to know rows by. Null text has
    no words. Documents of no words take nothing; a null source is a source of its own. Rows that repeat a doc_id
    are documents of their own. An empty table gives an empty result. Other columns are not read.

    Documents lie in their source in the order of a hash of doc_id and text, so what is taken hangs on the rows
    alone, not on files or partitions; of rows equal in both, which are alike in all that is returned, any is first.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    place = [F.xxhash64(F.col(id_col).cast("long"), text).alias("place"), F.xxhash64(text, F.col(id_col).cast("long"), F.lit(1)).alias("place2")]
    named = F.lit(None).cast("string") if key is None else key
    sized = docs.select(F.monotonically_increasing_id().alias("rid"), named.alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *place)
    sized = cut(sized, "sizes")
    plan = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    if plan.count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    rows = sized.join(F.broadcast(plan.withColumnRenamed("source", "__source")), F.col("source").eqNullSafe(F.col("__source"))).drop("__source", "source")
    placed = running_start(rows, ["rank"], ["place", "place2"], F.col("size"), "first", "place", chunk_count(sized.count()))
    placed = cut(placed.drop("place", "place2"), "places")
    pieces = placed.filter("size > 0").select("rid", "rank", "first", "size", F.explode(F.expr(f"sequence(first div {block}, (first + size - 1) div {block})")).alias("block"))
    drawn = cut(block_draws(plan, block, slots, seed), "draws")
    start, end = F.greatest(F.col("block") * block - F.col("first"), F.lit(0)), F.least((F.col("block") + 1) * block - F.col("first"), F.col("size"))
    got = pieces.join(drawn, ["rank", "block"]).select("rid", F.struct(start.alias("start"), end.alias("end"), "times").alias("span"))
    # A document's own blocks: as many as its length gives, pre-summed in each task.
    taken = got.groupBy("rid").agg(F.sum((F.col("span.end") - F.col("span.start")) * F.col("span.times")).alias("taken"), F.sort_array(F.collect_list("span")).alias("spans"))
    out = placed.join(taken, "rid", "left")
    return out.select("rid", "key", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "spans")
