"""Exact dedup by deterministic block naming, in DataFrame operations only.

The normalised text is cut into blocks of a fixed number of characters. Distinct blocks are sorted and get
integer names; then the names of neighbours are paired, the distinct pairs are sorted and get integer names,
and so on until one name is left of each document. Two documents with the same number of blocks and the same
last name have the same text: a name stands for one content, as blocks are told apart by content, not by key.

Blocks are sorted by a 64-bit key of theirs, then by content, pairs by a key of theirs, then by both names. A
name is the leading bits of the key and the rank among what shares those bits, so names follow the order and
hang on nothing but the contents: not on partitions, files or retries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, cut

BLOCK_CHARS = 512
#: Leading bits of a key that are part of the name; ranks are counted within them, so each range is a task's work.
RANGE_BITS = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def block_array(norm: Column, block_chars: int) -> Column:
    return F.when(norm == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(norm, F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0)))


def _numbered(distinct: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """Adds `name`: the range of the key and the rank in it by key and `order`."""
    held = distinct.withColumn("__key", key).withColumn("__range", F.shiftrightunsigned("__key", 64 - RANGE_BITS))
    rank = F.row_number().over(Window.partitionBy("__range").orderBy("__key", *order)).cast("long")
    return held.withColumn("name", F.shiftleft("__range", 63 - RANGE_BITS) + rank).drop("__key", "__range")


def _block_names(blocks: DataFrame) -> DataFrame:
    """(rid, n_blocks, pos, name) from blocks (rid, n_blocks, pos, key, block). Only keys that stand for more
    than one content are joined by content; of all others one row for each key is left once it is known to."""
    per_key = blocks.groupBy("key", "block").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.count(F.lit(1)).alias("contents"))
    keys = cut(per_key, "block-keys")
    clashing = keys.filter("contents > 1").select("key")
    single = keys.filter("contents = 1").select("key", F.lit(None).cast("string").alias("block"))
    if clashing.isEmpty():
        names = _numbered(single, F.col("key"), [])
        return blocks.select("rid", "n_blocks", "pos", "key").join(names.select("key", "name"), "key").drop("key")
    several = blocks.join(clashing, "key", "left_semi").groupBy("key", "block").agg(F.count(F.lit(1)).alias("n")).drop("n")
    names = cut(_numbered(single.unionByName(several), F.col("key"), ["block"]), "block-names")
    plain = blocks.select("rid", "n_blocks", "pos", "key").join(names.filter("block is null").select("key", "name"), "key").drop("key")
    by_content = blocks.join(names.filter("block is not null"), ["key", "block"]).select("rid", "n_blocks", "pos", "name")
    return plain.unionByName(by_content)


def _paired(level: DataFrame) -> DataFrame:
    """The next level: names of pairs of neighbours; a last one alone is paired with -1, which is no name."""
    side = lambda parity: F.max(F.when(F.col("pos") % 2 == parity, F.col("name")))
    pairs = level.groupBy("rid", "n_blocks", F.expr("pos div 2").alias("pos")).agg(side(0).alias("a"), F.coalesce(side(1), F.lit(-1)).alias("b"))
    distinct = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).drop("n")
    return pairs.join(_numbered(distinct, F.xxhash64("a", "b"), ["a", "b"]), ["a", "b"]).select("rid", "n_blocks", "pos", "name")


def name_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, key: Callable[[Column], Column] | None = None) -> DataFrame:
    """Returns (rid, doc_id, text_sha256, n_blocks, name), one row per input row; equal (n_blocks, name) is equal text."""
    key = key or (lambda block: F.xxhash64(block))
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    shape = cut(base.select("rid", "doc_id", F.sha2("norm", 256).alias("text_sha256"), block_array(F.col("norm"), block_chars).alias("blocks")), "blocks")
    whole = shape.select("rid", "doc_id", "text_sha256", F.size("blocks").alias("n_blocks"))
    blocks = shape.select("rid", F.size("blocks").alias("n_blocks"), F.posexplode("blocks").alias("pos", "block")).withColumn("key", key(F.col("block")))
    level = cut(_block_names(blocks), "level-0")
    widest = whole.agg(F.max("n_blocks")).first()[0] or 1
    done, width = level.filter("n_blocks = 1"), 1
    while width < widest:
        # Documents of at most `width` blocks have one name by now.
        level = cut(_paired(level.filter(f"n_blocks > {width}")), "level")
        done = done.unionByName(level.filter(f"n_blocks <= {2 * width}"))
        width *= 2
    return whole.join(done.select("rid", "name"), "rid")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, key: Callable[[Column], Column] | None = None) -> DataFrame:
    """Returns doc_id, keep_id, group_size, kept, text_sha256: one row per input row.

    - Null text counts as empty; empty texts are equal to each other, a text of white space alone is one space.
    - Of equal texts the smallest doc_id stays; a null doc_id comes last. Rows that repeat a doc_id are rows
      of their own, and one of equal rows stays.
    - An empty table gives an empty result. Other columns are not read, so their names never clash.
    """
    named = cut(name_documents(docs, id_col, text_col, block_chars, key), "identities")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("rid")))
    group = named.groupBy("n_blocks", "name").agg(least.alias("first"), F.count(F.lit(1)).alias("group_size"))
    group = cut(group.select("n_blocks", "name", F.col("first.id").alias("keep_id"), F.col("first.rid").alias("keep_rid"), "group_size"), "groups")
    out = named.join(group, ["n_blocks", "name"])
    return out.select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256")
