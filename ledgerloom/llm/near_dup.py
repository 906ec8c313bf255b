"""N-gram Jaccard join with adaptive multi-match prefixes.

All documents agree on one order of shingles: those no other document has, then the rare, then the frequent
by their document frequency. Two sets of n and m shingles that are similar share enough that the first
n - ceil(t n) + l of one and the first m - ceil(t m) + l of the other have l in common; l is chosen for each
document by estimated cost, so a document of frequent shingles takes a longer prefix and needs more matches.

Only classes of similar documents are asked for, so the pairs of a class are not listed. Within the documents
that share a prefix shingle, all are first compared with one of them, its leader; those found similar are one
class from then on, and only pairs of different classes are left. When leaders close no more shingles, the pairs
left are all compared, but for those that sizes, unshared shingles or parity sketches show to be unlike. Shingles
of many documents are then dealt out in cells of CELL by CELL documents of like size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, few_parts
from .graph import components, onward
from .shingles import shingle_sets

#: Similarity as a ratio: TIMES * intersection >= LEAST * union.
LEAST, TIMES = 80, 100
#: Documents that make a shingle frequent; their number of frequent shingles, and the bits that tell single
#: ones apart, at most, as both go to every task. Beyond, only the frequencies from a higher count on are used.
FREQUENT, MOST_FREQUENT, MOST_BITS = 32, 500_000, 27
#: Counts from which shingles may be left out: FREQUENT, doubled so often.
DOUBLINGS = 40
#: Shingles sorted together in a task.
FLUSH = 1_000_000
LADDER = (1, 2, 4, 8, 16)
#: 64-bit words of a parity sketch: each shingle flips one of its bits.
SKETCH = 16
VERIFY_COST = 20.0
#: Documents of one shingle that are compared with so many others in one task.
CELL = 512
#: Leaders go on while they close a fifth of what is open.
WORTH = 0.8


def _packed(values: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as differences, byte by byte: the high bytes compress to nothing."""
    return np.diff(values, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel(), dtype=np.uint32)


def counted_keys(hashes: np.ndarray, bucket_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading bits of hashes that tell shingles apart (those of the bucket and 32 more), each once and sorted, and
    how often each comes."""
    keys = np.sort(hashes) >> np.uint64(32 - bucket_bits)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(first, append=len(keys))


class Frequencies:
    """Which shingles more than one document has, and how many have the frequent ones."""

    def __init__(self, bucket_bits: int, map_bits: int, bits: np.ndarray, frequent: np.ndarray, df: np.ndarray):
        self.shift = np.uint64(32 - bucket_bits)
        self.map_shift, self.bits = np.uint64(64 - map_bits), bits
        self.frequent, self.df = frequent, df

    def shared(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.map_shift
        return (self.bits[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """Document frequency, or 0 for shingles that are not frequent."""
        if not len(self.frequent):
            return np.zeros(len(hashes), np.int64)
        key = hashes >> self.shift
        at = np.minimum(np.searchsorted(self.frequent, key), len(self.frequent) - 1)
        return np.where(self.frequent[at] == key, self.df[at], 0)


def document_frequencies(texts: DataFrame, n_docs: int) -> Frequencies:
    """Counts every shingle of every text (column text, binary).

    Tasks sort and count their shingles and send them, packed, by the leading bits of their hash: each once, with how
    often it came if that is more than once, so what is sent of a shingle grows with the tasks and not with the
    documents that share it. One task sums each such range, whose number grows with the documents. What comes back is
    bounded: MOST_BITS, MOST_FREQUENT.
    """
    bucket_bits = min(16, max(6, ceil(log2(n_docs + 1)) - 6))
    map_bits = min(MOST_BITS, max(bucket_bits + 3, ceil(log2(n_docs + 1)) + 11))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send() -> pa.RecordBatch:
            hashes, n = counted_keys(np.concatenate(held), bucket_bits)
            bounds = np.searchsorted(hashes, np.arange(1, 1 << bucket_bits, dtype=np.uint64) << np.uint64(32))
            rows = []
            for i, (keys, times) in enumerate(zip(np.split(hashes.astype(np.uint32), bounds), np.split(n, bounds), strict=True)):
                if len(keys):
                    again = times > 1
                    rows.append((i, _packed(keys), keys[again].astype("<u4").tobytes(), times[again].astype("<u4").tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), *[pa.binary()] * 3))], ["bucket", "packed", "again", "times"])

        for batch in batches:
            for hashes in shingle_sets(batch.column(0).to_pylist()):
                held.append(hashes)
                size += len(hashes)
                if size >= FLUSH:
                    yield send()
                    held, size = [], 0
        if size:
            yield send()

    def count(key: tuple, group: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        values, n = np.unique(np.concatenate([_unpacked(b) for b in group["packed"].to_pylist()]), return_counts=True)
        again = np.frombuffer(b"".join(group["again"].to_pylist()), "<u4")
        np.add.at(n, np.searchsorted(values, again), np.frombuffer(b"".join(group["times"].to_pylist()), "<u4").astype(np.int64) - 1)
        bits = np.zeros(1 << (map_bits - bucket_bits), bool)
        bits[values[n > 1] >> np.uint32(32 - (map_bits - bucket_bits))] = True
        often = np.flatnonzero(n >= FREQUENT)
        often = often[np.argsort(-n[often], kind="stable")]  # the most frequent first, so any of them can be left out
        keys, df = values[often].astype("<u4"), n[often].astype("<u8")
        above = [int((df >= FREQUENT << k).sum()) for k in range(DOUBLINGS)]
        columns = [pa.array([bucket], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary()), pa.array([keys.tobytes()], pa.binary()), pa.array([df.tobytes()], pa.binary()), pa.array([above], pa.list_(pa.int64()))]
        return pa.Table.from_arrays(columns, ["bucket", "bits", "keys", "df", "above"])

    sorted_ = texts.select("text").mapInArrow(sort, "bucket int, packed binary, again binary, times binary")
    counted = sorted_.groupBy("bucket").applyInArrow(count, "bucket int, bits binary, keys binary, df binary, above array<long>")
    counted = cut(counted, "frequencies", few_parts(n_docs))
    totals = counted.agg(*[F.sum(F.col("above")[k]).alias(f"n{k}") for k in range(DOUBLINGS)]).first()
    doubling = next(k for k in range(DOUBLINGS) if (totals[k] or 0) <= MOST_FREQUENT or k == DOUBLINGS - 1)
    step = 1 << (map_bits - bucket_bits - 3)
    bits = np.zeros(1 << (map_bits - 3), np.uint8)
    keys, df = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for row in counted.select("bucket", "bits", F.expr(f"substring(keys, 1, int(4 * above[{doubling}]))").alias("keys"), F.expr(f"substring(df, 1, int(8 * above[{doubling}]))").alias("df")).toLocalIterator():
        bits[row["bucket"] * step : (row["bucket"] + 1) * step] = np.frombuffer(row["bits"], np.uint8)
        keys.append((np.uint64(row["bucket"]) << np.uint64(32)) | np.frombuffer(row["keys"], "<u4").astype(np.uint64))
        df.append(np.frombuffer(row["df"], "<u8").astype(np.int64))
    keys, df = np.concatenate(keys), np.concatenate(df)
    order = np.argsort(keys)
    return Frequencies(bucket_bits, map_bits, bits, keys[order], df[order])


def prefix(hashes: np.ndarray, known: Frequencies) -> tuple[int, int, np.ndarray]:
    """(l, own, shingles): the multi-match prefix of a sorted set, without the shingles no other document has,
    of which there are `own`."""
    n = len(hashes)
    need = (LEAST * n + TIMES - 1) // TIMES
    others = hashes[known.shared(hashes)]
    own = n - len(others)
    first = n - need + 1 - own  # of the prefix for one match, what single shingles do not take up
    if first <= 0:
        return 1, own, hashes[:0]
    df = known.of(others)
    others = others[np.lexsort((others, df))]
    cost = np.cumsum(np.maximum(np.sort(df), 2)).astype(float)
    best = None
    for matches in LADDER:
        taken = min(first + matches - 1, len(others))
        if matches > need or taken < matches:
            break
        price = cost[taken - 1] * (1 + VERIFY_COST / matches)
        if best is None or price < best[0]:
            best = (price, matches, taken)
    return (best[1], own, others[: best[2]]) if best else (1, own, others[:first])


def sketch(hashes: np.ndarray) -> list[int]:
    """Parity of the shingles in each of 64 * SKETCH places: where two sketches differ, so do the sets."""
    odd = np.bincount((hashes & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(bool)).view(np.int64).tolist()


def _sets(docs: DataFrame, held: Broadcast[Frequencies], id_col: str, text_col: str) -> DataFrame:
    """(rid, doc_id, text_sha256, n, digest, matches, own, sketch, prefix, shingles); sketch and shingles only where the prefix holds anything."""
    names = ["rid", "doc_id", "text_sha256", "n", "digest", "matches", "own", "sketch", "prefix", "shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, matches, single, sketches, prefixes, blobs = [], [], [], [], [], [], []
            texts = [t or b"" for t in batch.column(2).to_pylist()]
            for hashes in shingle_sets(texts):
                few, alone, own = prefix(hashes, held.value)
                raw = hashes.astype("<u8").tobytes()
                n.append(len(hashes))
                digests.append(hashlib.blake2b(raw, digest_size=16).digest())
                matches.append(few)
                single.append(alone)
                sketches.append(sketch(hashes) if len(own) else None)
                prefixes.append(own.view(np.int64).tolist())
                blobs.append(raw if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(matches, pa.int32()), pa.array(single, pa.int32()), pa.array(sketches, pa.list_(pa.int64())), pa.array(prefixes, pa.list_(pa.int64())), pa.array(blobs, pa.binary())], names)

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), docs[id_col].cast("long").alias("doc_id"), F.encode(docs[text_col], "UTF-8").alias("text"))
    return rows.mapInArrow(run, "rid long, doc_id long, text_sha256 string, n long, digest binary, matches int, own int, sketch array<long>, prefix array<long>, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """Of the pairs (a, b, ...) those whose sets are similar."""
    columns, at = pairs.columns, len(pairs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(at).to_pylist(), batch.column(at + 1).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(TIMES * both >= LEAST * (len(x) + len(y) - both))
            yield batch.select(list(range(at))).filter(pa.array(keep, pa.bool_()))

    side = lambda name: sets.select(F.col("rid").alias(name), F.col("shingles").alias(f"{name}_set"))
    with_sets = pairs.join(side("a"), "a").join(side("b"), "b").select(*columns, "a_set", "b_set")
    return cut(with_sets.mapInArrow(run, pairs.schema), "similar", parts)


def _enough(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b, least, ...) listed once for each shared prefix shingle, those with enough of them."""
    more = [c for c in pairs.columns if c not in ("a", "b", "least")]
    counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("__n"), F.max("least").alias("least"), *[F.max(c).alias(c) for c in more])
    return counted.filter("__n >= least").select("a", "b", *more)


def _ordered(a: Column, b: Column, more: dict[str, tuple[Column, Column]]) -> list[Column]:
    """a and b with the smaller first, a's and b's other values as a_name and b_name, and how many shingles they need."""
    turned = a > b
    both = {"": (a, b), **{f"_{k}": v for k, v in more.items()}}
    sides = [F.when(turned, v[1 - at]).otherwise(v[at]).alias("ab"[at] + name) for name, v in both.items() for at in (0, 1)]
    return [*sides, F.least("matches", "other_matches").alias("least")]


#: Similar sets are of like size, and what they share is at most what either has that is not its own alone.
_FITS = f"""{TIMES} * least(n, other_n) >= {LEAST} * greatest(n, other_n) and
  {TIMES} * least(n - own, other_n - other_own) >= {LEAST} * (n + other_n - least(n - own, other_n - other_own))"""
#: And their sketches differ in at most as many places as the sets may differ in shingles.
_ALIKE = f"{TIMES + LEAST} * ({' + '.join(f'bit_count(sketch[{i}] ^ other_sketch[{i}])' for i in range(SKETCH))}) <= {TIMES - LEAST} * (n + other_n)"


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id, n_shingles, component_id (the smallest doc_id of the class), kept (the one row of a class
    that has it), text_sha256, one row per input row.

    Two documents link when TIMES * |intersection| >= LEAST * |union| of their sets of five-word shingles; a
    class is what links reach. Null and empty texts and those without words have no shingles and link with
    nothing; their component is their own doc_id. Rows that repeat a doc_id are documents of their own. A null
    doc_id is passed over in the smallest of a class. An empty table gives an empty result. Other columns are
    not read.
    """
    n_docs = docs.count()
    parts = few_parts(n_docs)
    known = document_frequencies(bounded_batches(docs).select(F.encode(F.col(text_col), "UTF-8").alias("text")), n_docs)
    held = docs.sparkSession.sparkContext.broadcast(known)
    del known
    every = cut(_sets(docs, held, id_col, text_col), "sets")
    held.destroy()
    # Documents of the same set are one from here on.
    first = F.min_by(F.struct("rid", "n", "matches", "own", "sketch", "prefix", "shingles"), "rid")
    same = every.filter("n > 0 and size(prefix) > 0").groupBy("digest").agg(first.alias("x")).select("x.*")
    sets = cut(same, "distinct-sets", 4 * parts)
    classes = joined_classes(sets, parts)
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("rid").alias("keep")))
    member = every.filter("n > 0").groupBy("digest").agg(smallest.alias("least"), F.min("rid").alias("rid"))
    member = cut(member.join(classes.withColumnRenamed("node", "rid"), "rid", "left").select("digest", "least", F.coalesce("root", "rid").alias("root")), "members", parts)
    least = cut(member.groupBy("root").agg(F.min("least").alias("least")), "components", parts)
    member = cut(member.select("digest", "root").join(least, "root").select("digest", "least.doc_id", "least.keep"), "membership", parts).withColumnRenamed("doc_id", "component_id")
    out = every.select("rid", "doc_id", "text_sha256", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest")).join(member, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    kept = (F.col("n") == 0) | (F.col("rid") == F.col("keep"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"), "text_sha256")


_ROW = ["shingle", "rid", "n", "matches", "own", "root"]
_OTHER = ["rid", "n", "matches", "own", "root"]


def _open_rows(rows: DataFrame, turn: int, parts: int) -> DataFrame:
    """Of rows (rid, n, matches, own, root, shingle) those of shingles that documents of different classes share,
    with the shingle's leader and its number of rows. Of the documents of a shingle the one with the least of its
    own is most like what the others were copied from; on later turns any other leads."""
    central = F.struct(F.col("own") / F.col("n") if turn == 0 else F.lit(0.0), F.xxhash64("rid", F.lit(turn)))
    lead = F.min_by(F.struct(*_OTHER), central)
    seen = rows.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("k"), lead.alias("lead"))
    # Written, so that the rows of a frequent shingle can be split in the join.
    shared = cut(seen.filter("lo != hi").select("shingle", "k", "lead"), "open-shingles", parts)
    return cut(rows.join(shared, "shingle").select(*_ROW, "k", "lead"), "open-rows", 2 * parts)


def _led(open_: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """Links (a, b, a_root, b_root, a_leads, b_leads) of documents with leaders of theirs."""
    pairs = open_.filter("root != lead.root").select(*_OTHER, *[F.col(f"lead.{c}").alias("other" if c == "rid" else f"other_{c}") for c in _OTHER]).filter(_FITS)
    pairs = pairs.select(*_ordered(F.col("rid"), F.col("other"), {"root": (F.col("root"), F.col("other_root")), "leads": (F.lit(0), F.lit(1))}))
    return _verified(_enough(pairs), sets, parts)


def _followed(links: DataFrame) -> DataFrame:
    """(node, root): of each class with links the one that it joins, leaders before others, then by hash. Whether a
    class leads is asked of each link, which is never more than it does at all, so no circle can arise."""
    place = lambda leads, root: F.struct((1 - F.col(leads)).alias("f"), F.xxhash64(root).alias("h"), F.col(root).alias("v"))
    view = lambda own, other: links.select(F.col(f"{own}_root").alias("node"), place(f"{own}_leads", f"{own}_root").alias("own"), place(f"{other}_leads", f"{other}_root").alias("to"))
    ends = view("a", "b").unionByName(view("b", "a")).groupBy("node").agg(F.min(F.least("own", "to")).alias("to"))
    points = ends.select("node", F.col("to.v").alias("root"))
    further = points.select(F.col("node").alias("root"), F.col("root").alias("next"))
    return points.join(further, "root").select("node", F.col("next").alias("root"))


def _unlike_classes(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs (a, b, least) of documents of different classes for each shingle they share, but for those that
    cannot be similar. The rows of a shingle with many are parted by size and by hash, and each part meets the
    parts that hold documents similar to its own in a cell of its own."""
    sized = open_.select(*_ROW, "k").join(sets.select("rid", "sketch"), "rid")
    # Sizes of similar sets lie in the same band or in neighbouring ones.
    sized = sized.withColumn("chunks", F.expr(f"int((k + {CELL - 1}) div {CELL})"))
    sized = sized.withColumn("band", F.expr(f"if(chunks = 1, 0, int(floor(ln(n) / ln({TIMES} / {LEAST} * 1.0001))))"))
    sized = sized.withColumn("chunk", F.expr("int(pmod(xxhash64(rid, 5), chunks))"))
    every = "transform(sequence(0, chunks - 1), x -> named_struct('lb', {lb}, 'l', {l}, 'rb', {rb}, 'r', {r}))"
    within = "transform(sequence({lo}, {hi}), x -> named_struct('lb', band, 'l', {l}, 'rb', band, 'r', {r}))"
    lower = within.format(lo="chunk", hi="chunks - 1", l="chunk", r="x")
    upper = within.format(lo="0", hi="chunk", l="x", r="chunk")
    next_up = every.format(lb="band", l="chunk", rb="band + 1", r="x")
    next_down = every.format(lb="band - 1", l="x", rb="band", r="chunk")
    cells = lambda own, next_: F.explode(F.expr(f"if(chunks = 1, {own}, concat({own}, {next_}))")).alias("cell")
    carried = ["rid", "n", "matches", "own", "root", "sketch"]
    a = sized.select("shingle", cells(lower, next_up), *carried)
    b = sized.select("shingle", cells(upper, next_down), *[F.col(c).alias("other" if c == "rid" else f"other_{c}") for c in carried])
    met = a.join(b, ["shingle", "cell"]).filter("root != other_root and (rid < other or cell.lb != cell.rb or cell.l != cell.r)")
    return met.filter(_FITS).filter(_ALIKE).select(*_ordered(F.col("rid"), F.col("other"), {}))


def joined_classes(sets: DataFrame, parts: int) -> DataFrame:
    """(node, root) of all documents of sets, by their prefixes; documents of a class share a root."""
    classes = sets.select(F.col("rid").alias("node"), F.col("rid").alias("root"))
    rows = sets.select("rid", "n", "matches", "own", F.col("rid").alias("root"), F.explode("prefix").alias("shingle"))
    links, before, turn = None, float("inf"), 0
    while True:
        open_ = _open_rows(rows, turn, parts)
        size = open_.count()
        # Comparing with leaders no longer closes shingles: the rest is compared pair by pair. A round that has closed
        # none ends the loop whatever WORTH is.
        if size == 0 or size > WORTH * before or size >= before:
            break
        found = _led(open_, sets, parts)
        between = found.select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
        links = between if links is None else links.unionByName(between)
        classes = cut(onward(classes, _followed(found)), "classes", parts)
        rows = open_.select(*_ROW).drop("root").join(classes.withColumnRenamed("node", "rid"), "rid")
        before, turn = size, turn + 1
    if size:
        rest = _verified(_enough(_unlike_classes(open_, sets)), sets, parts)
        links = rest if links is None else links.unionByName(rest)
    return classes if links is None else components(links, parts, classes)
