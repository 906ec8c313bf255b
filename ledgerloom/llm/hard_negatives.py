"""Hard negatives by a nearest-neighbour join over a Voronoi partition.

The score is the inner product. With M the largest length of a row, every row x gets one entry more, the root of
M^2 - |x|^2, and every anchor a zero: then rows nearer to an anchor are those of a higher score. Rows and anchors go
to the nearest of some pivots, which are rows drawn by a hash; cells keep how far their rows and anchors lie from
the pivot. By the triangle inequality a row of cell c at distance d serves no anchor of cell i that wants rows no
farther than `far` and no nearer than `near` unless |pivots' distance - d| <= far + the anchors' radius, and
pivots' distance + d + radius >= near. Each row is copied to the groups of anchors that it may serve, and there
joined exactly, in chunks of rows and anchors that no number of them makes larger.

Positives are the nearest rows of the anchor's label: `far` comes from the rows of that label nearest to the pivots
around. Negatives lie between two shares of a positive's score, which gives `far` and `near`.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut
from .vectors import common_size, finite, scaled

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: Scores of negatives as tenths of the positive's score.
LEAST_TENTHS, MOST_TENTHS = 3, 9
#: Pivots at most (what the driver plans is a row for each two of them), and rows for each pivot below that.
PIVOTS, CELL_ROWS = 256, 4096
#: Pivots around an anchor's own whose rows bound how far its positives lie.
AROUND = 8
#: Anchors and rows that meet in one local join, about; of few rows, fewer meet, so that all cores have some.
ANCHORS, CHUNK, LEAST_CHUNK, CHUNKS = 2048, 8192, 256, 64
#: Anchors scored together.
BLOCK = 256
#: Share of M by which reckoned distances may be wrong, amply.
SLACK = 1e-6


class Pivots:
    """Pivots with the entry more, and the distances of each two."""

    def __init__(self, rows: np.ndarray, longest: float):
        self.square = longest
        self.rows = np.column_stack([rows, np.sqrt(np.maximum(longest - (rows * rows).sum(axis=1), 0))])
        apart = self.rows[:, None, :] - self.rows[None, :, :] if len(rows) < 64 else None
        self.apart = np.sqrt((apart**2).sum(axis=2)) if apart is not None else np.stack([np.sqrt(((self.rows - r) ** 2).sum(axis=1)) for r in self.rows])

    def nearest(self, x: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance) of the rows x with the entries `more`."""
        squares = (x * x).sum(axis=1) + more * more
        apart = squares[:, None] + (self.rows**2).sum(axis=1)[None, :] - 2 * (x @ self.rows[:, :-1].T + more[:, None] * self.rows[None, :, -1])
        cell = apart.argmin(axis=1)
        return cell, np.sqrt(np.maximum(apart[np.arange(len(x)), cell], 0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of lists of one size as rows."""
    held = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return held.flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1)


def usable_rows(vectors: DataFrame, anchor: Column, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, anchor, x, square): rows with an id, a label and a usable vector of the size that most have."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector_col).alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v")))
    rows = rows.filter(F.size("v") == common_size(rows, "v")).select("vec_id", "label", "anchor", scaled(F.col("v"), SCALE).alias("x"))
    return rows.withColumn("square", F.aggregate("x", F.lit(0).cast("long"), lambda s, c: s + c * c))


def drawn_pivots(rows: DataFrame, n: int, longest: int) -> Pivots:
    """Rows of the least hash, at most PIVOTS, the same on every run; equal vectors are one."""
    most = min(PIVOTS, max(1, ceil(n / CELL_ROWS)))
    drawn = rows.select("x", F.xxhash64("vec_id", F.lit(17)).alias("h"), "vec_id").orderBy("h", "vec_id").limit(most)
    return Pivots(np.unique(np.array([r["x"] for r in drawn.collect()], float), axis=0), float(longest))


def _placed(rows: DataFrame, held: Broadcast[Pivots]) -> DataFrame:
    """rows with rid, and the cell and distance of each as a row (cell, dist) and, of anchors, as an anchor (acell, adist)."""
    names = ["rid", "vec_id", "label", "anchor", "x", "square", "cell", "dist", "acell", "adist"]

    def run(batches):
        pivots = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, anchor = _matrix(batch.column(4)).astype(float), batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            cell, dist = pivots.nearest(x, np.sqrt(np.maximum(pivots.square - (x * x).sum(axis=1), 0)))
            acell, adist = np.full(len(x), -1), np.zeros(len(x))
            if anchor.any():
                acell[anchor], adist[anchor] = pivots.nearest(x[anchor], np.zeros(int(anchor.sum())))
            more = [pa.array(cell, pa.int32()), pa.array(dist), pa.array(acell, pa.int32()), pa.array(adist)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names)

    return rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", "anchor", "x", "square").mapInArrow(run, "rid long, vec_id long, label long, anchor boolean, x array<long>, square long, cell int, dist double, acell int, adist double")


def grouped(counts: np.ndarray, apart: np.ndarray) -> tuple[list[int], list[int]]:
    """(group of each cell, splits of each group): cells with few anchors go with their neighbours, and a group of
    more than ANCHORS is split into as many as they need."""
    group, sizes, at, left = [0] * len(counts), [0], 0, set(range(1, len(counts)))
    while True:
        if sizes[-1] and sizes[-1] + counts[at] > ANCHORS:
            sizes.append(0)
        group[at] = len(sizes) - 1
        sizes[-1] += int(counts[at])
        if not left:
            return group, [max(1, ceil(s / ANCHORS)) for s in sizes]
        at = min(left, key=lambda c: (apart[at][c], c))
        left.remove(at)


def _chunks(n: Column) -> Column:
    """Into how many chunks n rows are dealt."""
    return F.greatest(F.lit(1), F.ceil(n / CHUNK), F.least(F.lit(CHUNKS), F.ceil(n / LEAST_CHUNK))).cast("int")


def _literals(values: list, kind: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def _split(splits: Column, group: Column) -> Column:
    return F.pmod(F.xxhash64("rid", F.lit(3)), F.get(splits, group)).cast("int")


def _copied(rows: DataFrame, serves: Column, groups: list[int], splits: list[int]) -> DataFrame:
    """rows (with chunks) once for each group and split of anchors; serves lists the cells of anchors they may serve."""
    into = F.array_distinct(F.transform(serves, lambda t: F.get(_literals(groups, "int"), t)))
    each = rows.withColumn("grp", F.explode(into))
    each = each.withColumn("split", F.explode(F.sequence(F.lit(0), F.get(_literals(splits, "int"), F.col("grp")) - 1)))
    return each.withColumn("chunk", F.pmod(F.xxhash64("rid", F.lit(5)), F.col("chunks")).cast("int"))


def _dealt(anchors: DataFrame, groups: list[int], splits: list[int]) -> DataFrame:
    """anchors (with chunks) in their group and split, once for each chunk of rows."""
    own = anchors.withColumn("grp", F.get(_literals(groups, "int"), F.col("acell")))
    own = own.withColumn("split", _split(_literals(splits, "int"), F.col("grp")))
    return own.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices, exact: by doubles where these hold them all."""
    size = max(1, a.shape[1]) * max(1, int(np.abs(a).max(initial=0))) * max(1, int(np.abs(b).max(initial=0)))
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if size < 2**53 else a @ b.T


def highest(scored: np.ndarray, allowed: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the `most` highest allowed entries of each row, the first column before a later one."""
    width = scored.shape[1]
    most = min(most, width)
    if int(np.abs(scored).max(initial=0)) < 2**62 // (width + 1):
        keys = np.where(allowed, scored * width + (width - 1 - np.arange(width)), -(2**63))
        best = np.argpartition(keys, width - most, axis=1)[:, width - most :]
    else:
        best = np.stack([np.lexsort((np.arange(width), -s, ~ok))[:most] for s, ok in zip(scored, allowed, strict=True)]) if len(scored) else np.zeros((0, most), int)
    at, turn = np.nonzero(np.take_along_axis(allowed, best, axis=1))
    return at, best[at, turn]


def _locally(find: Callable, schema: pa.Schema) -> Callable:
    """A local join: `find` gets BLOCK anchors, the rows by ascending id, their scores, and returns columns."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return schema.empty_table()
        rows = rows.sort_by("vec_id")
        x, found = _matrix(rows["x"]), []
        for at in range(0, anchors.num_rows, BLOCK):
            some = anchors.slice(at, BLOCK)
            found.append(pa.Table.from_arrays([pa.array(c) for c in find(some, rows, scores(_matrix(some["x"]), x))], names=schema.names).cast(schema))
        return pa.concat_tables(found)

    return run


_KEY = ["label", "grp", "split", "chunk"]
_FOUND = "rid long, anchor_id long, other_id long, score long"


def _nearest_of_label(anchors: pa.Table, rows: pa.Table, scored: np.ndarray) -> list:
    own, theirs = anchors["rid"].to_numpy(), rows["rid"].to_numpy()
    at, other = highest(scored, own[:, None] != theirs[None, :], POSITIVES)
    return [own[at], anchors["vec_id"].to_numpy()[at], rows["vec_id"].to_numpy()[other], scored[at, other]]


def _in_band(anchors: pa.Table, rows: pa.Table, scored: np.ndarray) -> list:
    own, label, given = anchors["rid"].to_numpy(), anchors["label"].to_numpy(), anchors["positives"].to_pylist()
    differ, out = label[:, None] != rows["label"].to_numpy()[None, :], []
    for turn in range(POSITIVES):
        has = np.array([i for i, p in enumerate(given) if len(p) > turn], int)
        if not len(has):
            break
        positive = [given[i][turn]["score"] for i in has]
        least = np.array([-(-LEAST_TENTHS * p // 10) for p in positive])[:, None]
        most = np.array([MOST_TENTHS * p // 10 for p in positive])[:, None]
        part = scored[has]
        at, other = highest(part, differ[has] & (part >= least) & (part <= most), NEGATIVES)
        out.append([own[has][at], np.full(len(at), turn), rows["vec_id"].to_numpy()[other], part[at, other]])
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4


def _joined(anchors: DataFrame, rows: DataFrame, key: list[str], find: Callable, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    local = _locally(find, pa.schema([(c, pa.int64()) for c in names]))
    rows = rows.toDF(*rows.columns)  # both sides come from one table; columns of one of them get ids of their own
    return anchors.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(local, schema)


def _radii(placed: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(number, radius) of the anchors of each cell."""
    counts, radius = np.zeros(k, np.int64), np.zeros(k)
    for r in placed.filter("acell >= 0").groupBy("acell").agg(F.count(F.lit(1)).alias("n"), F.max("adist").alias("r")).collect():
        counts[r["acell"]], radius[r["acell"]] = r["n"], r["r"]
    return counts, radius


def positives(placed: DataFrame, pivots: Pivots) -> DataFrame:
    """(rid, turn, positive_id, score): the first POSITIVES other rows of each anchor's label."""
    spark, k = placed.sparkSession, len(pivots.rows)
    counts, radius = _radii(placed, k)
    groups, splits = grouped(counts, pivots.apart)
    slack = SLACK * (1 + pivots.square**0.5)
    # How far the positives of a label and a cell of anchors lie at most: one more row of it than is asked for, as the
    # anchor may be among them, lies within this distance.
    near = Window.partitionBy("label", "cell").orderBy("dist")
    entries = placed.select("label", "cell", "dist", F.row_number().over(near).alias("i")).filter(F.col("i") <= POSITIVES + 1)
    around = [(int(i), int(c), float(radius[i] + pivots.apart[i][c])) for i in np.flatnonzero(counts) for c in np.argsort(pivots.apart[i], kind="stable")[:AROUND]]
    beside = spark.createDataFrame(around, "acell int, cell int, base double") if around else spark.createDataFrame([], "acell int, cell int, base double")
    within = entries.join(F.broadcast(beside), "cell").select("label", "acell", (F.col("base") + F.col("dist")).alias("bound"))
    turn = Window.partitionBy("label", "acell").orderBy("bound")
    within = within.withColumn("i", F.row_number().over(turn)).filter(F.col("i") == POSITIVES + 1).select("label", "acell", "bound")
    cells = placed.filter("anchor").select("label", "acell").distinct().join(within, ["label", "acell"], "left")
    wanted = cells.groupBy("label").agg(F.collect_list(F.struct("acell", (F.coalesce("bound", F.lit(float("inf"))) + F.get(_literals(radius.tolist(), "double"), F.col("acell")) + slack).alias("reach"))).alias("wanted"))
    labels = cut(placed.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(wanted, "label").select("label", "wanted", _chunks(F.col("n")).alias("chunks")), "labels")
    apart = spark.createDataFrame([(c, pivots.apart[c].tolist()) for c in range(k)], "cell int, apart array<double>")
    rows = placed.select("rid", "vec_id", "label", "x", "cell", "dist").join(labels, "label").join(F.broadcast(apart), "cell")
    may = F.filter("wanted", lambda t: F.abs(F.get(F.col("apart"), t["acell"]) - F.col("dist")) <= t["reach"])
    rows = _copied(rows, F.transform(may, lambda t: t["acell"]), groups, splits).select(*_KEY, "rid", "vec_id", "x")
    anchors = _dealt(placed.filter("anchor").select("rid", "vec_id", "label", "x", "acell").join(labels.drop("wanted"), "label"), groups, splits).select(*_KEY, "rid", "vec_id", "x")
    found = _joined(anchors, rows, _KEY, _nearest_of_label, _FOUND)
    best = Window.partitionBy("rid").orderBy(F.desc("score"), "other_id")
    return found.withColumn("turn", F.row_number().over(best) - 1).filter(F.col("turn") < POSITIVES).select("rid", "turn", F.col("other_id").alias("positive_id"), "score")


def negatives(placed: DataFrame, pivots: Pivots, given: DataFrame, n: int) -> DataFrame:
    """(rid, turn, other_id, score): for each anchor and positive (given) the first rows of other labels in its band."""
    k, slack = len(pivots.rows), SLACK * (1 + pivots.square**0.5)
    lists = given.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("turn", "score"))).alias("positives"))
    # A negative score leaves no band; as positives fall, those of one come last.
    lists = lists.withColumn("own", F.filter("positives", lambda p: p["score"] >= 0)).filter("size(own) > 0")
    anchors = placed.filter("anchor").select("rid", "vec_id", "label", "x", "square", "acell", "adist").join(lists.select("rid", F.col("own").alias("positives")), "rid")
    anchors = cut(anchors, "anchors")
    # Distances to rows of the least and the highest score of any of an anchor's bands.
    at = lambda score, tenths: F.sqrt(F.greatest(F.lit(pivots.square) + F.col("square") - score * (tenths / 5), F.lit(0.0)))
    bands = anchors.select("acell", "adist", at(F.col("positives")[F.size("positives") - 1]["score"], LEAST_TENTHS).alias("far"), at(F.col("positives")[0]["score"], MOST_TENTHS).alias("near"))
    by_cell = {r["acell"]: r for r in bands.groupBy("acell").agg(F.count(F.lit(1)).alias("n"), F.max("adist").alias("r"), F.max("far").alias("far"), F.min("near").alias("near")).collect()}
    groups, splits = grouped(np.array([by_cell[i]["n"] if i in by_cell else 0 for i in range(k)]), pivots.apart)
    plan = [(c, [(i, float(pivots.apart[c][i]), b["r"] + b["far"] + slack, b["near"] - b["r"] - slack) for i, b in by_cell.items()]) for c in range(k)]
    served = placed.sparkSession.createDataFrame(plan, "cell int, wanted array<struct<acell:int,apart:double,reach:double,least:double>>")
    chunks = _chunks(F.lit(n))
    rows = placed.select("rid", "vec_id", "label", "x", "cell", "dist", chunks.alias("chunks")).join(F.broadcast(served), "cell")
    may = F.filter("wanted", lambda t: (F.abs(t["apart"] - F.col("dist")) <= t["reach"]) & (t["apart"] + F.col("dist") >= t["least"]))
    key = _KEY[1:]
    rows = _copied(rows, F.transform(may, lambda t: t["acell"]), groups, splits).select(*key, "rid", "vec_id", "label", "x")
    dealt = _dealt(anchors.withColumn("chunks", chunks), groups, splits).select(*key, "rid", "vec_id", "label", "x", "positives")
    found = _joined(dealt, rows, key, _in_band, "rid long, turn long, other_id long, score long")
    best = Window.partitionBy("rid", "turn").orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= NEGATIVES)


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score: for each anchor (a
    row of which the column `anchor` is true) and each of its first POSITIVES other rows of the same label, the
    NEGATIVES highest rows of other labels whose score lies between 3 and 9 tenths of the positive's.

    Entries c count as floor(256 c), scores are their inner products, ties go to the smaller id. Rows with a null id,
    label or vector, an empty vector, a null or non-finite entry, or a vector of another size than most have take no
    part; a null in `anchor` is false. Rows that repeat an id are rows of their own, each an anchor if one is; rows
    of one id and one score stand in either order, which shows in no column. An anchor without other rows of its
    label, or whose positives all score below 0, has no rows in the result; an empty table gives an empty result.
    Labels are whole numbers. Vectors whose square is beyond a long end the query by Spark's overflow error. Other
    columns are not read.
    """
    spark: SparkSession = vectors.sparkSession
    rows = usable_rows(vectors, anchor, id_col, vector_col, label_col)
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.max("square").alias("square")).first()
    if not sizes["n"]:
        return spark.createDataFrame([], _RESULT)
    pivots = drawn_pivots(rows, sizes["n"], sizes["square"])
    placed = cut(_placed(rows, spark.sparkContext.broadcast(pivots)), "placed-vectors")
    given = cut(positives(placed, pivots), "positives")
    found = negatives(placed, pivots, given, sizes["n"])
    ids = placed.filter("anchor").select("rid", F.col("vec_id").alias("anchor_id"))
    return found.select("rid", "turn", "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score")).join(given.withColumnRenamed("score", "positive_score"), ["rid", "turn"]).join(ids, "rid").select(*[c.split()[0] for c in _RESULT.split(", ")])
