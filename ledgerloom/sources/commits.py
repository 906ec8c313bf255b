"""Tables of versions: a commit writes new files aside and then puts one manifest in place, so a reader sees all of it
or nothing, and a writer learns how many rows it inserted, updated, left alone and deleted.

    path/data/<id>/__part=<hex>/...   rows of one partition, as one commit wrote them; never changed again
    path/versions/<n>.json            which folder holds each partition in version n

Only partitions with incoming rows are written again. A manifest is moved to its name only if no other has it, so of
two writers that began at one version the later one fails and leaves the table as the first has made it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

from .shared import fresh_path, staged

#: States of a row in a commit.
INSERTED, UPDATED, UNCHANGED = "inserted", "updated", "unchanged"


class Conflict(RuntimeError):
    """Another writer has committed since this one read the table."""


class Commit(NamedTuple):
    """What a commit did, in keys that it was given (and those it deleted). Its version is that of the table before if
    nothing has changed."""

    version: int
    inserted: int = 0
    updated: int = 0
    unchanged: int = 0
    deleted: int = 0


class Store:
    """Files of one folder by the file system that its address names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.root = spark._jvm, path.rstrip("/")
        hadoop = self.jvm.org.apache.hadoop.fs
        at, conf = hadoop.Path(self.root), spark._jsc.hadoopConfiguration()
        self.fs = at.getFileSystem(conf)
        self.context = hadoop.FileContext.getFileContext(self.fs.makeQualified(at).toUri(), conf)
        self.no_options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)

    def at(self, name: str):
        return self.fs.makeQualified(self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}"))

    def names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.at(folder))] if self.fs.exists(self.at(folder)) else []

    def text(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Writes a file under another name and moves it to this one; an error if there is one already."""
        aside = f"aside/{uuid.uuid4().hex}"
        out = self.fs.create(self.at(aside), False)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
        self.fs.mkdirs(self.at(name).getParent())
        try:
            self.context.rename(self.at(aside), self.at(name), self.no_options)
        except Py4JJavaError as failure:
            self.fs.delete(self.at(aside), False)
            if "FileAlreadyExists" in failure.java_exception.getClass().getName():
                raise Conflict(f"{name} is there already") from None
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


class VersionedTable:
    """Rows of a schema by keys, the partition column being one of them."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: list[str], partition: str):
        if partition not in keys:
            raise ValueError("the partition column must be a key, or a row could be in two partitions")
        self.spark, self.store = spark, Store(spark, path)
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.keys, self.partition = keys, partition
        self.others = [c for c in self.schema.fieldNames() if c not in keys]

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.store.names("versions"))

    def version(self) -> int:
        """The newest version; 0 for a table that nothing was committed to."""
        return max(self.versions(), default=0)

    def done(self, name: str, number: int = 0) -> bool:
        """Whether a batch of a stream, or a change that is made once, is committed."""
        return self._manifest()["batches"].get(name, -1) >= number

    def _manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        return json.loads(self.store.text(f"versions/{version}.json")) if version else {"version": 0, "parts": {}, "batches": {}}

    def _rows(self, manifest: dict, parts: list[str] | None = None) -> DataFrame:
        folders = [f for p, f in sorted(manifest["parts"].items()) if parts is None or p in set(parts)]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.store.root}/{f}" for f in folders])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest if none is named, whatever is committed meanwhile."""
        return self._rows(self._manifest(version))

    def upsert(self, incoming: DataFrame, order: list[str], latest: bool = False, batch: tuple[str, int] | None = None) -> Commit:
        """Incoming rows replace stored ones of their key; of several incoming the greatest by `order` counts. With
        `latest` the greatest of all stays, the incoming one of equals."""
        by = [*order, "__new"] if latest else ["__new", *order]
        return self._commit(incoming, F.max_by(self._content(), F.struct(*by)), batch=batch)

    def insert_new(self, incoming: DataFrame, order: list[str], batch: tuple[str, int] | None = None) -> Commit:
        """Stored rows stay; of several incoming of a new key the least by `order` is inserted."""
        return self._commit(incoming, F.min_by(self._content(), F.struct("__new", *order)), batch=batch)

    def replace(self, incoming: DataFrame, order: list[str], batch: tuple[str, int] | None = None) -> Commit:
        """The incoming rows are the table: stored keys that they lack are deleted."""
        return self._commit(incoming, F.max_by(self._content(), F.struct("__new", *order)), whole=True, batch=batch)

    def bootstrap(self, compute: Callable[[], DataFrame], order: list[str]) -> Commit | None:
        """Fills a table that nothing was ever committed to; None, and nothing is computed, for any other."""
        return None if self.version() else self.upsert(compute(), order)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes all but the newest `keep` versions, and the folders no version kept needs; returns how many folders.
        Readers of older versions and writers that are at work must be done."""
        kept = self.versions()[-keep:]
        needed = {f.split("/")[1] for v in kept for f in self._manifest(v)["parts"].values()}
        for v in self.versions():
            if v not in kept:
                self.store.delete(f"versions/{v}.json")
        gone = [f for f in self.store.names("data") if f not in needed]
        for f in gone:
            self.store.delete(f"data/{f}")
        return len(gone)

    def _content(self) -> Column:
        return F.struct(*self.others) if self.others else F.struct(F.lit(0).alias("__none"))

    def _same(self, a: str, b: str) -> Column:
        """Whether two contents are the same, nulls being equal; maps by their entries."""
        side = lambda of, c: F.array_sort(F.map_entries(f"{of}.{c}")) if isinstance(self.schema[c].dataType, MapType) else F.col(f"{of}.{c}")
        return reduce(Column.__and__, [side(a, c).eqNullSafe(side(b, c)) for c in self.others], F.lit(True))

    def _commit(self, incoming: DataFrame, chosen: Column, whole: bool = False, batch: tuple[str, int] | None = None) -> Commit:
        """`batch` names a stream and its batch: one that is committed already is passed over."""
        base = self._manifest()
        if batch and self.done(*batch):
            return Commit(base["version"])
        part = F.coalesce(F.hex(F.col(self.partition).cast("string")), F.lit("none"))
        given = incoming.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        touched = staged(given.withColumn("__part", part), fresh_path(self.spark, "incoming"))
        parts = list(base["parts"]) if whole else [r[0] for r in touched.select("__part").distinct().collect()]
        stored = self._rows(base, parts)
        both = stored.withColumn("__new", F.lit(0)).unionByName(touched.drop("__part").withColumn("__new", F.lit(1)))
        before = F.max_by(self._content(), F.when(F.col("__new") == 0, 0)).alias("before")
        merged = both.groupBy(*self.keys).agg(chosen.alias("x"), before, F.max("__new").alias("given"))
        if whole:
            merged = merged.filter("given = 1")
        # Rows of a touched partition that no incoming row has the key of are written again, but not counted.
        state = F.when(F.col("given") == 0, "kept").when(F.col("before").isNull(), INSERTED).when(self._same("x", "before"), UNCHANGED).otherwise(UPDATED)
        fields = [F.col(c) if c in self.keys else F.col(f"x.{c}") for c in self.schema.fieldNames()]
        folder = f"data/{uuid.uuid4().hex}"
        # Rebalanced, so that a partition is few files, and a large one is still written by several tasks.
        out = merged.select(*fields, state.alias("__state"), part.alias("__part")).hint("rebalance", "__part")
        out.write.partitionBy("__part").parquet(f"{self.store.root}/{folder}")
        written = [n for n in self.store.names(folder) if n.startswith("__part=")]
        states = {}
        if written:
            states = {r["__state"]: r["n"] for r in self.spark.read.schema("__state string").parquet(f"{self.store.root}/{folder}").groupBy("__state").agg(F.count(F.lit(1)).alias("n")).collect()}
        deleted = stored.count() - states.get(UPDATED, 0) - states.get(UNCHANGED, 0) if whole else 0
        counts = (states.get(INSERTED, 0), states.get(UPDATED, 0), states.get(UNCHANGED, 0), deleted)
        changed = bool(counts[0] or counts[1] or counts[3])
        if not changed and not batch:
            self.store.delete(folder)
            return Commit(base["version"], *counts)
        fresh = {n.removeprefix("__part="): f"{folder}/{n}" for n in written}
        batches = base["batches"] | ({batch[0]: batch[1]} if batch else {})
        manifest = {"version": base["version"] + 1, "parts": fresh if whole else base["parts"] | fresh, "batches": batches, "counts": counts}
        self.publish(manifest)
        return Commit(manifest["version"], *counts)

    def publish(self, manifest: dict) -> None:
        """The one step that changes the table."""
        self.store.put(f"versions/{manifest['version']}.json", json.dumps(manifest))
