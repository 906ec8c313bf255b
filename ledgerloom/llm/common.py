"""What the text operators share: reading tables, cutting lineage, prefix sums."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

WHITE = r"[\x20\x09-\x0D]+"
_RUNS: dict[str, list[str]] = {}


#: Rows and bytes that pass to a Python worker at once: texts can be long.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """Makes the session hand texts to Python workers in small batches, from now on, since plans that are run later
    read the setting when they run; returns df."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) not in range(1, BATCH_ROWS + 1):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table as read, dealt out over all cores if its files make fewer tasks than that; else df itself."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _drop_runs(app: str) -> None:
    """Deletes the written tables of one application, while its JVM still answers."""
    try:
        spark = SparkSession.getActiveSession()
        if spark is None or spark.sparkContext.applicationId != app:
            return
        for path in _RUNS.pop(app, []):
            _delete(spark, path)
    except Exception:  # noqa: BLE001  the session is gone, and with it the way to the store
        return


def written(spark: SparkSession) -> int:
    """How many tables have been cut so far."""
    return len(_RUNS.get(spark.sparkContext.applicationId, []))


def forget(spark: SparkSession, since: int) -> None:
    """Deletes the tables cut since then (see written) but the last, which must not need them any more."""
    runs = _RUNS.get(spark.sparkContext.applicationId, [])
    for path in runs[since:-1]:
        _delete(spark, path)
    del runs[since:-1]


def cut(df: DataFrame, label: str, parts: int | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, so lost executors repeat
    no earlier stage, and ids given inside df are the same for every later reader.

    `parts` bounds the number of files of a table that is small for its number of partitions (see few_parts).
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/ledgerloom-{label}-{uuid.uuid4().hex}"
    if app not in _RUNS:
        _RUNS[app] = []
        atexit.register(_drop_runs, app)
    _RUNS[app].append(path)
    held = df if parts is None else df.repartition(parts)
    held.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few_parts(rows: int, each: int = 50_000) -> int:
    """Files for a table of about one short row for each of so many documents."""
    return max(2, rows // each)


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of text, in order; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def chunk_count(rows: int, each: int = 256, most: int = 100_000) -> int:
    """Chunks for running_start: about `each` rows a chunk, and no more offsets than one window sorts with ease."""
    return max(1, min(most, rows // each))


def running_start(df: DataFrame, keys: list[str], order: list[str], amount: Column, out: str, spread: str, n_chunks: int) -> DataFrame:
    """Adds `out`: the sum of `amount` over the rows before this one within `keys` (never null).

    Rows are ordered by a hash of `spread` into n_chunks chunks, then by `order`. No task holds a whole key:
    the sum inside a chunk is a window over (keys, chunk), and a chunk's offset comes from one row for each
    key and chunk. df must give the same rows each time it is read (see cut).
    """
    held = df.withColumn("__chunk", F.pmod(F.xxhash64(spread, F.lit(7)), F.lit(n_chunks))).withColumn("__amount", amount)
    inside = Window.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = held.groupBy(*keys, "__chunk").agg(F.sum("__amount").alias("__sum"))
    offsets = sums.select(*keys, "__chunk", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__off"))
    inner = held.withColumn("__in", F.coalesce(F.sum("__amount").over(inside), F.lit(0)))
    joined = inner.join(offsets, [*keys, "__chunk"])
    return joined.withColumn(out, F.col("__in") + F.col("__off")).drop("__chunk", "__amount", "__in", "__off")
