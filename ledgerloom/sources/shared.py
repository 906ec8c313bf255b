"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_TAKEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """As the cluster names it in spark.checkpoint.dir. Only a session on one machine may lack one; it gets a folder
    of its own, where elsewhere each executor would write to a disk that no other reads."""
    got = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A place of its own in the shared folder for what this session needs in between; it is deleted when the session's
    process ends."""
    app = spark.sparkContext.applicationId
    if app not in _TAKEN:
        _TAKEN[app] = []
        atexit.register(drop_taken, app)
    _TAKEN[app].append(f"{shared_dir(spark)}/ledgerloom-{label}-{uuid.uuid4().hex}")
    return _TAKEN[app][-1]


def drop_taken(app: str) -> None:
    """Deletes what fresh_path has given an application, while its JVM still answers."""
    try:
        spark = SparkSession.getActiveSession()
        if spark is None or spark.sparkContext.applicationId != app:
            return
        for path in _TAKEN.pop(app, []):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session is gone, and with it the way to the store
        return


def staged(df: DataFrame, path: str) -> DataFrame:
    """df written to a path of its own and read back, so that it may replace what it was read from."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at an address, in whatever store it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
