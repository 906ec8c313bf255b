"""Files that hold accounts and equity: JSON configuration, zipped CSV, and a synthetic book for trying out."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ACCOUNTS = "accounts array<struct<exchange: string, connection_name: string, is_active: boolean>>"


def configured_accounts(spark: SparkSession, path: str) -> DataFrame:
    """Accounts of a configuration file, with their place in the list; a file without the list gives none."""
    raw = spark.read.schema(ACCOUNTS).json(path, multiLine=True)
    return raw.select(F.posexplode("accounts").alias("place", "account")).select("place", "account.*")


def zipped_rows(spark: SparkSession, path: str, member: str, columns: list[str]) -> DataFrame:
    """Rows of a CSV member of ZIP files: path, line, and the columns as text. One archive is read by one task."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    if member in archive.namelist():
                        found = pd.read_csv(archive.open(member), dtype=str).reindex(columns=columns)
                        yield pd.DataFrame({"path": name, "line": range(len(found))}).join(found.astype(object).where(found.notna(), None))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return files.mapInPandas(rows, "path string, line long, " + ", ".join(f"{c} string" for c in columns))


def demo_book(spark: SparkSession, n_accounts: int = 4, days: int = 30) -> DataFrame:
    """Daily equity of made-up accounts: account_id, snapshot_date, equity_usd; the same on every run."""
    grid = spark.range(n_accounts * days)
    account, day = F.expr(f"id div {days}"), (F.col("id") % days).cast("int")
    wave = F.sin(day / 3.0 + account) * 250 + F.cos(day / 5.0) * 120
    return grid.select(
        account.alias("account_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), day).alias("snapshot_date"),
        F.round(10_000 * (account + 1) + day * 40 + wave, 2).cast("decimal(18,2)").alias("equity_usd"),
    )
