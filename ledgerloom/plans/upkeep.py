"""Queries of tables kept up to date: commits and what they answer, streams of pages, continuous aggregates, folds."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import reporting_day
from ..operators import balances, equity
from ..sources import views
from ..sources.commits import Commit, VersionedTable
from ..sources.shared import fresh_path, staged
from ..streaming.folds import Reductions, Spaced, Sticky, flush, keyed, replayed
from ..streaming.records import keep_records, written_upstream
from ..streaming.rollups import LEVELS, POINT, Rollups
from .queries import QUERIES, query

#: Fixed value: the moment that parts what a first commit is given from what a second one is.
PARTED = datetime(2024, 1, 16)
DAY_MS = 86_400_000


def _early(column: str):
    return F.col(column) < F.lit(PARTED).cast("timestamp_ntz")


def _answers(spark: SparkSession, table: VersionedTable, commits: list[Commit], measure: str) -> DataFrame:
    """A row for each commit: what it answered, and the table's rows and sum after it."""
    out = None
    for step, c in enumerate(commits, 1):
        after = table.read(c.version).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(measure), F.lit(0)).cast("double").alias("total"))
        row = after.select(F.lit(step).alias("step"), *[F.lit(getattr(c, name)).cast("long").alias(name) for name in ("inserted", "updated", "unchanged", "deleted")], "rows", "total")
        out = row if out is None else out.unionByName(row)
    return out


@query
def first_of_day_commits(spark: SparkSession, d: str) -> DataFrame:
    """The first snapshot of each account and day stays, and each commit says how many it inserted: the first half of
    the month, then the whole of it."""
    table = VersionedTable(spark, fresh_path(spark, "first-of-day"), "account_id bigint, day date, equity decimal(18,2), recorded_at timestamp_ntz, snapshot_id bigint", ["account_id", "day"], "day")
    rows = views.balance_snapshots(spark, d).withColumn("day", reporting_day(F.col("recorded_at")))
    commits = [table.insert_new(part, ["recorded_at", "snapshot_id"]) for part in (rows.filter(_early("recorded_at")), rows)]
    return _answers(spark, table, commits, "equity")


@query
def asset_replacements(spark: SparkSession, d: str) -> DataFrame:
    """The latest assets of each account in place of those before, assets that are gone deleted: those of the first half
    of the month, then those of the second."""
    table = VersionedTable(spark, fresh_path(spark, "assets"), "account_id bigint, asset string, equity decimal(18,2)", ["account_id", "asset"], "asset")
    rows = views.balance_snapshots(spark, d)
    half = lambda part: balances.latest(part, ["account_id", "asset"], ["recorded_at", "snapshot_id"])
    commits = [table.replace(half(part), ["equity"]) for part in (rows.filter(_early("recorded_at")), rows.filter(~_early("recorded_at")))]
    return _answers(spark, table, commits, "equity")


@query
def position_day_commits(spark: SparkSession, d: str) -> DataFrame:
    """The last position of each account, symbol, side and day: those of the first lines of orders, then all."""
    # By months: some years of days would be thousands of folders.
    keys = ["account_id", "symbol", "side", "day", "month"]
    table = VersionedTable(spark, fresh_path(spark, "positions"), "account_id bigint, symbol string, side string, day date, month date, value_usd decimal(18,2), line bigint, order_id bigint", keys, "month")
    rows = views.closed_positions(spark, d).select("account_id", "symbol", "side", F.to_date("close_time").alias("day"), F.to_date(F.date_trunc("month", "close_time")).alias("month"), "value_usd", F.col("l_linenumber").cast("long").alias("line"), F.col("l_orderkey").alias("order_id"))
    commits = [table.upsert(part, ["line", "order_id", "value_usd"], latest=True) for part in (rows.filter("line <= 2"), rows)]
    return _answers(spark, table, commits, "value_usd")


@query
def backfill_commits(spark: SparkSession, d: str) -> DataFrame:
    """Points filled from the past, written from the first half of the month, then from all, then once more."""
    table = VersionedTable(spark, fresh_path(spark, "backfill"), "bucket_time timestamp_ntz, day date, total_equity decimal(28,2), account_count bigint, stale_account_count bigint", ["bucket_time", "day"], "day")
    rows, accounts = views.balance_snapshots(spark, d), views.accounts(spark, d).withColumn("is_active", F.lit(True))
    filled = lambda part: equity.coverage(part, accounts).withColumn("day", F.to_date("bucket_time"))
    commits = [table.upsert(filled(part), ["account_count"]) for part in (rows.filter(_early("recorded_at")), rows, rows)]
    return _answers(spark, table, commits, "total_equity")


@query
def latest_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """The table of latest balances is filled when it is first asked for, and not again."""
    table = VersionedTable(spark, fresh_path(spark, "latest"), "account_id bigint, asset string, equity decimal(18,2), recorded_at timestamp_ntz", ["account_id", "asset"], "asset")
    rows = views.balance_snapshots(spark, d)
    done = [table.bootstrap(lambda part=part: balances.latest(part, ["account_id", "asset"], ["recorded_at", "snapshot_id"]), ["recorded_at"]) for part in (rows, rows.limit(0))]
    return _answers(spark, table, [done[0], Commit(table.version()) if done[1] is None else done[1]], "equity")


@query
def paged_stream_records(spark: SparkSession, d: str) -> DataFrame:
    """Ledger records written as pages of an upstream and read by a stream that is started three times, at three
    moments: the table then has each record once."""
    kinds = F.create_map(*[F.lit(x) for pair in views.LEDGER_TYPES.items() for x in pair])
    records = views.read(spark, d, "events").select(kinds[F.col("event_type")].alias("stream"), F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("user_id").alias("account_id"), F.col("value").cast("decimal(18,2)").cast("string").alias("amount"))
    path = written_upstream(records.filter("stream is not null"), fresh_path(spark, "upstream"), page=20_000)
    ends = records.agg(F.min("at").alias("lo"), F.max("at").alias("hi")).first()
    table = VersionedTable(spark, fresh_path(spark, "records"), "stream string, id bigint, at bigint, account_id bigint, amount string, day date", ["stream", "id", "day"], "day")
    if ends["lo"] is not None:
        every = {name: 300 * (1 + n) for n, name in enumerate(sorted(set(views.LEDGER_TYPES.values())))}
        checkpoint = fresh_path(spark, "records-checkpoint")
        for now in (ends["lo"] + 2 * DAY_MS, (ends["lo"] + ends["hi"]) // 2, ends["hi"] + 2 * 1000 * max(every.values())):
            keep_records(spark, table, checkpoint, "stream string, id bigint, at bigint, account_id bigint, amount string", ["at"], every, fetch="ledgerloom.streaming.records:folder_pages", upstream=path, start=ends["lo"], now=now, time="at")
    return table.read().select("stream", "id", "account_id", F.col("amount").cast("decimal(18,2)").cast("double").alias("amount"), F.timestamp_millis("at").cast("timestamp_ntz").alias("record_time"))


@query
def equity_rollups(spark: SparkSession, d: str) -> DataFrame:
    """All levels of the equity curve, kept by a stream of points that come in two lots, neither in order."""
    source = fresh_path(spark, "points")
    points = equity.points(views.balance_snapshots(spark, d))
    points = points.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in POINT.split(", ")])
    lot = F.pmod(F.xxhash64("bucket_time"), F.lit(2))
    rollups = Rollups(spark, fresh_path(spark, "rollups"))
    for n in (0, 1):
        points.filter(lot == n).write.mode("append").parquet(source)
        rollups.refresh(source)
    out = [rollups.read(m).select(F.lit(m).alias("minutes"), "bucket_time", F.col("total_equity").cast("double").alias("total_equity"), "account_count", "source_latest_at") for m in LEVELS]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def _folded(spark: SparkSession, rows: DataFrame, fold) -> DataFrame:
    """rows through the stream, in files by a hash of their moments, so out of order; all within the lag."""
    path, rows = fresh_path(spark, "fold-rows"), staged(rows, fresh_path(spark, "fold-given"))
    for n in (0, 1):
        rows.filter(F.pmod(F.xxhash64("at_us", "tie"), F.lit(2)) == n).write.mode("append").parquet(path)
    flush(spark).write.mode("append").parquet(path)
    return replayed(spark, path, fold, "60 days")


@query
def error_dedup_stream(spark: SparkSession, d: str) -> DataFrame:
    """As error_dedup, by a stream."""
    jobs = views.sync_jobs(spark, d).filter("status = 'FAILED'")
    got = _folded(spark, keyed(jobs, ["account_id"], "started_at", ["job_id"], F.lit("")), Spaced(24 * 3_600_000_000))
    return got.select(F.get_json_object("key", "$.account_id").cast("long").alias("account_id"), F.timestamp_micros("at_us").cast("timestamp_ntz").alias("occurred_at"))


@query
def status_sticky_stream(spark: SparkSession, d: str) -> DataFrame:
    """As status_sticky, by a stream: the last change of each account's status."""
    jobs = views.sync_jobs(spark, d)
    status = F.when(F.col("status") == "FAILED", "PARTIAL").otherwise("COMPLETE")
    rows = keyed(jobs, ["account_id"], "started_at", ["job_id"], F.concat_ws("|", status, (F.col("job_id") % 7 == 0).cast("string")))
    last = _folded(spark, rows, Sticky()).groupBy("key").agg(F.max_by("value", "at_us").alias("status"))
    return last.select(F.get_json_object("key", "$.account_id").cast("long").alias("account_id"), "status")


@query
def position_reductions_stream(spark: SparkSession, d: str) -> DataFrame:
    """As position_reductions, by a stream of two snapshots of each account."""
    rows = views.closed_positions(spark, d).select("account_id", "symbol", "side", F.abs("size").alias("size"), F.when(F.col("l_linenumber") <= 3, 0).otherwise(1).alias("turn"))
    sizes = rows.groupBy("account_id", "symbol", "side", "turn").agg(F.sum("size").cast("string").alias("size"))
    held = F.struct(F.to_json(F.struct("symbol", "side")).alias("position"), "size")
    # A snapshot is one row of the stream, with one size for each position as the state has; it may hold nothing.
    turns = [F.collect_list(F.when((F.col("turn") == n) & F.col("size").isNotNull(), held)).alias(f"turn{n}") for n in (0, 1)]
    both = sizes.groupBy("account_id").agg(*turns).select("account_id", F.posexplode(F.array("turn0", "turn1")).alias("turn", "held"))
    both = both.withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + 60 * F.col("turn")))
    got = _folded(spark, keyed(both, ["account_id"], "at", [], F.to_json("held")), Reductions())
    fields = got.select(F.get_json_object("key", "$.account_id").cast("long").alias("account_id"), F.from_json("value", "position string, before string, after string").alias("x"))
    held = fields.select("account_id", F.from_json("x.position", "symbol string, side string").alias("p"), "x.before", "x.after")
    return held.select("account_id", "p.symbol", "p.side", F.col("before").cast("double").alias("before"), F.col("after").cast("double").alias("after"))


#: Queries of which a stream or a Python data source is a part.
STREAMED: dict[str, Callable] = {name: QUERIES[name] for name in ("paged_stream_records", "equity_rollups", "error_dedup_stream", "status_sticky_stream", "position_reductions_stream")}
