"""State of the synchronisation runs, with "now" always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ratios import ratio
from .running import spaced

#: Fixed value: seconds after which an account is stale at least.
STALE_SECONDS = 120


def account_runs(jobs: DataFrame) -> DataFrame:
    """Per account: the latest run, the last success, and failures since that success (all, without one)."""
    ok = F.max(F.when(F.col("status") == "SUCCESS", F.col("started_at"))).alias("last_success_at")
    last = F.max_by(F.struct("status", "started_at", "job_id"), F.struct("started_at", "job_id")).alias("last")
    ends = jobs.groupBy("account_id").agg(last, ok)
    failed = jobs.filter("status = 'FAILED'").select("account_id", F.col("started_at").alias("failed_at"))
    since = failed.join(ends.select("account_id", "last_success_at"), "account_id").filter(F.col("last_success_at").isNull() | (F.col("failed_at") > F.col("last_success_at")))
    counts = since.groupBy("account_id").agg(F.count(F.lit(1)).alias("consecutive_failures"))
    joined = ends.join(counts, "account_id", "left")
    return joined.select(
        "account_id",
        F.col("last.status").alias("latest_status"),
        F.col("last.started_at").alias("latest_started_at"),
        "last_success_at",
        F.coalesce("consecutive_failures", F.lit(0)).alias("consecutive_failures"),
    )


def sync_status(accounts: DataFrame, jobs: DataFrame, now: Column, stale_after: int = STALE_SECONDS) -> DataFrame:
    """Every active account with its runs; stale without a success, or when that is too long ago."""
    joined = accounts.filter("is_active").select("account_id", "exchange", "connection_name").join(account_runs(jobs), "account_id", "left")
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("last_success_at").cast("timestamp"))
    out = joined.withColumn("consecutive_failures", F.coalesce("consecutive_failures", F.lit(0)))
    return out.withColumn("is_stale", F.coalesce(age > max(stale_after, STALE_SECONDS), F.lit(True)))


def sync_health(status: DataFrame) -> DataFrame:
    """Counts of accounts: all, healthy, stale, failing, running."""
    failing = F.col("consecutive_failures") > 0
    return status.agg(
        F.count(F.lit(1)).alias("total_accounts"),
        F.count_if(~F.col("is_stale") & ~failing).alias("healthy_accounts"),
        F.count_if("is_stale").alias("stale_accounts"),
        F.count_if(failing).alias("failing_accounts"),
        F.count_if(F.col("latest_status") == "RUNNING").alias("running_accounts"),
    )


def panel(jobs: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Runs of the last hours: counts, mean duration of successes, success rate, distinct failures by account and hour."""
    recent = jobs.filter(F.col("started_at") >= now - F.expr(f"INTERVAL {hours} HOURS"))
    ok, bad = F.col("status") == "SUCCESS", F.col("status") == "FAILED"
    kinds = F.when(bad, F.struct("account_id", "status", F.date_trunc("hour", "started_at").alias("hour")))
    totals = recent.agg(
        F.count(F.lit(1)).alias("jobs"),
        F.count_if(ok).alias("successful"),
        F.count_if(bad).alias("failed"),
        ratio(F.sum(F.when(ok, F.col("duration_ms"))), F.count_if(ok), 0.0).alias("average_ms"),
        F.countDistinct(kinds).alias("distinct_errors"),
        F.max("started_at").alias("latest_at"),
    )
    return totals.withColumn("success_rate", ratio(F.col("successful") * 100, F.col("jobs"), 0.0))


def thinned(jobs: DataFrame, keep_seconds: int = 60, job_type: str = "POSITIONS") -> DataFrame:
    """Successful runs; of those of `job_type` (all, if jobs have no such column) none that starts less than so many
    seconds after a kept one of its account. Runs of other types, and those whose type is null, all stay; runs of
    `job_type` without a start are left out."""
    typed = jobs if "job_type" in jobs.columns else jobs.withColumn("job_type", F.lit(job_type))
    done = typed.filter("status = 'SUCCESS'")
    kept = spaced(done.filter(F.col("job_type") == job_type), ["account_id"], "started_at", ["job_id"], keep_seconds * 1_000_000 - 1)
    return kept.unionByName(done.filter(~F.col("job_type").eqNullSafe(job_type))).select("account_id", "job_type", "started_at", "job_id")


def error_runs(errors: DataFrame, hours: int = 1) -> DataFrame:
    """Errors without those that repeat a kept one of the same account, type and message within so many hours."""
    keys = ["account_id", "error_type", "message"]
    return spaced(errors, keys, "occurred_at", keys, hours * 3_600_000_000).select(*keys, "occurred_at")
