"""Domain frames over the driver's tables: what stands for accounts, positions, ledger, snapshots, jobs and fills.

Money is DECIMAL(18,2) as stored; products stay decimal; ratios are taken in double by the operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.running import running_sums

#: How event types stand for ledger records, and for job outcomes.
LEDGER_TYPES = {"purchase": "REALIZED_PNL", "view": "FUNDING_FEE", "click": "TRADING_FEE", "signup": "DEPOSIT", "error": "WITHDRAWAL"}
JOB_STATES = {"error": "FAILED", "purchase": "SUCCESS", "signup": "RUNNING"}
TRACKING_START = "1996-01-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(18,2)")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account_id, exchange, connection_name, segment, is_active, tracking_started_at, initial_equity."""
    customer = read(spark, sf_dir, "customer")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    # Nations and regions are small by their nature, and Spark broadcasts them by their size on disk.
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(
        F.col("c_custkey").alias("account_id"),
        F.col("r_name").alias("exchange"),
        F.col("c_name").alias("connection_name"),
        F.col("c_mktsegment").alias("segment"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
        F.lit(TRACKING_START).cast("timestamp_ntz").alias("tracking_started_at"),
        money("c_acctbal").alias("initial_equity"),
    )


def in_order(accounts: DataFrame) -> DataFrame:
    """Active accounts (is_demo, created_at) as the pages list them: demo accounts first, then by when they were made,
    with `place` from 1. The place comes from counts of days, so no task holds all accounts."""
    held = accounts.filter("is_active").withColumn("__demo", F.when(F.col("is_demo"), 0).otherwise(1))
    placed = running_sums(held, [], F.col("__demo") * 1_000_000 + F.coalesce(F.datediff("created_at", F.lit("1970-01-01")), F.lit(-1)), ["__demo", "created_at", "account_id"], {"place": F.lit(1).cast("long")})
    return placed.drop("__demo")


def closed_positions(spark: SparkSession, sf_dir: str, active: DataFrame | None = None) -> DataFrame:
    """Line items with their order and part: one closed position each. With `active` (account_id, ...) only those of its
    accounts, and its other columns: orders meet accounts before lines meet orders, so lines move once for both."""
    line = read(spark, sf_dir, "lineitem")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    more = [] if active is None else [c for c in active.columns if c != "account_id"]
    if active is not None:
        orders = orders.join(active, F.col("o_custkey") == F.col("account_id")).drop("account_id")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    price, discount, tax = money("l_extendedprice"), F.col("l_discount").cast("decimal(4,2)"), F.col("l_tax").cast("decimal(4,2)")
    joined = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        F.col("o_custkey").alias("account_id"),
        F.col("p_brand").alias("symbol"),
        F.col("p_name").alias("title"),
        F.when(F.col("l_linestatus") == "O", "LONG").otherwise("SHORT").alias("side"),
        F.col("o_orderdate").alias("open_time"),
        F.col("l_shipdate").alias("close_time"),
        price.alias("value_usd"),
        (price * discount).alias("realized_pnl"),
        (price * tax).alias("trading_fee"),
        (price * discount - price * tax).alias("net_pnl"),
        (price * tax * F.lit("-0.25").cast("decimal(3,2)")).alias("funding_fee"),
        F.col("l_linenumber").alias("leverage"),
        F.col("l_quantity").cast("decimal(18,2)").alias("size"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        *more,
    )


def active_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed positions of active accounts, as trades.active_only gives them."""
    held = accounts(spark, sf_dir).filter("is_active").select("account_id", "exchange", "connection_name", "tracking_started_at")
    return closed_positions(spark, sf_dir, held)


def ledger_parts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The four record frames of the ledger: income, funding, fees and cash flows."""
    events = read(spark, sf_dir, "events").filter(F.col("event_type").isin(*LEDGER_TYPES))
    kind = F.create_map(*[F.lit(x) for pair in LEDGER_TYPES.items() for x in pair])[F.col("event_type")]
    base = events.select(
        F.col("event_id").alias("record_id"),
        F.col("user_id").alias("account_id"),
        F.col("ts").alias("record_time"),
        money("value").alias("amount_usd"),
        kind.alias("kind"),
    )
    income = base.filter("kind = 'REALIZED_PNL'").withColumnRenamed("kind", "income_type")
    funding = base.filter("kind = 'FUNDING_FEE'").drop("kind")
    fees = base.filter("kind = 'TRADING_FEE'").drop("kind")
    cash = base.filter("kind in ('DEPOSIT', 'WITHDRAWAL')").withColumnRenamed("kind", "flow_type")
    return {"income": income, "funding": funding, "fees": fees, "cash": cash}


def balance_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as equity samples: account_id, snapshot_id, asset, equity, recorded_at."""
    events = read(spark, sf_dir, "events")
    return events.select(
        F.col("user_id").alias("account_id"),
        F.col("event_id").alias("snapshot_id"),
        F.col("event_type").alias("asset"),
        money("value").alias("equity"),
        F.col("ts").alias("recorded_at"),
    )


def sync_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of three types as synchronisation runs: job_id, account_id, status, started_at, duration_ms."""
    events = read(spark, sf_dir, "events").filter(F.col("event_type").isin(*JOB_STATES))
    status = F.create_map(*[F.lit(x) for pair in JOB_STATES.items() for x in pair])[F.col("event_type")]
    return events.select(
        F.col("event_id").alias("job_id"),
        F.col("user_id").alias("account_id"),
        status.alias("status"),
        F.col("ts").alias("started_at"),
        (money("value") * 100).cast("decimal(20,0)").cast("long").alias("duration_ms"),
    )


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as buys and views as sells of 1 to 5 units."""
    events = read(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view"))
    return events.select(
        F.col("event_id").alias("fill_id"),
        (F.expr("event_id div 3")).alias("order_id"),
        F.col("user_id").alias("account_id"),
        F.concat(F.lit("S"), (F.col("user_id") % 10).cast("string")).alias("symbol"),
        F.when(F.col("event_type") == "click", "BUY").otherwise("SELL").alias("side"),
        (F.lit(1) + F.col("event_id") % 5).cast("decimal(18,0)").alias("quantity"),
        money("value").alias("price"),
        (money("value") * F.lit("0.001").cast("decimal(4,3)")).alias("fee"),
        F.col("ts").alias("time"),
    )
