"""Does the equity explain itself: reconciliation per account, and how complete each account's data are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ratios import zero

#: The least tolerance in USD, and the tolerance as a share of equity.
TOLERANCE, SHARE = 1.0, 0.001
MEASURES = (
    "initial_equity",
    "current_equity",
    "deposits",
    "withdrawals",
    "net_cash_flow",
    "equity_return",
    "realized_pnl",
    "funding_fee",
    "trading_fee",
    "net_realized_pnl",
    "component_return",
    "variance",
)
#: Components, the ledger types they are counted from, and what a venue without a ledger lacks.
LEDGER_COMPONENTS = {"realized_pnl": "REALIZED_PNL", "funding_fee": "FUNDING_FEE", "trading_fee": "TRADING_FEE", "cash_flow": "DEPOSIT"}
WITHOUT_LEDGER = "POLYMARKET"


def _amounts(records: DataFrame) -> DataFrame:
    kind, amount = F.col("record_type"), F.col("amount_usd")
    out = kind.isin("WITHDRAW", "WITHDRAWAL")
    is_cash = ~kind.isin("REALIZED_PNL", "FUNDING_FEE", "TRADING_FEE")
    # Whatever cash is not a withdrawal is a deposit.
    return records.groupBy("account_id").agg(
        F.sum(F.when(is_cash & ~out, amount)).alias("deposits"),
        F.sum(F.when(out, amount)).alias("withdrawals"),
        F.count_if(kind == "FUNDING_FEE").alias("fundings"),
        F.sum(F.when(kind == "FUNDING_FEE", amount)).alias("ledger_funding"),
        F.count_if(kind == "TRADING_FEE").alias("fees"),
        F.sum(F.when(kind == "TRADING_FEE", amount)).alias("ledger_fee"),
    )


def reconcile(accounts: DataFrame, latest: DataFrame, closed: DataFrame, ledger: DataFrame, unrealized: DataFrame | None = None) -> DataFrame:
    """Per active account: return by equity, return by components, their difference and MATCHED or REVIEW.

    Funding and fees are the ledger's if it has any such record, else those of closed positions. `unrealized`
    (account_id, initial_unrealized, current_unrealized) may be left out, which counts as 0.
    """
    funding = F.sum("funding_fee") if "funding_fee" in closed.columns else F.lit(None).cast("double")
    positions = closed.groupBy("account_id").agg(
        F.sum("realized_pnl").alias("realized"),
        F.sum("net_pnl").alias("net"),
        F.sum(F.abs("trading_fee")).alias("closed_fee"),
        funding.alias("closed_funding"),
    )
    out = accounts.filter("is_active").select("account_id", "exchange", "initial_equity")
    out = out.join(latest.select("account_id", F.col("equity").alias("current")), "account_id", "left")
    out = out.join(_amounts(ledger), "account_id", "left").join(positions, "account_id", "left")
    if unrealized is None:
        out = out.withColumn("initial_unrealized", F.lit(0.0)).withColumn("current_unrealized", F.lit(0.0))
    else:
        out = out.join(unrealized, "account_id", "left")
    out = out.select(
        "account_id",
        "exchange",
        zero(F.col("initial_equity")).alias("initial_equity"),
        zero(F.col("current")).alias("current_equity"),
        zero(F.col("deposits")).alias("deposits"),
        zero(F.col("withdrawals")).alias("withdrawals"),
        zero(F.col("realized")).alias("realized_pnl"),
        F.when(F.coalesce("fundings", F.lit(0)) > 0, zero(F.col("ledger_funding"))).otherwise(zero(F.col("closed_funding"))).alias("funding_fee"),
        F.when(F.coalesce("fees", F.lit(0)) > 0, zero(F.col("ledger_fee"))).otherwise(zero(F.col("closed_fee"))).alias("trading_fee"),
        zero(F.col("net")).alias("net_realized_pnl"),
        (zero(F.col("current_unrealized")) - zero(F.col("initial_unrealized"))).alias("unrealized_change"),
    )
    out = out.withColumn("net_cash_flow", F.col("deposits") - F.col("withdrawals"))
    out = out.withColumn("equity_return", F.col("current_equity") - F.col("initial_equity") - F.col("net_cash_flow"))
    out = out.withColumn("component_return", F.col("net_realized_pnl") + F.col("unrealized_change"))
    out = out.withColumn("variance", F.col("equity_return") - F.col("component_return"))
    out = out.withColumn("tolerance", F.greatest(F.lit(TOLERANCE), F.abs("current_equity") * SHARE))
    return out.withColumn("status", F.when(F.abs("variance") <= F.col("tolerance"), "MATCHED").otherwise("REVIEW")).drop("unrealized_change")


def totals(reconciled: DataFrame) -> DataFrame:
    """Sums over accounts, in decimal so they do not depend on order; MATCHED if all are (and without accounts)."""
    sums = [F.coalesce(F.sum(F.col(m).cast("decimal(28,4)")), F.lit(0)).cast("double").alias(m) for m in MEASURES]
    matched = F.coalesce(F.bool_and(F.col("status") == "MATCHED"), F.lit(True))
    return reconciled.agg(*sums, F.when(matched, "MATCHED").otherwise("REVIEW").alias("status"))


#: Components and the key of an account's details that states how complete each is.
DETAILS = {
    "equity": "equity",
    "positions": "positions",
    "balances": "balances",
    "closed_positions": "closed_positions",
    "realized_pnl": "income",
    "funding_fee": "funding",
    "trading_fee": "fees",
    "cash_flow": "cash_flows",
}


def _stats(rows: DataFrame, name: str, at: str) -> DataFrame:
    return rows.groupBy("account_id").agg(F.count(F.lit(1)).alias(f"{name}_n"), F.max(at).alias(f"{name}_at"))


def completeness(
    accounts: DataFrame,
    balances: DataFrame,
    assets: DataFrame,
    positions: DataFrame,
    closed: DataFrame,
    ledger: DataFrame,
    without_ledger: str = WITHOUT_LEDGER,
) -> DataFrame:
    """One row per active account and component: status, when it was last read, records, latest record.

    accounts also has connection_status, last_synced_at, full_synced_at and details, a map that states the status of
    components. What it does not state is PARTIAL, but for what an account that is connected and has been read shows
    by itself: its equity, its positions, and its asset balances if there are any. A venue without a ledger supports
    neither funding, fees nor cash flows, and its realized PnL is partial and counted by closed positions.
    """
    out = accounts.filter("is_active").select("account_id", "exchange", "connection_status", "last_synced_at", "full_synced_at", "details")
    for rows, name, at in (
        (balances, "equity", "recorded_at"),
        (assets, "balances", "recorded_at"),
        (positions, "positions", "updated_at"),
        (closed, "closed_positions", "close_time"),
    ):
        out = out.join(_stats(rows, name, at), "account_id", "left")
    of_kind = lambda name, kind: F.col("record_type").isin(kind, *(("WITHDRAWAL",) if name == "cash_flow" else ()))
    kinds = [x for name, kind in LEDGER_COMPONENTS.items() for x in (F.count_if(of_kind(name, kind)).alias(f"{name}_n"), F.max(F.when(of_kind(name, kind), F.col("record_time"))).alias(f"{name}_at"))]
    out = out.join(ledger.groupBy("account_id").agg(*kinds), "account_id", "left")
    primary = F.when((F.col("connection_status") == "CONNECTED") & F.col("last_synced_at").isNotNull(), "COMPLETE").otherwise("PARTIAL")
    has_ledger = F.col("exchange") != without_ledger
    count = lambda name: F.coalesce(f"{name}_n", F.lit(0))
    unless_stated = {"equity": primary, "positions": primary, "balances": F.when(count("balances") > 0, primary).otherwise("PARTIAL")}
    stated = lambda name: F.coalesce(F.try_element_at("details", F.lit(DETAILS[name])), unless_stated.get(name, F.lit("PARTIAL")))

    def entry(name: str, status: Column, read: Column, of: str) -> Column:
        return F.struct(
            F.lit(name).alias("component"),
            status.alias("status"),
            read.alias("last_synced_at"),
            count(of).alias("record_count"),
            F.col(f"{of}_at").alias("latest_record_at"),
        )

    never, none = F.lit(None).cast("timestamp_ntz"), F.lit(0).cast("long")
    unsupported = lambda name: F.struct(
        F.lit(name).alias("component"),
        F.lit("UNSUPPORTED").alias("status"),
        never.alias("last_synced_at"),
        none.alias("record_count"),
        never.alias("latest_record_at"),
    )
    own = [entry(name, stated(name), F.col("last_synced_at"), name) for name in ("equity", "positions", "balances", "closed_positions")]
    with_ledger = [entry(name, stated(name), F.col("full_synced_at"), name) for name in LEDGER_COMPONENTS]
    without = [
        entry("realized_pnl", F.lit("PARTIAL"), F.col("last_synced_at"), "closed_positions"),
        *[unsupported(name) for name in LEDGER_COMPONENTS if name != "realized_pnl"],
    ]
    parts = F.concat(F.array(*own), F.when(has_ledger, F.array(*with_ledger)).otherwise(F.array(*without)))
    return out.select("account_id", "exchange", F.explode(parts).alias("x")).select("account_id", "exchange", "x.*")


def status_counts(components: DataFrame) -> DataFrame:
    return components.groupBy("status").agg(F.count(F.lit(1)).alias("components"))


def sticky(previous: Column, incoming: Column, authoritative: Column) -> Column:
    """PARTIAL stays PARTIAL unless an authoritative source says otherwise."""
    return F.when((previous == "PARTIAL") & (incoming == "COMPLETE") & ~F.coalesce(authoritative, F.lit(False)), "PARTIAL").otherwise(incoming)


def sticky_fold(updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The status of each key after all its updates (status, authoritative) in order, each taken by `sticky`.

    Every update sets the status whatever it was, but for a COMPLETE that is not authoritative: that one is passed
    over after a PARTIAL. So the last update of the others decides, and whether it is the last of all.
    """
    sets = ~((F.col("status") == "COMPLETE") & ~F.coalesce("authoritative", F.lit(False)))
    place = F.struct(*order)
    ends = updates.groupBy(*keys).agg(F.max_by("status", place).alias("last"), F.max_by(F.when(sets, F.col("status")), F.when(sets, place)).alias("set"))
    return ends.select(*keys, F.when(F.col("set") == "PARTIAL", "PARTIAL").otherwise(F.col("last")).alias("status"))
