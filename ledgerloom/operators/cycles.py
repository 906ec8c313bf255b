"""Trade cycles from fills: from flat to flat, with flips closing one cycle and opening the next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ratios import ratio
from .running import running_least, running_sums

KEYS = ["account_id", "symbol"]
#: Assets in which a fee is taken as dollars.
FEE_DOLLARS = ("USD", "USDT", "USDC", "FDUSD")


def merged_orders(fills: DataFrame) -> DataFrame:
    """Fills of one order, position side and fee asset as one: sums, volume-weighted price, time and id of the last.

    A fill without an order id is an order of its own; one of no quantity is passed over. Fills may lack
    position_side (BOTH), fee_asset (USDT) and realized_pnl (0).
    """
    given = lambda name, other: F.col(name) if name in fills.columns else F.lit(None).cast(other)
    groups = ["account_id", "symbol", "position_side", "side", "order_key", "fee_asset"]
    order = F.when(
        F.col("order_id").isNull() | (F.col("order_id").cast("string") == ""),
        F.concat(F.lit("trade:"), F.col("fill_id").cast("string")),
    ).otherwise(F.col("order_id").cast("string"))
    keyed = fills.filter("quantity != 0").select(
        "account_id",
        "symbol",
        F.upper(F.coalesce(given("position_side", "string"), F.lit("BOTH"))).alias("position_side"),
        "side",
        order.alias("order_key"),
        F.upper(F.coalesce(given("fee_asset", "string"), F.lit("USDT"))).alias("fee_asset"),
        F.abs("quantity").alias("quantity"),
        "price",
        "fee",
        F.coalesce(given("realized_pnl", "decimal(18,2)"), F.lit(0)).alias("realized_pnl"),
        "time",
        "fill_id",
        "order_id",
    )
    merged = keyed.groupBy(*groups).agg(
        F.sum("quantity").alias("quantity"),
        F.sum("fee").alias("fee"),
        F.sum("realized_pnl").alias("realized_pnl"),
        F.sum(F.col("price") * F.col("quantity")).alias("notional"),
        F.max(F.struct("time", "fill_id", "order_id")).alias("last"),
        F.count(F.lit(1)).alias("fills"),
    )
    return merged.select(
        *groups,
        "quantity",
        "fee",
        "realized_pnl",
        ratio(F.col("notional"), F.col("quantity")).alias("average_price"),
        F.col("last.time").alias("time"),
        F.col("last.fill_id").alias("last_fill_id"),
        F.col("last.order_id").alias("order_id"),
        "fills",
    )


def legs(fills: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """Each fill as the part that closes and the part that opens, with the number of its cycle, and the columns `more`.

    The position before a fill is a running sum; a fill against it closes up to its size and opens with what is
    left. A cycle ends where the position is flat or changes sign, so its number is a running count of ends.
    """
    signed = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    day = F.to_date("time")
    placed = running_sums(fills, KEYS, day, ["time", "fill_id"], {"after": signed}).withColumn("before", F.col("after") - signed)
    against = F.col("before") * signed < 0
    placed = placed.withColumn("close_quantity", F.when(against, F.least(F.abs("before"), F.col("quantity"))).otherwise(F.lit(0)).cast("decimal(18,0)"))
    ends = against & ((F.col("after") == 0) | (F.col("before") * F.col("after") < 0))
    placed = placed.withColumn("ends", ends.cast("int"))
    counted = running_sums(placed, KEYS, day, ["time", "fill_id"], {"ended": F.col("ends")})
    whole = F.col("quantity")
    close = F.struct(F.lit("close").alias("leg"), (F.col("ended") - F.col("ends")).alias("cycle"), F.col("close_quantity").alias("leg_quantity"))
    open_ = F.struct(F.lit("open").alias("leg"), F.col("ended").alias("cycle"), (whole - F.col("close_quantity")).cast("decimal(18,0)").alias("leg_quantity"))
    exploded = counted.withColumn("x", F.explode(F.array(close, open_))).filter("x.leg_quantity > 0")
    return exploded.select(*KEYS, "fill_id", "time", "side", "price", "fee", "quantity", "before", "after", "ends", *more, "x.*")


def closed_cycles(fills: DataFrame) -> DataFrame:
    """Finished cycles: side, times, entry and exit price, largest size, realized PnL, fees pro rata, net."""
    notional = F.col("price") * F.col("leg_quantity")
    opening, closing = F.col("leg") == "open", F.col("leg") == "close"
    size = F.when(opening, F.abs("after")).otherwise(F.abs("before"))
    # A cycle is closed by the closing leg of a fill that ends it.
    last = closing & (F.col("ends") == 1)
    grouped = legs(fills).groupBy(*KEYS, "cycle").agg(
        F.min_by(F.when(F.col("side") == "BUY", "LONG").otherwise("SHORT"), F.struct("time", "fill_id")).alias("side"),
        F.min(F.when(opening, F.col("time"))).alias("open_time"),
        F.max(F.when(last, F.col("time"))).alias("close_time"),
        F.max(F.when(last, F.col("fill_id"))).alias("closing_fill_id"),
        F.sum(F.when(opening, F.col("leg_quantity"))).alias("open_quantity"),
        F.sum(F.when(opening, notional)).alias("open_notional"),
        F.sum(F.when(closing, F.col("leg_quantity"))).alias("close_quantity"),
        F.sum(F.when(closing, notional)).alias("close_notional"),
        F.max(size).alias("max_size"),
        F.sum((F.col("fee").cast("double") * F.col("leg_quantity").cast("double") / F.col("quantity").cast("double")).cast("decimal(24,8)")).alias("fee"),
    )
    done = grouped.filter("close_time is not null")
    direction = F.when(F.col("side") == "LONG", 1).otherwise(-1)
    realized = ((F.col("close_notional") - F.col("open_notional")) * direction).cast("double")
    fee = F.col("fee").cast("double")
    entry, exit_ = ratio(F.col("open_notional"), F.col("open_quantity")), ratio(F.col("close_notional"), F.col("close_quantity"))
    return done.select(
        *KEYS,
        "cycle",
        "side",
        "open_time",
        "close_time",
        "closing_fill_id",
        entry.alias("entry_price"),
        exit_.alias("exit_price"),
        F.col("max_size").cast("double").alias("max_size"),
        realized.alias("realized_pnl"),
        fee.alias("trading_fee"),
        (realized - fee).alias("net_pnl"),
        (ratio(realized, entry * F.col("max_size").cast("double"), 0.0) * 100).alias("return_percent"),
    )


def stated_cycles(fills: DataFrame) -> DataFrame:
    """Finished cycles as closed positions, from fills that state their PnL (realized_pnl) and their fee's asset
    (fee_asset): the PnL is what the closing fills state, fees count where they are paid in dollars.

    A cycle that paid a fee in another asset is incomplete. Its entry price is inferred from its closing fills, of
    which each tells by its PnL at what price what it closes was opened; others have the mean price of the fills that
    opened them. Either way the record is a reconstruction, so PARTIAL.
    """
    share = F.col("leg_quantity").cast("double") / F.col("quantity").cast("double")
    opening, closing = F.col("leg") == "open", F.col("leg") == "close"
    notional, size = F.col("price") * F.col("leg_quantity"), F.when(opening, F.abs("after")).otherwise(F.abs("before"))
    dollars = F.upper(F.coalesce("fee_asset", F.lit("USDT"))).isin(*FEE_DOLLARS)
    last = closing & (F.col("ends") == 1)
    total = lambda test, value: F.sum(F.when(test, value))
    grouped = legs(fills, ["realized_pnl", "fee_asset"]).groupBy(*KEYS, "cycle").agg(
        F.min_by(F.when(F.col("side") == "BUY", "LONG").otherwise("SHORT"), F.struct("time", "fill_id")).alias("side"),
        F.min(F.when(opening, F.col("time"))).alias("open_time"),
        F.max(F.when(last, F.col("time"))).alias("close_time"),
        F.max(F.when(last, F.col("fill_id"))).alias("closing_fill_id"),
        total(opening, F.col("leg_quantity")).alias("open_quantity"),
        total(opening, notional).alias("open_notional"),
        total(closing, F.col("leg_quantity")).alias("close_quantity"),
        total(closing, notional).alias("close_notional"),
        F.max(size).cast("double").alias("max_size"),
        F.coalesce(total(closing, F.col("realized_pnl")), F.lit(0)).cast("double").alias("realized_pnl"),
        F.coalesce(total(dollars, (F.col("fee").cast("double") * share).cast("decimal(24,8)")), F.lit(0)).cast("double").alias("trading_fee"),
        F.bool_and(dollars | (F.coalesce(F.col("fee"), F.lit(0)) == 0)).alias("complete"),
    )
    direction = F.when(F.col("side") == "LONG", 1).otherwise(-1)
    inferred = ratio(F.col("close_notional").cast("double") - direction * F.col("realized_pnl"), F.col("close_quantity").cast("double"), 0.0)
    entry = F.when(F.col("complete") & (F.col("open_quantity") > 0), ratio(F.col("open_notional"), F.col("open_quantity"))).otherwise(inferred)
    held = grouped.filter("close_time is not null").withColumn("entry_price", entry)
    return held.select(
        *KEYS,
        F.concat_ws(":", F.lit("binance"), "symbol", "side", F.col("closing_fill_id").cast("string")).alias("source_record_id"),
        "side",
        "open_time",
        "close_time",
        "entry_price",
        ratio(F.col("close_notional"), F.col("close_quantity"), 0.0).alias("exit_price"),
        "max_size",
        "realized_pnl",
        "trading_fee",
        (F.col("realized_pnl") - F.col("trading_fee")).alias("net_pnl"),
        (ratio(F.col("realized_pnl"), F.col("entry_price") * F.col("max_size"), 0.0) * 100).alias("return_percent"),
        "complete",
        F.lit("PARTIAL").alias("data_completeness"),
    )


def with_funding(cycles: DataFrame, funding: DataFrame, keys: list[str]) -> DataFrame:
    """Cycles with the funding paid within them (bounds included), 0 without any, and net of it.

    The join is on the keys and on days of the cycle, so an event meets the cycles of its day only.
    """
    spread = cycles.withColumn("day", F.explode(F.sequence(F.to_date("open_time"), F.to_date("close_time"))))
    paid = funding.select(*keys, F.col("record_time").alias("paid_at"), F.col("amount_usd").alias("paid"), F.to_date("record_time").alias("day"))
    # Two cycles of a key can meet in one moment, so cycles are told apart by number and closing fill.
    own = [*dict.fromkeys([*KEYS, *keys, "cycle"])]
    within = spread.select(*own, "day", "open_time", "close_time").join(paid, [*keys, "day"]).filter("paid_at between open_time and close_time")
    sums = within.groupBy(*own).agg(F.sum("paid").cast("double").alias("funding"))
    joined = cycles.join(sums, own, "left").withColumn("funding_fee", F.coalesce("funding", F.lit(0.0))).drop("funding")
    return joined.withColumn("net_pnl", F.col("realized_pnl") + F.col("funding_fee") - F.col("trading_fee"))


def hedge_cycles(fills: DataFrame) -> DataFrame:
    """Cycles of accounts that hold both sides at once: (account, symbol, position_side) by itself.

    A close takes at most what is open, so the open size is a running sum that stops at 0: the sum itself less its
    least value so far, if that is below 0. A close of nothing is a cycle of its own, closed at once and partial.
    """
    keys, order, day = [*KEYS, "position_side"], ["time", "fill_id"], F.to_date("time")
    quantity = F.col("quantity").cast("decimal(18,8)")
    opens = (F.col("position_side") == "LONG") == (F.col("side") == "BUY")
    rows = fills.select(*keys, "time", "fill_id", quantity.alias("quantity"), F.col("price").cast("decimal(18,8)").alias("price"), opens.alias("opens"))
    signed = F.when(F.col("opens"), F.col("quantity")).otherwise(-F.col("quantity"))
    rows = running_sums(rows, keys, day, order, {"total": signed})
    rows = running_least(rows, keys, day, order, {"least": F.col("total"), "least_before": F.col("total") - signed})
    # The least value before a row is that of the sums before it; both count from 0.
    size = lambda total, least: total - F.least(least, F.lit(0).cast("decimal(28,8)"))
    rows = rows.withColumn("after", size(F.col("total"), F.col("least"))).withColumn("before", size(F.col("total") - signed, F.col("least_before")))
    orphan = ~F.col("opens") & (F.col("before") == 0)
    ends = ~F.col("opens") & (F.col("before") > 0) & (F.col("after") == 0)
    rows = rows.withColumn("orphan", F.when(orphan, F.col("fill_id"))).withColumn("ends", ends.cast("int"))
    rows = running_sums(rows, keys, day, order, {"ended": F.col("ends")}).withColumn("cycle", F.col("ended") - F.col("ends"))
    taken = F.when(F.col("orphan").isNotNull(), F.col("quantity")).when(~F.col("opens"), F.col("before") - F.col("after"))
    added = F.when(F.col("opens"), F.col("quantity"))
    exact = lambda c: F.coalesce(F.sum(c.cast("decimal(38,12)")), F.lit(0)).cast("double")
    grouped = rows.groupBy(*keys, "cycle", "orphan").agg(
        F.min("time").alias("open_time"),
        F.max("time").alias("close_time"),
        F.max(F.greatest("before", "after")).alias("largest"),
        F.max("quantity").alias("quantity"),
        exact(added).alias("open_quantity"),
        exact(added * F.col("price")).alias("open_notional"),
        exact(taken).alias("close_quantity"),
        exact(taken * F.col("price")).alias("close_notional"),
        F.max("ends").alias("ends"),
    )
    done = grouped.filter("orphan is not null or ends = 1").withColumn("complete", F.col("orphan").isNull())
    done = done.withColumn("max_size", F.when(F.col("complete"), F.col("largest")).otherwise(F.col("quantity")).cast("double"))
    direction = F.when(F.col("position_side") == "LONG", 1.0).otherwise(-1.0)
    entry, exit_ = ratio(F.col("open_notional"), F.col("open_quantity")), ratio(F.col("close_notional"), F.col("close_quantity"))
    realized = F.when(F.col("complete"), (exit_ - entry) * F.col("close_quantity") * direction)
    completeness = F.when(F.col("complete"), "COMPLETE").otherwise("PARTIAL")
    return done.select(
        *keys,
        "open_time",
        "close_time",
        "max_size",
        entry.alias("entry_price"),
        exit_.alias("exit_price"),
        realized.alias("realized_pnl"),
        completeness.alias("data_completeness"),
    )


def cycles_from_start_positions(fills: DataFrame) -> DataFrame:
    """Cycles where the venue states the position before each fill (start_position), by account and symbol.

    No running sum is needed: what a fill closes and opens follows from its own row, and cycles are numbered by
    the ends before. A cycle whose first fill found a position is partial and its entry inferred from the PnL the
    venue reports (closed_pnl); fees go pro rata to what a fill closes and opens.
    """
    start, size = F.col("start_position"), F.col("quantity")
    delta = F.when(F.col("side") == "BUY", size).otherwise(-size)
    rows = fills.withColumn("end_position", start + delta)
    against = start * delta < 0
    rows = rows.withColumn("closes", F.when(against, F.least(F.abs(start), size)).otherwise(F.lit(0).cast("decimal(18,0)")))
    ends = against & ((F.col("end_position") == 0) | (F.col("end_position") * start < 0))
    rows = rows.withColumn("ends", ends.cast("int"))
    rows = running_sums(rows, KEYS, F.to_date("time"), ["time", "fill_id"], {"ended": F.col("ends")})
    close = F.struct(F.lit("close").alias("leg"), (F.col("ended") - F.col("ends")).alias("cycle"), F.col("closes").alias("q"))
    open_ = F.struct(F.lit("open").alias("leg"), F.col("ended").alias("cycle"), (size - F.col("closes")).cast("decimal(18,0)").alias("q"))
    legs_ = rows.withColumn("x", F.explode(F.array(close, open_))).filter("x.q > 0").select("*", "x.*").drop("x")
    opening, closing = F.col("leg") == "open", F.col("leg") == "close"
    price, q = F.col("price"), F.col("q")
    long = F.when(opening, F.col("end_position") > 0).otherwise(start > 0)
    inferred = price * q - F.when(long, F.col("closed_pnl")).otherwise(-F.col("closed_pnl"))
    first = F.struct("time", "fill_id")
    grouped = legs_.groupBy(*KEYS, "cycle").agg(
        F.min_by(F.when(long, "LONG").otherwise("SHORT"), first).alias("side"),
        F.min_by(F.when(opening, start == 0).otherwise(F.lit(False)) | (opening & (F.col("closes") > 0)), first).alias("complete"),
        F.min(F.when(opening, F.col("time"))).alias("open_time"),
        F.max(F.when(closing & (F.col("ends") == 1), F.col("time"))).alias("close_time"),
        F.sum(F.when(opening, q)).alias("oq"),
        F.sum(F.when(opening, price * q)).alias("o_n"),
        F.sum(F.when(closing, q)).alias("cq"),
        F.sum(F.when(closing, price * q)).alias("c_n"),
        F.sum(F.when(closing, inferred)).alias("i_n"),
        F.sum(F.when(closing, F.col("closed_pnl"))).alias("pnl"),
        F.max(F.greatest(F.when(closing, F.abs(start)), F.when(opening, F.abs("end_position")))).alias("max_size"),
        F.sum((F.col("fee").cast("double") * q.cast("double") / size.cast("double")).cast("decimal(24,8)")).alias("fee"),
    )
    done = grouped.filter("close_time is not null")
    entry = F.when(F.col("complete"), ratio(F.col("o_n"), F.col("oq"))).otherwise(ratio(F.col("i_n"), F.col("cq")))
    realized, fee = F.col("pnl").cast("double"), F.col("fee").cast("double")
    return done.select(
        *KEYS,
        "cycle",
        "side",
        "open_time",
        "close_time",
        entry.alias("entry_price"),
        ratio(F.col("c_n"), F.col("cq")).alias("exit_price"),
        F.col("max_size").cast("double").alias("max_size"),
        realized.alias("realized_pnl"),
        fee.alias("trading_fee"),
        (realized - fee).alias("net_pnl"),
        F.when(F.col("complete"), "COMPLETE").otherwise("PARTIAL").alias("data_completeness"),
    )
