"""Names and ids as pure string expressions: symbols, sides, margin modes, canonical ids, CSV cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Quote currencies looked for at the end of a joined symbol, in this order.
QUOTES = ("USDT", "USDC", "USD", "BUSD")
DEFAULT_QUOTE = "USDT"
#: Spellings of the two sides and of the margin modes.
LONGS, SHORTS = ("long", "buy"), ("short", "sell")
CROSSED, ISOLATED = ("cross", "crossed", "cross_margin"), ("isolated", "fixed")


def normalize_symbol(symbol: Column, quote_hint: Column | None = None) -> Column:
    """BASE-QUOTE-PERP from the spellings of several venues; without a quote in the symbol the hint, else USDT."""
    clean = F.split(F.replace(F.upper(F.trim(symbol)), F.lit("-SWAP"), F.lit("")), ":")[0]
    parts = F.filter(F.split(clean, r"[-/_]"), lambda p: p != "")
    found = F.coalesce(*[F.when(clean.endswith(q), F.lit(q)) for q in QUOTES], F.lit(DEFAULT_QUOTE))
    quote = found if quote_hint is None else F.coalesce(F.nullif(F.upper(quote_hint), F.lit("")), found)
    base = F.when(clean.endswith(quote) & (clean != quote), F.left(clean, F.length(clean) - F.length(quote))).otherwise(clean)
    pair = F.size(parts) >= 2
    return F.concat_ws("-", F.when(pair, F.get(parts, F.lit(0))).otherwise(base), F.when(pair, F.get(parts, F.lit(1))).otherwise(quote), F.lit("PERP"))


def normalize_side(side: Column, amount: Column | None = None) -> Column:
    """LONG or SHORT; what is neither goes by the sign of the amount, LONG if there is none."""
    lower = F.lower(side)
    negative = F.lit(False) if amount is None else F.coalesce(amount < 0, F.lit(False))
    return F.when(lower.isin(*LONGS), "LONG").when(lower.isin(*SHORTS), "SHORT").when(negative, "SHORT").otherwise("LONG")


def normalize_margin_mode(mode: Column) -> Column:
    lower = F.lower(mode)
    return F.when(lower.isin(*CROSSED), "CROSS").when(lower.isin(*ISOLATED), "ISOLATED").otherwise("UNKNOWN")


def canonical_market_id(record_id: Column, prefix: str = "poly-closed:") -> Column:
    """The prefix and the id without its trailing numeric segment; an id with the prefix stays."""
    return F.when(record_id.startswith(prefix), record_id).otherwise(F.concat(F.lit(prefix), F.regexp_replace(record_id, r":[0-9]+$", "")))


def canonical_cycle_id(record_id: Column, venue: str, third: str) -> Column:
    """`venue:a:b` of the four-segment ids `venue:a:b:number` whose third segment fits `third`; others stay."""
    return F.when(record_id.rlike(f"^{venue}:[^:]*:(?:{third}):[0-9]+$"), F.regexp_replace(record_id, r":[0-9]+$", "")).otherwise(record_id)


def canonical_okx_id(record_id: Column) -> Column:
    return canonical_cycle_id(record_id, "okx", "[0-9]+")


def canonical_bitget_id(record_id: Column) -> Column:
    return canonical_cycle_id(record_id, "bitget", "(?!symbol:)[^:]*")


def coin_of(symbol: Column) -> Column:
    """The part after the last colon of `dex:coin`."""
    return F.substring_index(symbol, ":", -1)


def snapshot_id(prefix: str, moment: Column, *key: Column) -> Column:
    """prefix-moment-digest: the same for the same key and moment."""
    return F.concat_ws("-", F.lit(prefix), F.date_format(moment, "yyyyMMddHHmmss"), F.substring(F.sha2(F.concat_ws(":", *key), 256), 1, 20))


def csv_cell(value: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets a leading quote."""
    return F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)


def shortened(value: Column, most: int = 80) -> Column:
    """At most `most` characters, the last three of a longer text being dots."""
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, most - 3), F.lit("..."))).otherwise(value)
