"""DuckDB SQL of the queries of tables kept up to date."""

from __future__ import annotations

_PARTED = "TIMESTAMP '2024-01-16'"
_ZERO = "CAST(0 AS BIGINT)"


def upkeep_oracles(sql, filled: str, oracles: dict[str, str]) -> dict[str, str]:
    """`sql` puts the shared views before a text, `filled` starts the SQL of points filled from the past."""
    levels = " UNION ALL ".join(f"SELECT CAST({m} AS INTEGER) AS minutes, * FROM ({oracles[name].strip()})" for m, name in ((30, "equity_downsample_30m"), (120, "equity_downsample_2h"), (360, "equity_downsample_6h"), (720, "equity_downsample_12h")))
    return {
        "first_of_day_commits": sql(f"""
, firsts AS (
  SELECT account_id, CAST(recorded_at + INTERVAL 8 HOUR AS DATE) AS day, arg_min(equity, (recorded_at, snapshot_id)) AS equity, min(recorded_at) < {_PARTED} AS early
  FROM snapshots GROUP BY 1, 2),
steps AS (SELECT 1 AS step, * FROM firsts WHERE early UNION ALL SELECT 2, * FROM firsts)
SELECT CAST(step AS INTEGER) AS step, count(*) FILTER (step = 1 OR NOT early) AS inserted, {_ZERO} AS updated, count(*) FILTER (step = 2 AND early) AS unchanged, {_ZERO} AS deleted,
       count(*) AS rows, CAST(sum(equity) AS DOUBLE) AS total FROM steps GROUP BY step"""),
        "asset_replacements": sql(f"""
, halves AS (
  SELECT account_id, asset, arg_max(equity, (recorded_at, snapshot_id)) FILTER (recorded_at < {_PARTED}) AS a,
         arg_max(equity, (recorded_at, snapshot_id)) FILTER (recorded_at >= {_PARTED}) AS b FROM snapshots GROUP BY 1, 2)
SELECT CAST(1 AS INTEGER) AS step, count(a) AS inserted, {_ZERO} AS updated, {_ZERO} AS unchanged, {_ZERO} AS deleted, count(a) AS rows, CAST(coalesce(sum(a), 0) AS DOUBLE) AS total FROM halves
UNION ALL
SELECT 2, count(*) FILTER (a IS NULL), count(*) FILTER (a <> b), count(*) FILTER (a = b), count(*) FILTER (b IS NULL), count(b), CAST(coalesce(sum(b), 0) AS DOUBLE) FROM halves"""),
        "position_day_commits": sql(f"""
, days AS (
  SELECT account_id, symbol, side, CAST(close_time AS DATE) AS day, arg_max(value_usd, (l_linenumber, l_orderkey, value_usd)) FILTER (l_linenumber <= 2) AS a,
         max((l_linenumber, l_orderkey, value_usd)) FILTER (l_linenumber <= 2) AS pa, arg_max(value_usd, (l_linenumber, l_orderkey, value_usd)) AS b, max((l_linenumber, l_orderkey, value_usd)) AS pb
  FROM closed GROUP BY 1, 2, 3, 4)
SELECT CAST(1 AS INTEGER) AS step, count(a) AS inserted, {_ZERO} AS updated, {_ZERO} AS unchanged, {_ZERO} AS deleted, count(a) AS rows, CAST(coalesce(sum(a), 0) AS DOUBLE) AS total FROM days
UNION ALL
SELECT 2, count(*) FILTER (a IS NULL), count(*) FILTER (a IS NOT NULL AND pa <> pb), count(*) FILTER (a IS NOT NULL AND pa = pb), {_ZERO}, count(*), CAST(coalesce(sum(b), 0) AS DOUBLE) FROM days"""),
        "latest_bootstrap": sql(f"""
, newest AS (SELECT account_id, asset, arg_max(equity, (recorded_at, snapshot_id)) AS equity FROM snapshots GROUP BY 1, 2)
SELECT CAST(step AS INTEGER) AS step, CASE step WHEN 1 THEN n ELSE 0 END AS inserted, {_ZERO} AS updated, {_ZERO} AS unchanged, {_ZERO} AS deleted, n AS rows, total
FROM (SELECT count(*) AS n, CAST(sum(equity) AS DOUBLE) AS total FROM newest), range(1, 3) r(step)"""),
        "backfill_commits": _backfill(sql, filled),
        "paged_stream_records": sql("""
SELECT record_type AS stream, record_id AS id, account_id, CAST(amount_usd AS DOUBLE) AS amount, date_trunc('millisecond', record_time) AS record_time FROM ledger"""),
        "equity_rollups": levels,
        "error_dedup_stream": oracles["error_dedup"],
        "status_sticky_stream": oracles["status_sticky"],
        "position_reductions_stream": oracles["position_reductions"],
    }


def _backfill(sql, filled: str) -> str:
    early = filled.replace("FROM snapshots", "FROM early_snapshots")
    for name in ("spine", "expected", "near", "filled"):
        early = early.replace(name, f"early_{name}")
    same = "a.total_equity = e.total_equity AND a.account_count = e.account_count AND a.stale_account_count = e.stale_account_count"
    counts = "CAST({step} AS INTEGER) AS step, count(*) FILTER ({new}) AS inserted, count(*) FILTER ({other}) AS updated, count(*) FILTER ({equal}) AS unchanged, " + f"{_ZERO} AS deleted"
    totals = "count(*) AS rows, round(CAST(coalesce(sum(a.total_equity), 0) AS DOUBLE), 2) AS total"
    return sql(f"""
, early_snapshots AS (SELECT * FROM snapshots WHERE recorded_at < {_PARTED})
{early}{filled}
SELECT {counts.format(step=1, new="true", other="false", equal="false")}, {totals} FROM early_filled a
UNION ALL
SELECT {counts.format(step=2, new="e.bucket_time IS NULL", other=f"e.bucket_time IS NOT NULL AND NOT ({same})", equal=same)}, {totals}
FROM filled a LEFT JOIN early_filled e USING (bucket_time)
UNION ALL
SELECT {counts.format(step=3, new="false", other="false", equal="true")}, {totals} FROM filled a""")
