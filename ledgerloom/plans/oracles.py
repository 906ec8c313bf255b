"""DuckDB SQL that says the same as each named query; common frames are shared WITH clauses."""

from __future__ import annotations

from .payload_oracles import ORACLES as _PAYLOAD_ORACLES
from .records_oracles import records_oracles
from .upkeep_oracles import upkeep_oracles

VIEWS = """
accounts AS (
  SELECT c_custkey AS account_id, r_name AS exchange, c_name AS connection_name, c_acctbal >= 0 AS is_active,
         TIMESTAMP '1996-01-01' AS tracking_started_at, CAST(c_acctbal AS DECIMAL(18,2)) AS initial_equity
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
closed AS (
  SELECT o_custkey AS account_id, p_brand AS symbol, p_name AS title,
         CASE WHEN l_linestatus = 'O' THEN 'LONG' ELSE 'SHORT' END AS side, o_orderdate AS open_time, l_shipdate AS close_time,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS value_usd,
         CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS realized_pnl,
         CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)) AS trading_fee,
         CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) - CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)) AS net_pnl,
         CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)) * CAST(-0.25 AS DECIMAL(3,2)) AS funding_fee,
         l_linenumber AS leverage, CAST(l_quantity AS DECIMAL(18,2)) AS size, l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
trades AS (SELECT c.*, a.exchange, a.connection_name, a.tracking_started_at FROM closed c JOIN accounts a USING (account_id) WHERE a.is_active),
ledger AS (
  SELECT event_id AS record_id, user_id AS account_id, ts AS record_time, k AS record_type, CAST(value AS DECIMAL(18,2)) AS amount_usd,
         CASE WHEN k IN ('TRADING_FEE', 'WITHDRAWAL') THEN -CAST(value AS DECIMAL(18,2)) ELSE CAST(value AS DECIMAL(18,2)) END AS signed_amount_usd
  FROM (SELECT *, CASE event_type WHEN 'purchase' THEN 'REALIZED_PNL' WHEN 'view' THEN 'FUNDING_FEE' WHEN 'click' THEN 'TRADING_FEE' WHEN 'signup' THEN 'DEPOSIT' WHEN 'error' THEN 'WITHDRAWAL' END AS k FROM events)
  WHERE k IS NOT NULL),
records AS (SELECT l.*, a.exchange, a.connection_name FROM ledger l JOIN accounts a USING (account_id) WHERE a.is_active),
snapshots AS (SELECT user_id AS account_id, event_id AS snapshot_id, event_type AS asset, CAST(value AS DECIMAL(18,2)) AS equity, ts AS recorded_at FROM events),
jobs AS (
  SELECT event_id AS job_id, user_id AS account_id, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'SUCCESS' ELSE 'RUNNING' END AS status,
         ts AS started_at, CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT) AS duration_ms
  FROM events WHERE event_type IN ('error', 'purchase', 'signup')),
fills AS (
  SELECT event_id AS fill_id, event_id // 3 AS order_id, user_id AS account_id, 'S' || CAST(user_id % 10 AS VARCHAR) AS symbol,
         CASE WHEN event_type = 'click' THEN 'BUY' ELSE 'SELL' END AS side, CAST(1 + event_id % 5 AS DECIMAL(18,0)) AS quantity,
         CAST(value AS DECIMAL(18,2)) AS price, CAST(value AS DECIMAL(18,2)) * CAST(0.001 AS DECIMAL(4,3)) AS fee, ts AS time
  FROM events WHERE event_type IN ('click', 'view')),
daily AS (
  SELECT account_id, CAST(record_time + INTERVAL 8 HOUR AS DATE) AS snapshot_date,
         coalesce(sum(amount_usd) FILTER (record_type = 'REALIZED_PNL'), 0) AS realized_pnl,
         coalesce(sum(amount_usd) FILTER (record_type = 'FUNDING_FEE'), 0) AS funding_fee,
         coalesce(sum(amount_usd) FILTER (record_type = 'TRADING_FEE'), 0) AS trading_fee,
         coalesce(sum(amount_usd) FILTER (record_type = 'DEPOSIT'), 0) - coalesce(sum(amount_usd) FILTER (record_type = 'WITHDRAWAL'), 0) AS day_cash,
         sum(signed_amount_usd) AS day_signed
  FROM ledger GROUP BY ALL),
account_days AS (
  SELECT d.account_id, a.exchange, d.snapshot_date, d.realized_pnl, d.funding_fee, d.trading_fee,
         sum(d.day_cash) OVER w AS net_cash_flow, a.initial_equity + sum(d.day_signed) OVER w AS equity_usd,
         sum(d.day_signed) OVER w - sum(d.day_cash) OVER w AS investment_return
  FROM daily d JOIN accounts a USING (account_id) WHERE a.is_active
  WINDOW w AS (PARTITION BY d.account_id ORDER BY d.snapshot_date ROWS UNBOUNDED PRECEDING)),
changes AS (
  SELECT account_id, exchange, snapshot_date, realized_pnl, funding_fee, trading_fee, equity_usd,
         net_cash_flow - lag(net_cash_flow, 1, 0) OVER w AS net_cash_flow, investment_return - lag(investment_return, 1, 0) OVER w AS investment_return
  FROM account_days WINDOW w AS (PARTITION BY account_id ORDER BY snapshot_date)),
points AS (
  SELECT *, sum(investment_return) OVER (ORDER BY snapshot_date ROWS UNBOUNDED PRECEDING) AS cumulative_return
  FROM (SELECT snapshot_date, sum(investment_return) AS investment_return, sum(realized_pnl) AS realized_pnl, sum(funding_fee) AS funding_fee,
               sum(trading_fee) AS trading_fee, sum(net_cash_flow) AS net_cash_flow, sum(equity_usd) AS equity_usd FROM changes GROUP BY 1)),
latest AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY recorded_at DESC, snapshot_id DESC) AS rn FROM snapshots) WHERE rn = 1),
held AS (SELECT l.*, a.exchange FROM latest l JOIN accounts a USING (account_id) WHERE a.is_active),
five AS (
  SELECT bucket_time, sum(equity) AS total_equity, count(*) AS account_count, max(recorded_at) AS source_latest_at
  FROM (SELECT *, row_number() OVER (PARTITION BY account_id, bucket_time ORDER BY recorded_at DESC, snapshot_id DESC) AS rn
        FROM (SELECT *, time_bucket(INTERVAL 5 MINUTE, recorded_at, TIMESTAMP '1970-01-01') AS bucket_time FROM snapshots))
  WHERE rn = 1 GROUP BY 1),
runs AS (
  SELECT account_id, arg_max(status, (started_at, job_id)) AS latest_status, max(started_at) AS latest_started_at,
         max(started_at) FILTER (status = 'SUCCESS') AS last_success_at FROM jobs GROUP BY 1),
job_state AS (
  SELECT r.*, (SELECT count(*) FROM jobs j WHERE j.account_id = r.account_id AND j.status = 'FAILED' AND (r.last_success_at IS NULL OR j.started_at > r.last_success_at)) AS consecutive_failures
  FROM runs r),
status AS (
  SELECT a.account_id, a.exchange, a.connection_name, s.latest_status, s.latest_started_at, s.last_success_at, coalesce(s.consecutive_failures, 0) AS consecutive_failures,
         coalesce(floor(epoch(TIMESTAMP '2024-01-31')) - floor(epoch(s.last_success_at)) > 86400, true) AS is_stale
  FROM accounts a LEFT JOIN job_state s USING (account_id) WHERE a.is_active),
preagg AS (
  SELECT a.exchange, x.account_id, x.record_date, x.record_type, sum(x.amount) AS amount_usd, count(*) AS record_count
  FROM (SELECT account_id, CAST(record_time + INTERVAL 8 HOUR AS DATE) AS record_date, record_type, CAST(amount_usd AS DECIMAL(24,4)) AS amount FROM ledger WHERE record_type <> 'REALIZED_PNL'
        UNION ALL SELECT account_id, CAST(close_time + INTERVAL 8 HOUR AS DATE), 'REALIZED_PNL', CAST(realized_pnl AS DECIMAL(24,4)) FROM closed) x
  JOIN accounts a USING (account_id) WHERE a.is_active GROUP BY ALL),
marks AS (
  SELECT *, CAST(value_usd AS DOUBLE) / CAST(size AS DOUBLE) AS price FROM trades WHERE size <> 0),
liq AS (
  SELECT *, greatest(CASE side WHEN 'LONG' THEN price - price * (1 - 1.0 / (leverage + 1)) ELSE price * (1 + 1.0 / (leverage + 1)) - price END / price * 100, 0) AS distance_percent
  FROM marks WHERE price > 0),
margins AS (
  SELECT *, CASE WHEN lev <= 0 THEN abs(CAST(realized_pnl AS DOUBLE)) ELSE abs(CAST(value_usd AS DOUBLE)) * price / (price * 1.02) / lev END AS margin_used
  FROM (SELECT *, CASE WHEN leverage = 7 THEN 0 ELSE leverage END AS lev FROM marks)),
returns AS (
  SELECT *, CASE WHEN margin_used > 0 THEN CAST(net_pnl AS DOUBLE) / margin_used * 100 ELSE 0 END AS return_percent FROM margins)
"""


def _sql(body: str) -> str:
    return f"WITH {VIEWS.strip()}\n{body.strip()}\n"


_FILLED = """
, spine AS (SELECT DISTINCT time_bucket(INTERVAL 5 MINUTE, recorded_at, TIMESTAMP '1970-01-01') AS bucket_time FROM snapshots),
expected AS (SELECT bucket_time, (SELECT count(*) FROM accounts a WHERE a.tracking_started_at < bucket_time + INTERVAL 5 MINUTE) AS n FROM spine),
near AS (
  SELECT s.bucket_time, x.account_id, x.equity, x.recorded_at, x.snapshot_id
  FROM (SELECT *, unnest([0, 5, 10, 15]) AS later FROM snapshots) x JOIN accounts a USING (account_id)
  JOIN spine s ON s.bucket_time = time_bucket(INTERVAL 5 MINUTE, x.recorded_at, TIMESTAMP '1970-01-01') + to_minutes(CAST(later AS BIGINT))
  WHERE x.recorded_at >= s.bucket_time - INTERVAL 15 MINUTE AND a.tracking_started_at < s.bucket_time + INTERVAL 5 MINUTE
  QUALIFY row_number() OVER (PARTITION BY s.bucket_time, x.account_id ORDER BY x.recorded_at DESC, x.snapshot_id DESC) = 1),
filled AS (
  SELECT bucket_time, CAST(sum(equity) AS DOUBLE) AS total_equity, count(*) AS account_count, count(*) FILTER (recorded_at < bucket_time - INTERVAL 3 MINUTE) AS stale_account_count, max(recorded_at) AS source_latest_at
  FROM near GROUP BY 1)
"""
_QUALITY = """
  count(*) AS trade_count, CAST(coalesce(sum(net_pnl), 0) AS DOUBLE) AS net_pnl,
  CASE WHEN count(*) > 0 THEN CAST(sum(net_pnl) AS DOUBLE) / count(*) ELSE 0 END AS average_net,
  CASE WHEN count(*) > 0 THEN CAST(count(*) FILTER (net_pnl > 0) AS DOUBLE) / count(*) * 100 ELSE 0 END AS win_rate,
  CASE WHEN count(*) FILTER (net_pnl > 0) > 0 THEN CAST(sum(net_pnl) FILTER (net_pnl > 0) AS DOUBLE) / count(*) FILTER (net_pnl > 0) ELSE 0 END AS average_win,
  CASE WHEN count(*) FILTER (net_pnl < 0) > 0 THEN CAST(sum(net_pnl) FILTER (net_pnl < 0) AS DOUBLE) / count(*) FILTER (net_pnl < 0) ELSE 0 END AS average_loss
"""
_TOTALS = """
SELECT CAST(realized_pnl AS DOUBLE) AS realized_pnl, CAST(funding_fee AS DOUBLE) AS funding_fee, CAST(trading_fee AS DOUBLE) AS trading_fee,
       CAST(deposits AS DOUBLE) AS deposits, CAST(withdrawals AS DOUBLE) AS withdrawals, CAST(deposits - withdrawals AS DOUBLE) AS net_cash_flow,
       CAST(realized_pnl + funding_fee - trading_fee AS DOUBLE) AS net_realized,
       CAST(realized_pnl + funding_fee - trading_fee + deposits - withdrawals AS DOUBLE) AS net_effect
FROM ({})
"""
_POINT = "CAST(total_equity AS DOUBLE) AS total_equity, account_count, source_latest_at"
_FLOWS = "investment_return realized_pnl funding_fee trading_fee net_cash_flow".split()


def _rollup(unit: str) -> str:
    flows = ", ".join(f"CAST(sum({c}) AS DOUBLE) AS {c}" for c in _FLOWS)
    levels = ", ".join(f"CAST(arg_max({c}, snapshot_date) AS DOUBLE) AS {c}" for c in ("equity_usd", "cumulative_return"))
    return _sql(f"SELECT CAST(date_trunc('{unit}', snapshot_date) AS DATE) AS period_start, {flows}, {levels} FROM points GROUP BY 1")


def _wide(minutes: int) -> str:
    return _sql(f"""
SELECT w AS bucket_time, CAST(arg_max(total_equity, bucket_time) AS DOUBLE) AS total_equity, arg_max(account_count, bucket_time) AS account_count, max(source_latest_at) AS source_latest_at
FROM (SELECT *, time_bucket(INTERVAL {minutes} MINUTE, bucket_time, TIMESTAMP '1970-01-01') AS w FROM five) GROUP BY 1""")


_CYCLES = """
placed AS (
  SELECT *, sum(d) OVER w AS after, sum(d) OVER w - d AS before
  FROM (SELECT *, CASE side WHEN 'BUY' THEN quantity ELSE -quantity END AS d FROM fills)
  WINDOW w AS (PARTITION BY account_id, symbol ORDER BY time, fill_id ROWS UNBOUNDED PRECEDING)),
legs0 AS (
  SELECT *, CASE WHEN before * d < 0 THEN least(abs(before), quantity) ELSE 0 END AS close_quantity,
         CASE WHEN before * d < 0 AND (after = 0 OR before * after < 0) THEN 1 ELSE 0 END AS ends FROM placed),
numbered AS (SELECT *, sum(ends) OVER (PARTITION BY account_id, symbol ORDER BY time, fill_id ROWS UNBOUNDED PRECEDING) AS ended FROM legs0),
legs AS (
  SELECT *, 'close' AS leg, ended - ends AS cycle, close_quantity AS q FROM numbered WHERE close_quantity > 0
  UNION ALL SELECT *, 'open', ended, quantity - close_quantity FROM numbered WHERE quantity > close_quantity),
grouped AS (
  SELECT account_id, symbol, cycle, arg_min(CASE side WHEN 'BUY' THEN 'LONG' ELSE 'SHORT' END, (time, fill_id)) AS side,
         min(time) FILTER (leg = 'open') AS open_time, max(time) FILTER (leg = 'close' AND ends = 1) AS close_time, max(fill_id) FILTER (leg = 'close' AND ends = 1) AS closing_fill_id,
         sum(q) FILTER (leg = 'open') AS oq, sum(price * q) FILTER (leg = 'open') AS o_n, sum(q) FILTER (leg = 'close') AS cq, sum(price * q) FILTER (leg = 'close') AS c_n,
         max(CASE leg WHEN 'open' THEN abs(after) ELSE abs(before) END) AS max_size, sum(CAST(CAST(fee AS DOUBLE) * CAST(q AS DOUBLE) / CAST(quantity AS DOUBLE) AS DECIMAL(24,8))) AS fee
  FROM legs GROUP BY 1, 2, 3),
cycles AS (
  SELECT account_id, symbol, CAST(cycle AS BIGINT) AS cycle, side, open_time, close_time, closing_fill_id, CAST(o_n AS DOUBLE) / CAST(oq AS DOUBLE) AS entry_price,
         CAST(c_n AS DOUBLE) / CAST(cq AS DOUBLE) AS exit_price, CAST(max_size AS DOUBLE) AS max_size,
         CAST((c_n - o_n) * CASE side WHEN 'LONG' THEN 1 ELSE -1 END AS DOUBLE) AS realized_pnl, CAST(fee AS DOUBLE) AS trading_fee
  FROM grouped WHERE close_time IS NOT NULL)
"""

ORACLES: dict[str, str] = {
    "trade_quality_by_side": _sql(f"""
SELECT side, {_QUALITY}, NULL::DOUBLE AS payoff_ratio, NULL::DOUBLE AS profit_factor, NULL::DOUBLE AS long_short_ratio FROM trades GROUP BY side
UNION ALL
SELECT *, CASE WHEN average_loss <> 0 THEN average_win / abs(average_loss) END,
       (SELECT CAST(sum(net_pnl) FILTER (net_pnl > 0) AS DOUBLE) / nullif(abs(CAST(sum(net_pnl) FILTER (net_pnl < 0) AS DOUBLE)), 0) FROM trades),
       (SELECT CAST(count(*) FILTER (side = 'LONG') AS DOUBLE) / nullif(count(*) FILTER (side = 'SHORT'), 0) FROM trades)
FROM (SELECT 'ALL' AS side, {_QUALITY} FROM trades)"""),
    "trade_extremes": _sql("""
(SELECT 'best' AS kind, CAST(net_pnl AS DOUBLE) AS net_pnl, close_time, l_orderkey, l_linenumber, l_partkey, l_suppkey, symbol, side FROM trades
 ORDER BY trades.net_pnl DESC, close_time DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC LIMIT 1)
UNION ALL
(SELECT 'worst', CAST(net_pnl AS DOUBLE), close_time, l_orderkey, l_linenumber, l_partkey, l_suppkey, symbol, side FROM trades
 ORDER BY trades.net_pnl, close_time DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC LIMIT 1)"""),
    "profit_loss_totals": _sql("""
SELECT CAST(coalesce(sum(net_pnl) FILTER (net_pnl > 0), 0) AS DOUBLE) AS total_profit, abs(CAST(coalesce(sum(net_pnl) FILTER (net_pnl < 0), 0) AS DOUBLE)) AS total_loss,
       CAST(coalesce(sum(net_pnl), 0) AS DOUBLE) AS net_pnl FROM trades"""),
    "ledger_union_summary": _sql(_TOTALS.format("""
SELECT (SELECT coalesce(sum(realized_pnl), 0) FROM trades) AS realized_pnl,
       coalesce(sum(amount_usd) FILTER (record_type = 'FUNDING_FEE'), 0) AS funding_fee, coalesce(sum(amount_usd) FILTER (record_type = 'TRADING_FEE'), 0) AS trading_fee,
       coalesce(sum(amount_usd) FILTER (record_type = 'DEPOSIT'), 0) AS deposits, coalesce(sum(amount_usd) FILTER (record_type = 'WITHDRAWAL'), 0) AS withdrawals FROM records""")),
    "ledger_cash_flow_by_exchange": _sql("SELECT exchange, CAST(sum(signed_amount_usd) AS DOUBLE) AS net_cash, count(*) AS records FROM records WHERE record_type IN ('DEPOSIT', 'WITHDRAWAL') GROUP BY 1"),
    "ledger_page": _sql("""
SELECT record_id, account_id, exchange, connection_name, record_time, record_type, CAST(signed_amount_usd AS DOUBLE) AS signed_amount_usd
FROM records ORDER BY record_time DESC, record_id LIMIT 50 OFFSET 50"""),
    "ledger_record_count": _sql("""
SELECT record_type, count(*) AS total FROM records
WHERE exchange = 'ASIA' AND record_time >= TIMESTAMP '2024-01-04 16:00:00' AND record_time <= TIMESTAMP '2024-01-20 15:59:59.999999' GROUP BY 1"""),
    "ledger_daily_preagg": _sql("SELECT exchange, account_id, record_date, record_type, CAST(amount_usd AS DOUBLE) AS amount_usd, record_count FROM preagg"),
    "ledger_day_aligned_summary": _sql(_TOTALS.format("""
SELECT (SELECT coalesce(sum(realized_pnl), 0) FROM trades WHERE close_time BETWEEN TIMESTAMP '2024-01-04 16:00:00' AND TIMESTAMP '2024-01-20 15:59:59.999999') AS realized_pnl,
       coalesce(sum(amount_usd) FILTER (record_type = 'FUNDING_FEE'), 0) AS funding_fee, coalesce(sum(amount_usd) FILTER (record_type = 'TRADING_FEE'), 0) AS trading_fee,
       coalesce(sum(amount_usd) FILTER (record_type = 'DEPOSIT'), 0) AS deposits, coalesce(sum(amount_usd) FILTER (record_type = 'WITHDRAWAL'), 0) AS withdrawals
FROM records WHERE record_time BETWEEN TIMESTAMP '2024-01-04 16:00:00' AND TIMESTAMP '2024-01-20 15:59:59.999999'""")),
    "pnl_account_days": _sql("""
SELECT account_id, exchange, snapshot_date, CAST(realized_pnl AS DOUBLE) AS realized_pnl, CAST(funding_fee AS DOUBLE) AS funding_fee, CAST(trading_fee AS DOUBLE) AS trading_fee,
       CAST(net_cash_flow AS DOUBLE) AS net_cash_flow, CAST(equity_usd AS DOUBLE) AS equity_usd, CAST(investment_return AS DOUBLE) AS investment_return FROM account_days"""),
    "pnl_daily": _sql("SELECT snapshot_date, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in (*_FLOWS, "equity_usd", "cumulative_return")) + " FROM points"),
    "pnl_weekly": _rollup("week"),
    "pnl_monthly": _rollup("month"),
    "pnl_by_exchange": _sql("""
SELECT e.exchange, """ + ", ".join(f"CAST(coalesce(sum(c.{x}), 0) AS DOUBLE) AS {x}" for x in _FLOWS) + """, count(DISTINCT c.snapshot_date) AS days
FROM (SELECT DISTINCT exchange FROM accounts WHERE is_active) e LEFT JOIN changes c USING (exchange) GROUP BY 1"""),
    "pnl_day_stats": _sql("""
SELECT CAST(coalesce(max(investment_return), 0) AS DOUBLE) AS best_day, CAST(coalesce(min(investment_return), 0) AS DOUBLE) AS worst_day,
       count(*) FILTER (investment_return > 0) AS profitable_days, count(*) FILTER (investment_return < 0) AS losing_days, CAST(coalesce(sum(investment_return), 0) AS DOUBLE) AS period_return FROM points"""),
    "max_drawdown": _sql("""
SELECT coalesce(max(CASE WHEN peak > 0 THEN (peak - e) / peak * 100 END), 0.0) AS max_drawdown
FROM (SELECT CAST(equity_usd AS DOUBLE) AS e, greatest(max(CAST(equity_usd AS DOUBLE)) OVER (ORDER BY snapshot_date ROWS UNBOUNDED PRECEDING), 0.0) AS peak FROM points)"""),
    "latest_balance": _sql("SELECT account_id, snapshot_id, asset, CAST(equity AS DOUBLE) AS equity, recorded_at FROM latest"),
    "latest_balance_as_of": _sql("""
SELECT account_id, snapshot_id, asset, CAST(equity AS DOUBLE) AS equity, recorded_at FROM snapshots WHERE recorded_at <= TIMESTAMP '2024-01-20 15:59:59.999999'
QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY recorded_at DESC, snapshot_id DESC) = 1"""),
    "latest_asset_batch": _sql("""
SELECT account_id, CAST(recorded_at AS DATE) AS batch_day, asset, snapshot_id, CAST(equity AS DOUBLE) AS equity FROM snapshots
QUALIFY CAST(recorded_at AS DATE) = max(CAST(recorded_at AS DATE)) OVER (PARTITION BY account_id)"""),
    "first_of_day_snapshots": _sql("""
SELECT account_id, CAST(recorded_at + INTERVAL 8 HOUR AS DATE) AS day, snapshot_id, CAST(equity AS DOUBLE) AS equity, recorded_at FROM snapshots
QUALIFY row_number() OVER (PARTITION BY account_id, CAST(recorded_at + INTERVAL 8 HOUR AS DATE) ORDER BY recorded_at, snapshot_id) = 1"""),
    "dashboard_summary": _sql("""
SELECT (SELECT CAST(coalesce(sum(equity), 0) AS DOUBLE) FROM held) AS total_equity, (SELECT count(*) FROM held) AS accounts,
       (SELECT count(*) FROM snapshots JOIN accounts USING (account_id) WHERE is_active AND equity < 1 AND equity <> 0) AS unvalued_assets,
       (SELECT CAST(investment_return AS DOUBLE) FROM points ORDER BY snapshot_date DESC LIMIT 1) AS today_return"""),
    "sync_status": _sql("SELECT * FROM status"),
    "sync_health": _sql("""
SELECT count(*) AS total_accounts, count(*) FILTER (NOT is_stale AND consecutive_failures = 0) AS healthy_accounts, count(*) FILTER (is_stale) AS stale_accounts,
       count(*) FILTER (consecutive_failures > 0) AS failing_accounts, count(*) FILTER (latest_status = 'RUNNING') AS running_accounts FROM status"""),
    "consecutive_failures": _sql("SELECT account_id, consecutive_failures FROM job_state WHERE consecutive_failures > 0"),
    "ops_panel": _sql("""
SELECT jobs, successful, failed, CASE WHEN successful > 0 THEN CAST(total_ms AS DOUBLE) / successful ELSE 0 END AS average_ms, distinct_errors, latest_at,
       CASE WHEN jobs > 0 THEN CAST(successful * 100 AS DOUBLE) / jobs ELSE 0 END AS success_rate
FROM (SELECT count(*) AS jobs, count(*) FILTER (status = 'SUCCESS') AS successful, count(*) FILTER (status = 'FAILED') AS failed, sum(duration_ms) FILTER (status = 'SUCCESS') AS total_ms,
             count(DISTINCT (account_id, status, date_trunc('hour', started_at))) FILTER (status = 'FAILED') AS distinct_errors, max(started_at) AS latest_at
      FROM jobs WHERE started_at >= TIMESTAMP '2024-01-31' - INTERVAL 240 HOUR)"""),
    "exchange_concentration": _sql("""
SELECT exchange, CAST(sum(equity) AS DOUBLE) AS equity, CASE WHEN sum(sum(equity)) OVER () <> 0 THEN CAST(sum(equity) AS DOUBLE) / CAST(sum(sum(equity)) OVER () AS DOUBLE) * 100 ELSE 0 END AS share_percent
FROM held GROUP BY 1"""),
    "top_exposures": _sql("""
SELECT symbol, CAST(sum(abs(value_usd)) AS DOUBLE) AS value_usd, CAST(sum(net_pnl) AS DOUBLE) AS pnl, array_to_string(list_sort(list(DISTINCT exchange)), ',') AS exchanges,
       CAST(sum(abs(value_usd)) AS DOUBLE) / (SELECT CAST(sum(equity) AS DOUBLE) FROM held) * 100 AS equity_percent
FROM trades GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""),
    "nearest_liquidations": _sql("""
SELECT account_id, symbol, side, round(distance_percent, 6) AS distance_percent, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM liq
WHERE liq.distance_percent IS NOT NULL ORDER BY round(liq.distance_percent, 9), account_id, symbol, side, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 10"""),
    "liquidation_distances": _sql("SELECT symbol, side, round(min(distance_percent), 6) AS distance_percent, count(distance_percent) AS positions FROM liq GROUP BY 1, 2"),
    "risk_summary": _sql("""
SELECT *, CASE WHEN max_drawdown >= 25 OR largest_share >= 50 OR margin_utilization >= 80 OR nearest_liquidation <= 10 THEN 'HIGH'
               WHEN max_drawdown >= 15 OR largest_share >= 35 OR margin_utilization >= 50 OR nearest_liquidation <= 20 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
FROM (SELECT (SELECT coalesce(max(CASE WHEN peak > 0 THEN (peak - e) / peak * 100 END), 0.0)
              FROM (SELECT CAST(equity_usd AS DOUBLE) AS e, greatest(max(CAST(equity_usd AS DOUBLE)) OVER (ORDER BY snapshot_date ROWS UNBOUNDED PRECEDING), 0.0) AS peak FROM points)) AS max_drawdown,
             (SELECT max(s) FROM (SELECT CAST(sum(equity) AS DOUBLE) / CAST(sum(sum(equity)) OVER () AS DOUBLE) * 100 AS s FROM held GROUP BY exchange)) AS largest_share,
             (SELECT CAST(sum(abs(equity)) / 4 AS DOUBLE) * 100 / CAST(sum(equity) AS DOUBLE) FROM held) AS margin_utilization,
             (SELECT min(round(distance_percent, 6)) FROM liq) AS nearest_liquidation)"""),
    "equity_points_5m": _sql(f"SELECT bucket_time, {_POINT} FROM five"),
    "equity_downsample_30m": _wide(30),
    "equity_downsample_2h": _wide(120),
    "equity_downsample_6h": _wide(360),
    "equity_downsample_12h": _wide(720),
    "equity_downsample_in_place": _sql(f"SELECT bucket_time, {_POINT} FROM five QUALIFY row_number() OVER (PARTITION BY time_bucket(INTERVAL 360 MINUTE, bucket_time, TIMESTAMP '1970-01-01') ORDER BY bucket_time DESC) = 1"),
    "equity_change": _sql("""
SELECT first, last, last - first AS change_amount, CASE WHEN first <> 0 THEN (last - first) / first * 100 END AS change_percent
FROM (SELECT CAST(arg_min(total_equity, bucket_time) AS DOUBLE) AS first, CAST(arg_max(total_equity, bucket_time) AS DOUBLE) AS last FROM five)"""),
    "equity_backfill_asof": _sql(_FILLED + "SELECT bucket_time, total_equity, account_count, stale_account_count, source_latest_at FROM filled JOIN expected USING (bucket_time) WHERE account_count = n").replace(")\n, spine AS", "),\nspine AS"),
    "equity_backfill_coverage": _sql(_FILLED + "SELECT bucket_time, total_equity, account_count, stale_account_count, source_latest_at, n AS expected FROM filled JOIN expected USING (bucket_time)").replace(")\n, spine AS", "),\nspine AS"),
    "positions_filtered_page": _sql("""
SELECT account_id, symbol, side, close_time, CAST(value_usd AS DOUBLE) AS value_usd, CAST(net_pnl AS DOUBLE) AS net_pnl, l_orderkey, l_linenumber, l_partkey, l_suppkey
FROM trades WHERE close_time >= tracking_started_at AND exchange = 'EUROPE' AND side = 'LONG' AND net_pnl > 0 AND (symbol ILIKE '%brand#1%' OR title ILIKE '%brand#1%')
ORDER BY trades.value_usd DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, account_id LIMIT 25 OFFSET 25"""),
    "history_result_class": _sql("""
SELECT CASE WHEN net_pnl > 0 THEN 'PROFIT' WHEN net_pnl < 0 THEN 'LOSS' ELSE 'BREAKEVEN' END AS result, exchange, count(*) AS positions, CAST(sum(net_pnl) AS DOUBLE) AS net_pnl
FROM trades WHERE close_time >= open_time GROUP BY 1, 2"""),
    "top_positions": _sql("""
SELECT exchange, symbol, side, CAST(value_usd AS DOUBLE) AS value_usd, l_orderkey, l_linenumber, l_partkey, l_suppkey
FROM trades ORDER BY abs(trades.value_usd) DESC, exchange, symbol, side, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 6"""),
    "symbol_search_exists": _sql("""
SELECT symbol, count(*) AS positions, CAST(sum(net_pnl) AS DOUBLE) AS net_pnl FROM closed c
WHERE symbol ILIKE '%ring%' OR EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = c.l_partkey AND p.p_name ILIKE '%ring%') GROUP BY 1"""),
    "order_fill_merge": _sql("""
SELECT account_id, symbol, CASE WHEN fill_id % 2 = 0 THEN 'LONG' ELSE 'BOTH' END AS position_side, side,
       CASE WHEN fill_id % 11 = 0 THEN 'trade:' || fill_id ELSE CAST(order_id AS VARCHAR) END AS order_key, CASE WHEN fill_id % 4 = 0 THEN 'BNB' ELSE 'USDT' END AS fee_asset,
       CAST(sum(quantity) AS DOUBLE) AS quantity, CAST(sum(fee) AS DOUBLE) AS fee, CAST(sum(price - 50) AS DOUBLE) AS realized_pnl,
       CAST(sum(price * quantity) AS DOUBLE) / CAST(sum(quantity) AS DOUBLE) AS average_price, max(time) AS time, arg_max(fill_id, (time, fill_id)) AS last_fill_id, count(*) AS fills
FROM fills GROUP BY ALL"""),
    "trade_cycles_one_way": f"WITH {VIEWS.strip()},{_CYCLES}" + """
SELECT *, realized_pnl - trading_fee AS net_pnl, CASE WHEN entry_price * max_size <> 0 THEN realized_pnl / (entry_price * max_size) * 100 ELSE 0 END AS return_percent FROM cycles
""",
    "funding_interval_join": f"WITH {VIEWS.strip()},{_CYCLES}" + """
SELECT account_id, symbol, cycle, open_time, close_time, realized_pnl, trading_fee, f AS funding_fee, realized_pnl + f - trading_fee AS net_pnl
FROM (SELECT c.*, (SELECT CAST(coalesce(sum(amount_usd), 0) AS DOUBLE) FROM ledger l WHERE l.record_type = 'DEPOSIT' AND l.account_id = c.account_id AND l.record_time BETWEEN c.open_time AND c.close_time) AS f FROM cycles c)
""",
    "dedup_keeper": _sql("""
SELECT account_id, symbol, side, close_time, group_size, l_orderkey, l_linenumber, l_partkey, l_suppkey
FROM (SELECT *, count(*) OVER (PARTITION BY account_id, symbol, side) AS group_size,
             row_number() OVER (PARTITION BY account_id, symbol, side ORDER BY close_time DESC, open_time DESC, value_usd DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM trades)
WHERE rn = 1"""),
    "duplicate_detector": "SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "position_margin": _sql("""
SELECT side, lev, CAST(sum(CAST(round(margin_used, 4) AS DECIMAL(28,4))) AS DOUBLE) AS margin_used, CAST(sum(CAST(round(return_percent, 4) AS DECIMAL(28,4))) AS DOUBLE) AS return_percent, count(*) AS positions
FROM returns GROUP BY 1, 2"""),
    "quality_rules": _sql("""
, found AS (
  SELECT account_id, 'INVALID_LEVERAGE' AS code, 'WARNING' AS severity FROM returns WHERE lev <= 0 OR lev > 200
  UNION ALL SELECT account_id, 'NON_POSITIVE_MARGIN', 'WARNING' FROM returns WHERE margin_used <= 0
  UNION ALL SELECT account_id, 'RETURN_MISMATCH', 'ERROR' FROM returns WHERE margin_used > 0 AND l_suppkey % 11 = 0 AND abs(50.0 - return_percent) > 0.01
  UNION ALL SELECT account_id, 'DUPLICATE_CLOSED_POSITION', 'ERROR' FROM trades GROUP BY account_id, symbol, side, open_time, close_time HAVING count(*) > 1)
SELECT code, severity, count(*) AS issues, count(DISTINCT account_id) AS accounts FROM found GROUP BY 1, 2""").replace(")\n, found AS", "),\nfound AS"),
    "disappeared_positions": _sql("""
SELECT p.account_id, 'POSITION_DISAPPEARED' AS code, 'ERROR' AS severity, p.symbol || ' ' || p.side AS entity
FROM (SELECT DISTINCT account_id, symbol, side FROM closed WHERE l_linenumber = 1) p
WHERE NOT EXISTS (SELECT 1 FROM closed n WHERE n.l_linenumber = 2 AND n.account_id = p.account_id AND n.symbol = p.symbol AND n.side = p.side)
  AND NOT EXISTS (SELECT 1 FROM closed n WHERE n.l_linenumber = 3 AND n.account_id = p.account_id AND n.symbol = p.symbol AND n.side = p.side
                  AND abs(epoch_us(TIMESTAMP '1998-06-01 00:02:00') - epoch_us(n.close_time)) < 300000000)"""),
    "retention_candidates": _sql("""
SELECT s.account_id, count(*) AS expired, max(recorded_at) AS latest_expired FROM snapshots s
WHERE recorded_at < TIMESTAMP '2024-01-21' AND EXISTS (SELECT 1 FROM account_days d WHERE d.account_id = s.account_id AND d.snapshot_date = CAST(s.recorded_at + INTERVAL 8 HOUR AS DATE) AND d.account_id % 3 <> 0)
GROUP BY 1"""),
    "affected_days_incremental": _sql("""
SELECT exchange, account_id, record_date, record_type, CAST(amount_usd AS DOUBLE) AS amount_usd, record_count FROM preagg"""),
    "ledger_upsert": _sql("""
SELECT account_id, record_type, record_id, record_time, CASE WHEN record_id % 3 = 0 THEN CAST(amount_usd AS DOUBLE) + 1 ELSE CAST(amount_usd AS DOUBLE) END AS amount_usd
FROM ledger"""),
    "symbol_normalize": """
SELECT p_partkey, CASE n WHEN 3 THEN upper(b) || '-USDC-PERP' WHEN 4 THEN upper(b) || 'B-USD-PERP' ELSE upper(b) || '-USDT-PERP' END AS symbol,
       CASE WHEN n < 2 THEN 'LONG' WHEN n < 4 THEN 'SHORT' WHEN p_size - 25 < 0 THEN 'SHORT' ELSE 'LONG' END AS side,
       CASE n WHEN 0 THEN 'CROSS' WHEN 1 THEN 'ISOLATED' ELSE 'UNKNOWN' END AS margin_mode
FROM (SELECT *, p_partkey % 6 AS n, replace(replace(p_brand, '#', ''), ' ', '') AS b FROM part)""",
    "csv_guard": """
SELECT p_partkey, CASE WHEN s IN ('=', '+', '-', '@') THEN '''' || s || p_name ELSE s || p_name END AS cell
FROM (SELECT *, CASE p_partkey % 6 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' WHEN 4 THEN '' ELSE '''' END AS s FROM part)""",
    "canonical_ids": """
SELECT DISTINCT l_orderkey, l_partkey, l_linenumber, 'okx:' || l_orderkey || ':' || l_partkey AS okx_id,
       CASE WHEN l_partkey % 2 = 0 THEN 'bitget:' || l_orderkey || ':symbol:' || l_linenumber ELSE 'bitget:' || l_orderkey || ':' || l_partkey END AS bitget_id,
       'poly-closed:' || l_orderkey || ':' || l_partkey AS market_id FROM lineitem""",
    "snapshot_ids": _sql("SELECT snapshot_id, 'asset-daily-' || strftime(recorded_at, '%Y%m%d%H%M%S') || '-' || substr(sha256(account_id || ':' || asset), 1, 20) AS source_record_id FROM snapshots"),
    "combo_mark_price": """
SELECT l_orderkey, count(*) AS n_legs,
       round(CASE WHEN bool_or(missing) THEN 0.5 WHEN l_orderkey % 3 = 0 THEN 1 - product(least(greatest(p, 0), 1)) ELSE product(least(greatest(p, 0), 1)) END, 9) AS mark_price
FROM (SELECT l_orderkey, CASE WHEN l_partkey % 11 = 0 THEN 1.0 WHEN l_partkey % 13 = 0 THEN 0.0 ELSE coalesce(price, 0) END AS p,
             l_partkey % 11 <> 0 AND l_partkey % 13 <> 0 AND coalesce(price, 0) <= 0 AS missing
      FROM (SELECT *, CASE WHEN l_linenumber = 7 AND l_partkey % 5 = 0 THEN NULL ELSE l_discount * 10 END AS price FROM lineitem)) GROUP BY l_orderkey""",
    "reconciliation": _sql("SELECT * FROM rec"),
    "reconciliation_totals": _sql("SELECT 1"),
    "completeness_matrix": _sql("SELECT 1"),
    "completeness_counts": _sql("SELECT 1"),
}
_RECONCILED = """
amounts AS (
  SELECT account_id, sum(amount_usd) FILTER (record_type NOT IN ('REALIZED_PNL', 'FUNDING_FEE', 'TRADING_FEE', 'WITHDRAWAL')) AS dep, sum(amount_usd) FILTER (record_type = 'WITHDRAWAL') AS wd,
         count(*) FILTER (record_type = 'FUNDING_FEE') AS nf, sum(amount_usd) FILTER (record_type = 'FUNDING_FEE') AS ff,
         count(*) FILTER (record_type = 'TRADING_FEE') AS nt, sum(amount_usd) FILTER (record_type = 'TRADING_FEE') AS tf FROM ledger GROUP BY 1),
pos AS (SELECT account_id, sum(realized_pnl) AS r, sum(net_pnl) AS n, sum(abs(trading_fee)) AS f, sum(funding_fee) AS cf FROM closed GROUP BY 1),
base AS (
  SELECT a.account_id, a.exchange, coalesce(CAST(a.initial_equity AS DOUBLE), 0) AS initial_equity, coalesce(CAST(l.equity AS DOUBLE), 0) AS current_equity, coalesce(CAST(dep AS DOUBLE), 0) AS deposits,
         coalesce(CAST(wd AS DOUBLE), 0) AS withdrawals, coalesce(CAST(pos.r AS DOUBLE), 0) AS realized_pnl, CASE WHEN coalesce(nf, 0) > 0 THEN coalesce(CAST(ff AS DOUBLE), 0) ELSE coalesce(CAST(pos.cf AS DOUBLE), 0) END AS funding_fee,
         CASE WHEN coalesce(nt, 0) > 0 THEN coalesce(CAST(tf AS DOUBLE), 0) ELSE coalesce(CAST(pos.f AS DOUBLE), 0) END AS trading_fee, coalesce(CAST(pos.n AS DOUBLE), 0) AS net_realized_pnl
  FROM accounts a LEFT JOIN latest l USING (account_id) LEFT JOIN amounts USING (account_id) LEFT JOIN pos USING (account_id) WHERE a.is_active),
rec AS (
  SELECT *, equity_return - component_return AS variance, greatest(1.0, abs(current_equity) * 0.001) AS tolerance,
         CASE WHEN abs(equity_return - component_return) <= greatest(1.0, abs(current_equity) * 0.001) THEN 'MATCHED' ELSE 'REVIEW' END AS status
  FROM (SELECT *, deposits - withdrawals AS net_cash_flow, current_equity - initial_equity - (deposits - withdrawals) AS equity_return, net_realized_pnl AS component_return FROM base))
"""
_COMPONENTS = """
reads_ AS (SELECT account_id, max(started_at) FILTER (status = 'SUCCESS') AS synced, arg_max(started_at, (started_at, job_id)) AS full_synced FROM jobs GROUP BY 1),
eq AS (SELECT account_id, count(*) AS n, max(recorded_at) AS t FROM snapshots GROUP BY 1),
ba AS (SELECT account_id, count(*) AS n, max(recorded_at) AS t FROM snapshots WHERE asset IN ('purchase', 'view') GROUP BY 1),
po AS (SELECT account_id, count(*) AS n, max(open_time) AS t FROM closed WHERE side = 'LONG' GROUP BY 1),
cl AS (SELECT account_id, count(*) AS n, max(close_time) AS t FROM closed GROUP BY 1),
kinds AS (SELECT account_id, CASE record_type WHEN 'REALIZED_PNL' THEN 'realized_pnl' WHEN 'FUNDING_FEE' THEN 'funding_fee' WHEN 'TRADING_FEE' THEN 'trading_fee' ELSE 'cash_flow' END AS component,
                 count(*) AS n, max(record_time) AS t FROM ledger GROUP BY 1, 2),
found AS (
  SELECT account_id, 'equity' AS component, n, t FROM eq UNION ALL SELECT account_id, 'balances', n, t FROM ba UNION ALL SELECT account_id, 'positions', n, t FROM po
  UNION ALL SELECT account_id, 'closed_positions', n, t FROM cl UNION ALL SELECT account_id, component, n, t FROM kinds),
names AS (SELECT unnest(['equity', 'positions', 'balances', 'closed_positions', 'realized_pnl', 'funding_fee', 'trading_fee', 'cash_flow']) AS component),
stats AS (
  SELECT a.account_id, a.exchange, n.component, coalesce(f.n, 0) AS n, f.t, r.synced, r.full_synced, coalesce(c.n, 0) AS closed_n, c.t AS closed_t, a.exchange = 'AFRICA' AS bare,
         CASE WHEN a.account_id % 9 <> 0 AND r.synced IS NOT NULL THEN 'COMPLETE' ELSE 'PARTIAL' END AS own
  FROM accounts a CROSS JOIN names n LEFT JOIN found f ON f.account_id = a.account_id AND f.component = n.component
  LEFT JOIN reads_ r ON r.account_id = a.account_id LEFT JOIN cl c ON c.account_id = a.account_id WHERE a.is_active),
matrix AS (
  SELECT account_id, exchange, component,
         CASE WHEN bare AND component = 'realized_pnl' THEN 'PARTIAL' WHEN bare AND component IN ('funding_fee', 'trading_fee', 'cash_flow') THEN 'UNSUPPORTED'
              WHEN component IN ('equity', 'positions') THEN own
              WHEN component = 'balances' THEN CASE WHEN account_id % 7 = 0 OR n = 0 THEN 'PARTIAL' ELSE own END
              WHEN component = 'closed_positions' AND account_id % 5 = 0 OR component = 'realized_pnl' AND account_id % 2 = 0 OR component = 'funding_fee' AND account_id % 3 = 0 THEN 'COMPLETE'
              WHEN component = 'cash_flow' AND account_id % 4 = 0 THEN 'FAILED' ELSE 'PARTIAL' END AS status,
         CASE WHEN component IN ('equity', 'positions', 'balances', 'closed_positions') OR bare AND component = 'realized_pnl' THEN synced WHEN bare THEN NULL ELSE full_synced END AS last_synced_at,
         CASE WHEN bare AND component = 'realized_pnl' THEN closed_n WHEN bare AND component IN ('funding_fee', 'trading_fee', 'cash_flow') THEN 0 ELSE n END AS record_count,
         CASE WHEN bare AND component = 'realized_pnl' THEN closed_t WHEN bare AND component IN ('funding_fee', 'trading_fee', 'cash_flow') THEN NULL ELSE t END AS latest_record_at
  FROM stats)
"""
_MEASURES = "initial_equity current_equity deposits withdrawals net_cash_flow equity_return realized_pnl funding_fee trading_fee net_realized_pnl component_return variance".split()
ORACLES |= {
    "reconciliation": f"WITH {VIEWS.strip()},{_RECONCILED}SELECT * FROM rec",
    "reconciliation_totals": f"WITH {VIEWS.strip()},{_RECONCILED}SELECT " + ", ".join(f"CAST(coalesce(sum(CAST({m} AS DECIMAL(28,4))), 0) AS DOUBLE) AS {m}" for m in _MEASURES) + ", CASE WHEN coalesce(bool_and(status = 'MATCHED'), true) THEN 'MATCHED' ELSE 'REVIEW' END AS status FROM rec",
    "completeness_matrix": f"WITH {VIEWS.strip()},{_COMPONENTS}SELECT * FROM matrix",
    "completeness_counts": f"WITH {VIEWS.strip()},{_COMPONENTS}SELECT status, count(*) AS components FROM matrix GROUP BY 1",
}
ORACLES |= {
    "equity_points_streaming": ORACLES["equity_points_5m"],
    "price_graph": """
WITH RECURSIVE r AS (
  SELECT n_nationkey AS token, 1.0::DOUBLE AS price FROM nation WHERE n_nationkey = 0
  UNION ALL SELECT n.n_nationkey, r.price * (1 + n.n_regionkey / 4.0::DOUBLE) FROM nation n JOIN r ON n.n_nationkey > 0 AND n.n_nationkey // 2 = r.token)
SELECT token, round(price, 9) AS price FROM r""",
    "leverage_inference": _sql("""
, timed AS (SELECT * FROM trades WHERE close_time >= open_time),
opened AS (
  SELECT account_id, symbol, side, leverage // 2 AS lev, open_time AS at FROM timed
  WHERE leverage // 2 > 0 AND (l_partkey % 5 = 1 OR l_partkey % 5 <> 2))
SELECT leverage, count(*) AS positions FROM (
  SELECT p.account_id, p.id, CASE WHEN min(o.lev) = max(o.lev) THEN min(o.lev) END AS leverage
  FROM (SELECT DISTINCT account_id, symbol, side, l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS id, open_time, close_time FROM timed) p
  LEFT JOIN opened o ON o.account_id = p.account_id AND o.symbol = p.symbol AND o.side = p.side AND o.at >= p.open_time - INTERVAL 300 SECOND AND o.at <= p.close_time
  GROUP BY p.account_id, p.id, p.open_time, p.close_time) GROUP BY 1""").replace(")\n, timed AS", "),\ntimed AS"),
    "translation_queue": _sql("""
SELECT job_id AS item_id, CASE status WHEN 'RUNNING' THEN 'PENDING' ELSE status END AS status, job_id % 8 AS attempts, started_at AS created_at
FROM jobs WHERE job_id % 8 < 5 AND (status = 'RUNNING' OR (status = 'FAILED' AND started_at < TIMESTAMP '2024-01-20 15:59:59.999999' - INTERVAL 15 MINUTE)) ORDER BY started_at, job_id LIMIT 100"""),
    "content_changes": """
SELECT p_partkey, p_name, CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) ELSE p_type END AS p_type FROM part
WHERE p_partkey % 5 = 0 OR (p_partkey % 3 = 0 AND lower(p_type) <> p_type)""",
    "position_reductions": _sql("""
SELECT account_id, symbol, side, CAST(b AS DOUBLE) AS before, CAST(coalesce(a, 0) AS DOUBLE) AS after
FROM (SELECT account_id, symbol, side, sum(abs(size)) FILTER (l_linenumber <= 3) AS b, sum(abs(size)) FILTER (l_linenumber > 3) AS a FROM closed GROUP BY 1, 2, 3)
WHERE b IS NOT NULL AND coalesce(a, 0) < b"""),
}
_STATED = """
stated AS (
  SELECT *, sum(d) OVER w - d + 3 AS start_position, CAST(price - 50 AS DECIMAL(18,2)) AS closed_pnl
  FROM (SELECT *, CASE side WHEN 'BUY' THEN quantity ELSE -quantity END AS d FROM fills)
  WINDOW w AS (PARTITION BY account_id, symbol ORDER BY time, fill_id ROWS UNBOUNDED PRECEDING)),
sized AS (SELECT *, start_position + d AS end_position, CASE WHEN start_position * d < 0 THEN least(abs(start_position), quantity) ELSE 0 END AS closes FROM stated),
ended AS (
  SELECT *, sum(ends) OVER (PARTITION BY account_id, symbol ORDER BY time, fill_id ROWS UNBOUNDED PRECEDING) AS ended
  FROM (SELECT *, CASE WHEN closes > 0 AND (end_position = 0 OR end_position * start_position < 0) THEN 1 ELSE 0 END AS ends FROM sized)),
parts AS (
  SELECT *, 'close' AS leg, ended - ends AS cycle, closes AS q, start_position > 0 AS long, false AS fresh FROM ended WHERE closes > 0
  UNION ALL SELECT *, 'open', ended, quantity - closes, end_position > 0, start_position = 0 OR closes > 0 FROM ended WHERE quantity > closes),
cyc AS (
  SELECT account_id, symbol, CAST(cycle AS BIGINT) AS cycle, arg_min(CASE WHEN long THEN 'LONG' ELSE 'SHORT' END, (time, fill_id)) AS side, arg_min(fresh, (time, fill_id)) AS complete,
         min(time) FILTER (leg = 'open') AS open_time, max(time) FILTER (leg = 'close' AND ends = 1) AS close_time,
         sum(q) FILTER (leg = 'open') AS oq, sum(price * q) FILTER (leg = 'open') AS o_n, sum(q) FILTER (leg = 'close') AS cq, sum(price * q) FILTER (leg = 'close') AS c_n,
         sum(price * q - CASE WHEN long THEN closed_pnl ELSE -closed_pnl END) FILTER (leg = 'close') AS i_n, sum(closed_pnl) FILTER (leg = 'close') AS pnl,
         max(CASE leg WHEN 'close' THEN abs(start_position) ELSE abs(end_position) END) AS max_size,
         CAST(sum(CAST(CAST(fee AS DOUBLE) * CAST(q AS DOUBLE) / CAST(quantity AS DOUBLE) AS DECIMAL(24,8))) AS DOUBLE) AS fee
  FROM parts GROUP BY 1, 2, 3)
"""
_REBUILD = """
src AS (SELECT l_orderkey || ':' || l_linenumber AS base_id, symbol, side, open_time, l_partkey, l_suppkey, l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS id FROM closed),
wanted AS (SELECT DISTINCT CASE WHEN l_partkey % 5 = 0 THEN id ELSE 'new:' || id END AS source_record_id, base_id, symbol, side, open_time FROM src WHERE l_suppkey % 3 <> 0),
legacy AS (SELECT * FROM src WHERE l_partkey % 2 = 0),
planned AS (
  SELECT w.*, (SELECT count(*) FROM legacy l WHERE l.base_id = w.base_id AND l.symbol = w.symbol AND l.side = w.side AND l.open_time = w.open_time) AS n,
         EXISTS (SELECT 1 FROM src s WHERE s.id = w.source_record_id) AS there FROM wanted w)
"""
ORACLES |= {
    "active_accounts": _sql("SELECT account_id, exchange, connection_name, CAST(initial_equity AS DOUBLE) AS initial_equity FROM accounts WHERE is_active"),
    "realized_income_first": _sql("""
SELECT d.account_id, d.snapshot_date, CAST(coalesce(CASE WHEN i.n > 0 THEN i.s ELSE c.s END, 0) AS DOUBLE) AS realized_pnl
FROM account_days d
LEFT JOIN (SELECT account_id, CAST(record_time + INTERVAL 8 HOUR AS DATE) AS day, count(*) AS n, sum(amount_usd) AS s FROM ledger WHERE record_type = 'REALIZED_PNL' GROUP BY 1, 2) i ON i.account_id = d.account_id AND i.day = d.snapshot_date
LEFT JOIN (SELECT account_id, CAST(time + INTERVAL 8 HOUR AS DATE) AS day, sum(price) AS s FROM fills GROUP BY 1, 2) c ON c.account_id = d.account_id AND c.day = d.snapshot_date"""),
    "duplicate_cleanup_plan": _sql("""
SELECT account_id, count(*) AS to_delete, CAST(sum(value_usd) AS DOUBLE) AS value_usd FROM (
  SELECT *, row_number() OVER (PARTITION BY account_id, l_orderkey, l_linenumber ORDER BY close_time DESC, value_usd DESC, l_partkey DESC, l_suppkey DESC) AS rn
  FROM (SELECT DISTINCT account_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, close_time, value_usd FROM closed)) WHERE rn > 1 GROUP BY 1"""),
    "fragment_cleanup_plan": _sql("""
SELECT account_id, symbol, side, order_id, stored_rows, matches, CASE WHEN matches = 1 THEN keep END AS keep_source_record_id, matches = 1 AS resolved, CASE WHEN matches = 1 THEN stored_rows - 1 ELSE 0 END AS to_delete
FROM (SELECT account_id, symbol, side, fill_id // 500 AS order_id, count(*) AS stored_rows, count(*) FILTER (fill_id % 7 = 0) AS matches, max('fill:' || fill_id) FILTER (fill_id % 7 = 0) AS keep FROM fills GROUP BY 1, 2, 3, 4)
WHERE stored_rows > 1"""),
    "cycle_rebuild_plan": f"WITH {VIEWS.strip()},{_REBUILD}" + """
SELECT CASE WHEN there THEN 'KEEP' WHEN n > 0 THEN 'MIGRATE' ELSE 'INSERT' END AS action, count(*) AS cycles, CAST(sum(CASE WHEN there THEN n ELSE greatest(n - 1, 0) END) AS BIGINT) AS legacy_to_delete
FROM planned GROUP BY 1""",
    "cycle_rebuild_unresolved": f"WITH {VIEWS.strip()},{_REBUILD}" + """
SELECT symbol, side, count(*) AS unresolved FROM legacy l
WHERE NOT EXISTS (SELECT 1 FROM wanted w WHERE w.base_id = l.base_id AND w.symbol = l.symbol AND w.side = l.side AND w.open_time = l.open_time) GROUP BY 1, 2""",
    "previous_leverage": _sql("""
SELECT side, count(coalesce(own, CASE WHEN same THEN lev END)) AS with_leverage, count(CASE WHEN same THEN margin END) AS with_margin, CAST(sum(CAST(CASE WHEN same THEN margin END AS DECIMAL(28,2))) AS DOUBLE) AS margin_used
FROM (SELECT c.side, CASE WHEN c.l_suppkey % 4 = 0 THEN c.leverage END AS own, p.lev, p.margin,
             coalesce(abs(epoch_us(c.open_time) - epoch_us(p.opened)) < 2000000, false) OR abs(epoch_us(TIMESTAMP '1998-06-01 00:02:00') - epoch_us(c.close_time)) < 300000000 AS same
      FROM closed c LEFT JOIN (SELECT account_id, symbol, side, min(open_time) AS opened, max(leverage) AS lev, max(value_usd) AS margin FROM closed WHERE l_linenumber >= 4 GROUP BY 1, 2, 3) p USING (account_id, symbol, side)
      WHERE c.l_linenumber < 4) GROUP BY 1"""),
    "trade_cycles_start_position": f"WITH {VIEWS.strip()},{_STATED}" + """
SELECT account_id, symbol, cycle, side, open_time, close_time, CASE WHEN complete THEN CAST(o_n AS DOUBLE) / CAST(oq AS DOUBLE) ELSE CAST(i_n AS DOUBLE) / CAST(cq AS DOUBLE) END AS entry_price,
       CAST(c_n AS DOUBLE) / CAST(cq AS DOUBLE) AS exit_price, CAST(max_size AS DOUBLE) AS max_size, CAST(pnl AS DOUBLE) AS realized_pnl, fee AS trading_fee, CAST(pnl AS DOUBLE) - fee AS net_pnl,
       CASE WHEN complete THEN 'COMPLETE' ELSE 'PARTIAL' END AS data_completeness FROM cyc WHERE close_time IS NOT NULL""",
}


_PAYLOADS = """
WITH p AS (SELECT user_id AS account_id, event_id, event_type, CASE WHEN event_id % 4 = 0 THEN 'BNB' ELSE 'USDT' END AS asset, make_timestamp_ms(epoch_us(ts) // 1000) AS record_time,
                  CAST(CASE WHEN event_id % 3 = 0 THEN -CAST(value AS DECIMAL(18,2)) ELSE CAST(value AS DECIMAL(18,2)) END AS DOUBLE) AS v FROM events)
"""
ORACLES |= {
    "venue_income_records": _PAYLOADS + """
SELECT account_id, CAST(event_id AS VARCHAR) AS source_record_id, asset, record_time,
       CASE event_type WHEN 'purchase' THEN 'REALIZED_PNL' WHEN 'view' THEN 'FUNDING_FEE' WHEN 'click' THEN 'TRADING_FEE' ELSE CASE WHEN v >= 0 THEN 'DEPOSIT' ELSE 'WITHDRAWAL' END END AS record_type,
       CASE WHEN event_type = 'click' THEN -v WHEN event_type = 'signup' THEN abs(v) ELSE v END AS amount_usd, asset = 'USDT' AS supported
FROM p WHERE event_type IN ('purchase', 'view', 'click', 'signup')""",
    "venue_bill_records": _PAYLOADS + """
SELECT account_id, asset, record_time, 'b' || event_id || ':' || suffix AS source_record_id, record_type, amount_usd FROM (
  SELECT *, 'funding' AS suffix, 'FUNDING_FEE' AS record_type, v AS amount_usd FROM p WHERE event_type = 'view'
  UNION ALL SELECT *, 'pnl', 'REALIZED_PNL', v FROM p WHERE event_type = 'purchase' AND v <> 0
  UNION ALL SELECT *, 'fee', 'TRADING_FEE', -v FROM p WHERE event_type IN ('purchase', 'click') AND v <> 0
  UNION ALL SELECT *, CASE WHEN v > 0 THEN 'deposit' ELSE 'withdrawal' END, CASE WHEN v > 0 THEN 'DEPOSIT' ELSE 'WITHDRAWAL' END, abs(v)
            FROM p WHERE v <> 0 AND event_type NOT IN ('view', 'purchase', 'click') AND NOT (event_type = 'signup' AND event_id % 5 = 0))""",
    "venue_transaction_records": _PAYLOADS + """
SELECT account_id, asset, record_time, event_id || ':' || suffix AS source_record_id, record_type, amount_usd FROM (
  SELECT *, 'pnl' AS suffix, 'REALIZED_PNL' AS record_type, v AS amount_usd FROM p WHERE event_type = 'purchase'
  UNION ALL SELECT *, 'funding', 'FUNDING_FEE', v FROM p WHERE event_type = 'view'
  UNION ALL SELECT *, 'fee', 'TRADING_FEE', v FROM p WHERE event_type = 'click'
  UNION ALL SELECT *, 'cash', CASE WHEN v > 0 THEN 'DEPOSIT' ELSE 'WITHDRAWAL' END, abs(v) FROM p WHERE event_type IN ('signup', 'error')) WHERE amount_usd <> 0""",
    "venue_category_positions": """
SELECT side, margin_mode, category, count(DISTINCT id) AS positions, CAST(sum(CAST(round(value, 4) AS DECIMAL(28,4))) AS DOUBLE) AS position_value_usd
FROM (SELECT CASE WHEN l_linestatus = 'O' THEN 'LONG' ELSE 'SHORT' END AS side, CASE WHEN l_suppkey % 2 = 0 THEN 'ISOLATED' ELSE 'CROSS' END AS margin_mode,
             CASE WHEN l_partkey % 4 = 0 THEN 'inverse' ELSE 'linear' END AS category, concat_ws('-', l_partkey, l_orderkey, l_linenumber) AS id, l_suppkey,
             abs(l_extendedprice) AS value
      FROM lineitem WHERE l_quantity <> 0
      QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey, l_orderkey, l_linenumber ORDER BY abs(l_extendedprice) DESC, l_linestatus) = 1) GROUP BY 1, 2, 3""",
}

#: Days are ISO text on both sides.
_DAYS = {"ledger_daily_preagg": "record_date", "pnl_account_days": "snapshot_date", "pnl_daily": "snapshot_date", "pnl_weekly": "period_start", "pnl_monthly": "period_start", "latest_asset_batch": "batch_day", "first_of_day_snapshots": "day", "affected_days_incremental": "record_date", "realized_income_first": "snapshot_date"}
ORACLES |= {name: f"SELECT * REPLACE (CAST({day} AS VARCHAR) AS {day}) FROM ({ORACLES[name]})" for name, day in _DAYS.items()}

# What is kept hangs on what was kept before, so these follow each key from one kept row to the next.
_KEPT = """
WITH RECURSIVE {views},
rows_ AS (SELECT account_id, t, min(id) AS id FROM ({rows}) GROUP BY 1, 2),
kept AS (
  SELECT account_id, min(t) AS t FROM rows_ GROUP BY 1
  UNION ALL
  SELECT k.account_id, min(r.t) FROM kept k JOIN rows_ r ON r.account_id = k.account_id AND r.t {after} k.t + INTERVAL {hours} HOUR GROUP BY k.account_id, k.t)
"""
ORACLES |= {
    "job_thinning": _KEPT.format(views=VIEWS.strip().rstrip(","), hours=6, after=">=", rows="SELECT account_id, started_at AS t, job_id AS id FROM jobs WHERE status = 'SUCCESS' AND job_id % 5 <> 0")
    + """
SELECT account_id, 'POSITIONS' AS job_type, t AS started_at, id AS job_id FROM kept JOIN rows_ USING (account_id, t)
UNION ALL SELECT account_id, 'FULL', started_at, job_id FROM jobs WHERE status = 'SUCCESS' AND job_id % 5 = 0""",
    "error_dedup": _KEPT.format(views=VIEWS.strip().rstrip(","), hours=24, after=">", rows="SELECT account_id, started_at AS t, job_id AS id FROM jobs WHERE status = 'FAILED'") + "SELECT account_id, t AS occurred_at FROM kept",
    "status_sticky": f"""
WITH RECURSIVE {VIEWS.strip().rstrip(",")},
steps AS (
  SELECT account_id, CASE WHEN status = 'FAILED' THEN 'PARTIAL' ELSE 'COMPLETE' END AS status, job_id % 7 = 0 AS sure, row_number() OVER (PARTITION BY account_id ORDER BY started_at, job_id) AS n FROM jobs),
walk AS (
  SELECT account_id, n, status FROM steps WHERE n = 1
  UNION ALL
  SELECT s.account_id, s.n, CASE WHEN w.status = 'PARTIAL' AND s.status = 'COMPLETE' AND NOT s.sure THEN 'PARTIAL' ELSE s.status END FROM walk w JOIN steps s ON s.account_id = w.account_id AND s.n = w.n + 1)
SELECT account_id, arg_max(status, n) AS status FROM walk GROUP BY 1""",
    "trade_cycles_hedge": f"""
WITH RECURSIVE {VIEWS.strip().rstrip(",")},
steps AS (
  SELECT account_id, symbol, p AS position_side, time, CAST(quantity AS DOUBLE) AS q, CAST(price AS DOUBLE) AS price, (p = 'LONG') = (side = 'BUY') AS opens,
         row_number() OVER (PARTITION BY account_id, symbol, p ORDER BY time, fill_id) AS n
  FROM (SELECT *, CASE WHEN fill_id % 3 = 0 THEN 'SHORT' ELSE 'LONG' END AS p FROM fills)),
walk AS (
  SELECT account_id, symbol, position_side, n, time, price, opens, q, 0.0::DOUBLE AS before, CASE WHEN opens THEN q ELSE 0 END AS after, 0 AS cycle FROM steps WHERE n = 1
  UNION ALL
  SELECT s.account_id, s.symbol, s.position_side, s.n, s.time, s.price, s.opens, s.q, w.after, CASE WHEN s.opens THEN w.after + s.q ELSE greatest(w.after - s.q, 0) END,
         w.cycle + CASE WHEN w.before > 0 AND w.after = 0 THEN 1 ELSE 0 END
  FROM walk w JOIN steps s ON s.account_id = w.account_id AND s.symbol = w.symbol AND s.position_side = w.position_side AND s.n = w.n + 1),
cyc AS (
  SELECT account_id, symbol, position_side, cycle, min(time) AS open_time, max(time) AS close_time, max(greatest(before, after)) AS max_size, sum(q) FILTER (opens) AS oq, sum(q * price) FILTER (opens) AS o_n,
         sum(before - after) FILTER (NOT opens) AS cq, sum((before - after) * price) FILTER (NOT opens) AS c_n, bool_or(before > 0 AND after = 0) AS ended
  FROM walk WHERE opens OR before > 0 GROUP BY 1, 2, 3, 4)
SELECT account_id, symbol, position_side, open_time, close_time, max_size, o_n / oq AS entry_price, c_n / cq AS exit_price,
       (c_n / cq - o_n / oq) * cq * CASE WHEN position_side = 'LONG' THEN 1 ELSE -1 END AS realized_pnl, 'COMPLETE' AS data_completeness FROM cyc WHERE ended
UNION ALL SELECT account_id, symbol, position_side, time, time, q, NULL, price, NULL, 'PARTIAL' FROM walk WHERE NOT opens AND before = 0""",
}
ORACLES |= _PAYLOAD_ORACLES
ORACLES |= upkeep_oracles(_sql, _FILLED, ORACLES)
ORACLES |= records_oracles(_sql, _RECONCILED.rstrip(), VIEWS, _CYCLES)
