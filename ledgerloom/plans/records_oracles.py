"""DuckDB SQL of the queries of raw payloads, pages, rates, retention and repairs."""

from __future__ import annotations

from .payload_oracles import _E, _SUMS

_TEXT = _E.rstrip() + """,
p AS (
  SELECT *, epoch_ms(t) AS ms,
    CASE WHEN event_id % 40 = 0 THEN 'NOT_JSON' WHEN event_id % 41 = 0 THEN 'NOT_AN_OBJECT' WHEN event_id % 43 = 0 OR event_id % 47 = 0 THEN 'NO_TEXT'
         WHEN event_id % 44 = 3 THEN 'MISSING symbol' WHEN event_id % 46 = 2 THEN 'TYPE utime' END AS reject FROM e)
"""
_CLOSED = _TEXT.rstrip() + """,
raw AS (
  SELECT *, CASE WHEN account_id % 2 = 0 THEN 'USDT-FUTURES' ELSE 'USDC-FUTURES' END AS product, coin || 'USDT' AS symbol, CASE WHEN event_id // 2 % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS side,
         CASE WHEN event_id % 4 = 0 THEN CAST(amount AS DOUBLE) ELSE 0 END AS stated
  FROM p WHERE reject IS NULL AND t BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-29'),
last AS (
  SELECT *, 'bitget:' || product || ':' || CASE WHEN event_id % 6 = 5 THEN 'symbol:' || symbol || ':' || ms ELSE 'p' || event_id // 2 END AS id FROM raw
  QUALIFY row_number() OVER (PARTITION BY account_id, id ORDER BY ms DESC, stated DESC, amount DESC) = 1),
held AS (
  SELECT *, event_id % 7 <> 0 AS whole, CASE WHEN event_id % 7 <> 0 THEN t - INTERVAL 1 HOUR ELSE TIMESTAMP '2024-01-02' END AS open_time FROM last),
orders AS (
  SELECT account_id, coin || 'USDT' AS symbol, t AS at, CASE WHEN account_id % 3 = 0 THEN 12.5 ELSE event_id % 2 * 5 END AS lev,
         CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'LONG' ELSE 'SHORT' END WHEN event_id // 2 % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS side FROM e WHERE event_id % 5 <> 1),
levered AS (
  SELECT h.account_id, h.id, CASE WHEN min(o.lev) = max(o.lev) THEN min(o.lev) END AS lev
  FROM held h JOIN orders o ON o.account_id = h.account_id AND o.symbol = h.symbol AND o.side = h.side AND o.lev > 0 AND (NOT h.whole OR o.at >= h.open_time - INTERVAL 300 SECOND AND o.at <= h.t) GROUP BY 1, 2),
parts AS (
  SELECT h.*, CAST(l.lev AS DOUBLE) AS leverage, CASE WHEN event_id % 5 = 0 THEN 4.0 ELSE CAST(size AS DOUBLE) END AS n,
         CASE WHEN event_id % 4 = 0 THEN CAST(amount AS DOUBLE) ELSE CAST(amount AS DOUBLE) + 0.25 - 0.75 END AS net
  FROM held h LEFT JOIN levered l USING (account_id, id))
"""


def records_oracles(sql, reconciled: str, views: str, cycles: str) -> dict[str, str]:
    return {
        "trade_cycles_stated": f"WITH {views.strip()},{cycles[: cycles.index('cycles AS (')].rstrip().rstrip(',')}" + """,
told AS (
  SELECT account_id, symbol, cycle, CAST(coalesce(sum(price - 50) FILTER (leg = 'close'), 0) AS DOUBLE) AS realized,
         CAST(coalesce(sum(CAST(CAST(fee AS DOUBLE) * (CAST(q AS DOUBLE) / CAST(quantity AS DOUBLE)) AS DECIMAL(24,8))) FILTER (fill_id % 9 <> 0), 0) AS DOUBLE) AS dollars, bool_and(fill_id % 9 <> 0 OR fee = 0) AS complete
  FROM legs GROUP BY 1, 2, 3),
priced AS (
  SELECT g.*, realized, dollars, complete, CASE WHEN complete AND oq > 0 THEN CAST(o_n AS DOUBLE) / CAST(oq AS DOUBLE) ELSE (CAST(c_n AS DOUBLE) - CASE side WHEN 'LONG' THEN realized ELSE -realized END) / CAST(cq AS DOUBLE) END AS entry_price
  FROM grouped g JOIN told USING (account_id, symbol, cycle) WHERE close_time IS NOT NULL)
SELECT account_id, symbol, 'binance:' || symbol || ':' || side || ':' || closing_fill_id AS source_record_id, side, open_time, close_time, entry_price, CAST(c_n AS DOUBLE) / CAST(cq AS DOUBLE) AS exit_price, CAST(max_size AS DOUBLE) AS max_size,
       realized AS realized_pnl, dollars AS trading_fee, realized - dollars AS net_pnl, CASE WHEN entry_price * CAST(max_size AS DOUBLE) <> 0 THEN realized / (entry_price * CAST(max_size AS DOUBLE)) * 100 ELSE 0 END AS return_percent, complete, 'PARTIAL' AS data_completeness
FROM priced""",
        "payload_rejects": _TEXT + "SELECT reject, count(*) AS payloads, min(event_id) AS first_id FROM p WHERE reject IS NOT NULL GROUP BY 1",
        "venue_closed_products": _CLOSED + """
SELECT account_id, id AS source_record_id, symbol, CASE WHEN coin = 'USDT' THEN 'USDT' ELSE coin END || '-USDT-PERP' AS normalized_symbol, side, open_time, t AS close_time, 10.0::DOUBLE AS average_entry_price, 11.0::DOUBLE AS average_exit_price,
       n AS max_position_size, CAST(amount AS DOUBLE) AS realized_pnl, 0.25::DOUBLE AS funding_fee, 0.75::DOUBLE AS trading_fee, round(net, 6) AS net_pnl, leverage, round(CASE WHEN leverage IS NULL THEN 0 ELSE 10 * n / leverage END, 6) AS margin_used,
       round(CASE WHEN 10 * n / leverage > 0 THEN net / (10 * n / leverage) * 100 WHEN n > 0 THEN CAST(amount AS DOUBLE) / (10 * n) * 100 ELSE 0 END, 6) AS return_percent, CASE WHEN whole THEN 'COMPLETE' ELSE 'PARTIAL' END AS data_completeness
FROM parts""",
        "venue_combos": """
SELECT account_id, source_record_id, 'LONG' AS side, shares * mark AS position_value_usd, mark AS mark_price
FROM (
  SELECT l_orderkey % 100 AS account_id, 'c' || l_orderkey AS source_record_id, CAST(l_orderkey % 5 AS DOUBLE) AS shares,
         CASE WHEN bool_or(l_linestatus <> 'F' AND l_partkey % 4 = 0) THEN 0.5 WHEN l_orderkey % 3 = 0 THEN 1 - product(p) ELSE product(p) END AS mark
  FROM (SELECT *, CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE (l_partkey % 4) / 4.0::DOUBLE END AS p FROM lineitem) GROUP BY l_orderkey)
WHERE shares > 0""",
        "venue_futures_holdings": _E + f"""
SELECT asset, price_source, count(*) AS n, {_SUMS} FROM (
  SELECT coin AS asset, 1.0 AS available, greatest(CAST(size AS DOUBLE) - 1, 0) AS locked,
         CASE WHEN event_id % 4 = 0 THEN CAST(size AS DOUBLE) ELSE CAST(size AS DOUBLE) * CASE coin WHEN 'USDT' THEN 1.0 WHEN 'BNB' THEN 300.0 WHEN 'ETH' THEN 2000.5 END END AS value_usd,
         CASE WHEN event_id % 4 = 0 THEN 'USDT_EQUITY' WHEN coin = 'USDT' THEN 'STABLECOIN_PARITY' ELSE 'SPOT_TICKER' END AS price_source FROM e) GROUP BY 1, 2""",
        "converted_equity": sql("""
, quotes AS (
  SELECT CASE event_type WHEN 'view' THEN 'USD/CNY' ELSE 'USD/EUR' END AS pair, 6 + value / 1000 AS rate, ts AS quoted_at FROM events
  WHERE event_type = 'view' OR event_type = 'click' AND ts >= TIMESTAMP '2024-01-10'),
single AS (SELECT pair, quoted_at, max(rate) AS rate FROM quotes GROUP BY 1, 2),
asked AS (SELECT *, ['USD/CNY', 'USD/EUR', 'USD/JPY', 'USD/XXX'][snapshot_id % 4 + 1] AS pair FROM snapshots),
found AS (SELECT a.*, q.rate AS quoted, q.quoted_at FROM asked a ASOF LEFT JOIN single q ON a.pair = q.pair AND a.recorded_at >= q.quoted_at),
rated AS (SELECT *, coalesce(quoted, CASE pair WHEN 'USD/JPY' THEN 150.0 WHEN 'USD/EUR' THEN 0.9 END) AS used FROM found)
SELECT snapshot_id, pair, used AS rate, CASE WHEN quoted IS NULL THEN CASE WHEN used IS NOT NULL THEN 'DEFAULT' END WHEN epoch_us(recorded_at) - epoch_us(quoted_at) <= 300000000 THEN 'QUOTE' ELSE 'STALE' END AS rate_source,
       CAST(equity AS DOUBLE) * used AS converted FROM rated"""),
        "snapshots_page": sql("""
, shown AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS snapshot_id, c.account_id, symbol, side, CAST(size AS DOUBLE) AS size, close_time AS recorded_at
  FROM closed c JOIN accounts a USING (account_id) WHERE a.is_active AND a.exchange = 'ASIA' AND symbol ILIKE '%brand#2%' AND close_time >= TIMESTAMP '1996-01-01' AND close_time <= TIMESTAMP '1997-01-01')
SELECT *, (SELECT count(*) FROM shown) AS total FROM shown ORDER BY recorded_at DESC, snapshot_id LIMIT 40 OFFSET 80"""),
        "history_page": sql("""
, shown AS (
  SELECT account_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, close_time, CAST(net_pnl AS DOUBLE) AS net_pnl FROM trades
  WHERE close_time >= tracking_started_at AND exchange = 'AMERICA' AND net_pnl < 0 AND l_linenumber % 2 = 0)
SELECT *, (SELECT count(*) FROM shown) AS total FROM shown ORDER BY close_time DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, account_id LIMIT 30 OFFSET 30"""),
        "job_retention": sql("""
SELECT status, count(*) AS jobs, min(job_id) AS first_id, max(started_at) AS latest_at FROM jobs WHERE started_at < TIMESTAMP '2024-01-21' AND status <> 'RUNNING' GROUP BY 1"""),
        "closed_quality_issues": sql("""
, rated AS (
  SELECT leverage * 40 - 40 AS lev, CAST(margin AS DOUBLE) AS m, CAST(net_pnl AS DOUBLE) AS n, CASE WHEN l_linenumber = 3 THEN 1.5 ELSE CAST(net_pnl AS DOUBLE) / CAST(margin AS DOUBLE) * 100 END AS r
  FROM (SELECT *, CAST(value_usd / leverage AS DECIMAL(18,2)) AS margin FROM closed) WHERE margin > 0)
SELECT * FROM (
  SELECT 'INVALID_HISTORICAL_LEVERAGE' AS code, 'WARNING' AS severity, count(*) AS issues FROM rated WHERE lev <= 0 OR lev > 200
  UNION ALL SELECT 'HISTORICAL_RETURN_MISMATCH', 'ERROR', count(*) FROM rated WHERE abs(r - n / m * 100) > 0.01) WHERE issues > 0"""),
        "calendar_rebuild": sql("""
, utc AS (
  SELECT account_id, CAST(record_time AS DATE) AS day, count(*) AS records, coalesce(sum(amount_usd) FILTER (record_type = 'FUNDING_FEE'), 0) AS funding, max(record_time) AS updated_at FROM ledger GROUP BY 1, 2),
moved AS (SELECT *, CAST(updated_at + INTERVAL 8 HOUR AS DATE) AS to_day FROM utc),
last AS (SELECT account_id, to_day, max(updated_at) AS updated_at, arg_max(records, updated_at) AS records, arg_max(funding, updated_at) AS funding, bool_or(to_day <> day) AS arrived FROM moved GROUP BY 1, 2),
days AS (SELECT account_id, CAST(record_time + INTERVAL 8 HOUR AS DATE) AS day, coalesce(sum(amount_usd) FILTER (record_type = 'FUNDING_FEE'), 0) AS funding FROM ledger GROUP BY 1, 2)
SELECT l.account_id, CAST(l.to_day AS VARCHAR) AS snapshot_date, l.records, CAST(CASE WHEN arrived THEN coalesce(d.funding, l.funding) ELSE l.funding END AS DOUBLE) AS funding_fee, l.updated_at, CAST(2 AS BIGINT) AS version
FROM last l LEFT JOIN days d ON d.account_id = l.account_id AND d.day = l.to_day"""),
        "reconciliation_unrealized": f"WITH {views.strip()},{reconciled.replace('FROM closed GROUP BY 1)', 'FROM trades GROUP BY 1)')}" + """
, hours AS (SELECT account_id, date_trunc('hour', recorded_at) AS hour_, sum(equity) AS total FROM snapshots WHERE date_trunc('hour', recorded_at) <= TIMESTAMP '2024-01-31' GROUP BY 1, 2),
ends AS (SELECT account_id, CAST(arg_max(total, hour_) - arg_min(total, hour_) AS DOUBLE) AS change FROM hours GROUP BY 1)
SELECT account_id, round(equity_return, 4) AS equity_return, round(component_return + coalesce(change, 0), 4) AS component_return, round(equity_return - component_return - coalesce(change, 0), 4) AS variance
FROM rec LEFT JOIN ends USING (account_id)""",
    }
