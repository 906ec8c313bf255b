"""DuckDB SQL for the queries of venue payloads."""

from __future__ import annotations

_E = """
WITH e AS (
  SELECT user_id AS account_id, event_id, event_type AS kind, CAST(value AS DECIMAL(18,2)) AS size, ['BNB', 'USDT', 'ETH', 'XYZ'][event_id % 4 + 1] AS coin,
         CASE WHEN event_id % 3 = 0 THEN -CAST(value AS DECIMAL(18,2)) ELSE CAST(value AS DECIMAL(18,2)) END AS amount, make_timestamp_ms(epoch_us(ts) // 1000) AS t FROM events)
"""
_VALUED = _E.rstrip() + """,
b AS (SELECT account_id, coin AS asset, CAST(size AS DOUBLE) AS available, CASE WHEN event_id % 5 = 0 THEN 1.5 ELSE 0.0 END::DOUBLE AS locked FROM e),
v AS (SELECT *, CASE asset WHEN 'USDT' THEN available + locked WHEN 'BNB' THEN (available + locked) * 300 WHEN 'ETH' THEN (available + locked) * 2000.5 END AS value_usd,
             CASE asset WHEN 'USDT' THEN 'STABLECOIN_PARITY' WHEN 'XYZ' THEN 'UNAVAILABLE' ELSE 'EXCHANGE_PRICE' END AS price_source FROM b)
"""
_SUMS = ", ".join(f"CAST(sum(CAST(round({c}, 4) AS DECIMAL(28,4))) AS DOUBLE) AS {c}" for c in ("available", "locked", "value_usd"))
_A, _S = "CAST(amount AS DOUBLE)", "CAST(size AS DOUBLE)"
ORACLES: dict[str, str] = {
    "venue_valued_balances": _VALUED + f"SELECT asset, price_source, count(*) AS n, {_SUMS} FROM v GROUP BY 1, 2",
    "venue_account_summary": _VALUED + "SELECT account_id, round(sum(value_usd), 3) AS total_equity_usd, count(*) FILTER (value_usd IS NULL AND (available <> 0 OR locked <> 0)) AS unvalued_asset_count FROM v GROUP BY 1",
    "venue_open_positions": _E + f"""
SELECT account_id, coin || 'USDT' AS symbol, coin || '-USDT-PERP' AS normalized_symbol, CASE WHEN amount > 0 THEN 'LONG' ELSE 'SHORT' END AS side, {_S} AS position_size, 2.5 AS entry_price, 3.0 AS mark_price,
       {_S} * 3 AS position_value_usd, CAST(event_id % 20 AS DOUBLE) AS leverage, {_A} AS unrealized_pnl FROM e WHERE event_id % 7 <> 0 AND amount <> 0""".replace("coin || '-USDT-PERP'", "CASE WHEN coin = 'USDT' THEN 'USDT' ELSE coin END || '-USDT-PERP'"),
    "venue_contract_positions": _E + f"""
SELECT account_id, CASE WHEN event_id % 2 = 0 THEN 'p' || event_id ELSE coin || '-USDT-SWAP:' || s END AS source_record_id, coin || '-USDT-SWAP' AS symbol, coin || '-USDT-PERP' AS normalized_symbol,
       CASE WHEN s = 'long' THEN 'LONG' WHEN s = 'short' THEN 'SHORT' WHEN amount < 0 THEN 'SHORT' ELSE 'LONG' END AS side, q AS position_size, q * 4 AS position_value_usd, 5.0 AS entry_price, 4.0 AS mark_price,
       CAST(NULL AS DOUBLE) AS liquidation_price, 10.0 AS leverage, 'ISOLATED' AS margin_mode, CASE WHEN event_id % 6 = 0 THEN 7.0 ELSE q * 5 / 10 END AS margin_used, {_A} AS unrealized_pnl
FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 25.0 ELSE abs({_A}) END AS q, CASE event_id % 4 WHEN 0 THEN 'long' WHEN 1 THEN 'short' ELSE 'net' END AS s FROM e) WHERE amount <> 0""",
    "venue_closed_history": _E + f"""
SELECT account_id, 'okx:' || k || ':' || k * 1000 AS source_record_id, 'BTC-USDT-SWAP' AS symbol, 'BTC-USDT-PERP' AS normalized_symbol, CASE WHEN k % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS side,
       make_timestamp_ms(k * 1000) AS open_time, make_timestamp_ms(event_id * 1000) AS close_time, 10.0 AS average_entry_price, 11.0 AS average_exit_price, {_S} AS max_position_size, {_A} AS realized_pnl,
       0.25 AS funding_fee, 0.5 AS trading_fee, {_A} AS net_pnl, abs({_A} / 0.1) AS margin_used
FROM (SELECT *, event_id // 3 AS k FROM e) QUALIFY row_number() OVER (PARTITION BY account_id, k ORDER BY event_id DESC) = 1""",
    "venue_product_positions": _E + f"""
SELECT account_id, p || ':' || coin || 'USDT:' || h AS source_record_id, coin || 'USDT' AS symbol, coin || '-USDT-PERP' AS normalized_symbol, upper(h) AS side, {_S} AS position_size, {_S} * 2 AS position_value_usd,
       1.5 AS entry_price, 2.0 AS mark_price, CASE WHEN event_id % 4 <> 0 THEN 1.0 END AS liquidation_price, 3.0 AS leverage, 'CROSS' AS margin_mode, 9.0 AS margin_used, {_A} AS unrealized_pnl
FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'USDT-FUTURES' ELSE 'USDC-FUTURES' END AS p, CASE WHEN event_id % 3 = 0 THEN 'short' ELSE 'long' END AS h FROM e) WHERE event_id % 5 <> 0 AND size <> 0""",
    "venue_business_records": _E + f"""
SELECT account_id, CASE WHEN event_id % 10 = 1 THEN 'USD' ELSE 'USDT' END AS asset, t AS record_time, 'b' || event_id || ':' || suffix AS source_record_id, record_type, amount_usd FROM (
  SELECT *, CASE kind WHEN 'purchase' THEN 'pnl' WHEN 'view' THEN 'funding' ELSE 'cash' END AS suffix,
         CASE kind WHEN 'purchase' THEN 'REALIZED_PNL' WHEN 'view' THEN 'FUNDING_FEE' WHEN 'signup' THEN 'DEPOSIT' ELSE 'WITHDRAWAL' END AS record_type,
         CASE WHEN kind IN ('signup', 'error') THEN abs({_A}) ELSE {_A} END AS amount_usd FROM e WHERE kind <> 'click' AND amount <> 0
  UNION ALL SELECT *, 'fee', 'TRADING_FEE', -0.75 FROM e WHERE event_id % 4 = 0) WHERE event_id % 10 <> 0""",
    "venue_business_complete": _E + "SELECT account_id, bool_and(event_id % 10 <> 0 AND (amount = 0 OR kind <> 'click' OR event_id % 4 = 0)) AS complete FROM e GROUP BY 1",
    "venue_closed_orders": _E + f"""
SELECT account_id, CAST(event_id AS VARCHAR) AS source_record_id, 'ETHUSDC' AS symbol, 'ETH-USDC-PERP' AS normalized_symbol, CASE WHEN l THEN 'LONG' ELSE 'SHORT' END AS side, t - INTERVAL 1 SECOND AS open_time, t AS close_time,
       10.0 AS average_entry_price, 12.5 AS average_exit_price, 4.0 AS max_position_size, g AS realized_pnl, {_A} - g + 0.75 AS funding_fee, 0.75 AS trading_fee, {_A} AS net_pnl,
       CASE WHEN event_id % 3 <> 0 THEN 5.0 END AS margin_used, CASE WHEN event_id % 3 <> 0 THEN {_A} / 5 * 100 END AS return_percent
FROM (SELECT *, event_id % 2 = 0 AS l, CASE WHEN event_id % 2 = 0 THEN 10.0 ELSE -10.0 END AS g FROM e)""",
    "venue_wallet_updates": _E + f"""
SELECT account_id, 'h' || event_id AS source_record_id, t AS record_time, record_type, abs({_S}) AS amount_usd FROM (
  SELECT *, CASE WHEN kind = 'signup' OR (event_id % 2 <> 0 AND kind <> 'click') THEN 'DEPOSIT' WHEN kind = 'error' OR event_id % 2 = 0 THEN 'WITHDRAWAL' END AS record_type FROM e) WHERE record_type IS NOT NULL""",
    "venue_perp_positions": _E + f"""
SELECT account_id, c || ':' || s AS source_record_id, c AS symbol, coin || '-USDC-PERP' AS normalized_symbol, s AS side, {_S} AS position_size, 50.0 AS position_value_usd, 3.0 AS entry_price, 50.0 / {_S} AS mark_price,
       CAST(NULL AS DOUBLE) AS liquidation_price, 5.0 AS leverage, CASE WHEN event_id % 4 = 0 THEN 'CROSS' ELSE 'ISOLATED' END AS margin_mode, 6.0 AS margin_used, {_A} AS unrealized_pnl
FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'xyz:' ELSE '' END || coin AS c, CASE WHEN amount < 0 THEN 'SHORT' ELSE 'LONG' END AS s FROM e) WHERE event_id % 9 <> 0 AND amount <> 0""",
    "venue_token_balances": _E + f"""
SELECT asset, price_source, count(*) AS n, {_SUMS} FROM (
  SELECT coin AS asset, {_S} AS available, 0.0 AS locked, CASE coin WHEN 'ETH' THEN {_S} * 2000.5 WHEN 'XYZ' THEN NULL ELSE {_S} END AS value_usd,
         CASE WHEN coin IN ('USDT', 'BNB') THEN 'STABLECOIN_PARITY' ELSE 'SPOT_MARK' END AS price_source FROM e WHERE event_id % 6 <> 0 AND size <> 0) GROUP BY 1, 2""",
    "venue_wallet_balances": _E + f"""
SELECT account_id, CASE WHEN event_id % 8 = 1 THEN 'UNKNOWN' ELSE coin END AS asset, 'UNIFIED' AS account_type, greatest({_S} - 1.5, 0) AS available, 1.5 AS locked, CASE WHEN event_id % 3 = 0 THEN 0 ELSE {_S} END AS value_usd FROM e""",
    "venue_wallet_summary": _E + "SELECT account_id, 12.5 AS total_equity_usd, 3.0 AS available_balance_usd, 0.0 AS margin_balance_usd, -1.0 AS unrealized_pnl_usd, count(*) FILTER (event_id % 3 = 0) AS unvalued_asset_count FROM e GROUP BY account_id, CAST(t AS DATE)",
    "venue_detail_balances": _E + f"SELECT account_id, coin AS asset, 'UNIFIED' AS account_type, {_S} AS available, 0.25 AS locked, {_S} AS value_usd FROM e",
    "venue_spot_holdings": _E + f"""
SELECT asset, price_source, count(*) AS n, count(price_usd) AS priced, {_SUMS} FROM (
  SELECT coin AS asset, {_S} AS available, 1.0 AS locked, p, CASE WHEN event_id % 5 = 0 THEN 40.0 ELSE ({_S} + 1) * p END AS value_usd, CASE WHEN event_id % 5 = 0 THEN 40.0 / ({_S} + 1) ELSE p END AS price_usd,
         CASE WHEN event_id % 5 = 0 THEN 'USDT_VALUE' WHEN coin = 'USDT' THEN 'STABLECOIN_PARITY' ELSE 'SPOT_TICKER' END AS price_source
  FROM (SELECT *, CASE coin WHEN 'USDT' THEN 1.0 WHEN 'BNB' THEN 300.0 WHEN 'ETH' THEN 2000.5 END AS p FROM e)) GROUP BY 1, 2""",
    "venue_predictions": _E + f"""
SELECT account_id, CASE WHEN event_id % 2 = 0 THEN 'asset-number-' || event_id ELSE '0xcondition-of-market-' || event_id END AS source_record_id,
       CASE WHEN length(d) > 80 THEN d[1:77] || '...' ELSE d END AS symbol,
       'POLY-condition-of-mar-' || event_id % 2 || '-' || CASE WHEN event_id % 2 = 0 THEN right('asset-number-' || event_id, 12) ELSE '' END AS normalized_symbol,
       'PREDICTION' AS market_type, 'LONG' AS side, {_S} AS position_size, {_S} AS position_value_usd, 0.5 AS entry_price, 0.75 AS mark_price, 'CASH' AS margin_mode, 3.0 AS margin_used, {_A} AS unrealized_pnl, 0.0 AS realized_pnl
FROM (SELECT *, trim(CASE WHEN event_id % 3 = 0 THEN 'Polymarket' ELSE 'Will it happen ' || repeat('again ', CAST(event_id % 20 AS INT)) END) || ' · ' || CASE WHEN event_id % 5 = 0 THEN 'Yes' ELSE 'Outcome ' || event_id % 2 END AS d FROM e)
WHERE event_id % 7 <> 0 AND size > 0""",
    "closed_identity_upsert": """
WITH line AS (SELECT l_suppkey AS account_id, l_orderkey % 500 AS a, l_partkey % 20 AS b, CAST(l_linenumber AS VARCHAR) AS n, l_shipdate AS close_time, CAST(l_extendedprice AS DECIMAL(18,2)) AS net_pnl FROM lineitem),
every AS (
  SELECT account_id, CASE WHEN a % 2 = 0 THEN 'okx:' || a || ':' || b WHEN b = 3 THEN 'bitget:' || a || ':symbol:' || n ELSE 'bitget:' || a || ':' || b END AS source_record_id, close_time, net_pnl, 0 AS fresh FROM line
  UNION ALL SELECT account_id, 'okx:' || a || ':' || b, close_time, net_pnl + 1, 1 FROM line WHERE b < 5 AND a % 2 = 0)
SELECT account_id, source_record_id, close_time, CAST(net_pnl AS DOUBLE) AS net_pnl FROM every
QUALIFY row_number() OVER (PARTITION BY account_id, source_record_id ORDER BY fresh DESC, close_time DESC, every.net_pnl DESC) = 1""",
    "pnl_model_upsert": """
SELECT r_name AS exchange, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) + 1 AS total, count(*) AS version
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'AMERICA', 'AFRICA') GROUP BY 1""",
    "oldest_streams": """
SELECT min(CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '2023-12-31 23:59:00' ELSE at_ END) AS last_updated_at, min(at_) AS positions_updated_at
FROM (SELECT c_custkey, TIMESTAMP '2024-01-01' + to_minutes(CAST(c_custkey % 1000 AS BIGINT)) AS at_ FROM customer WHERE c_acctbal >= 0)""",
    "accounts_in_order": """
SELECT row_number() OVER (ORDER BY is_demo DESC, made, account_id) AS place, account_id, is_demo, CAST(made AS VARCHAR) AS created_at, exchange
FROM (SELECT c_custkey AS account_id, c_custkey % 10 = 0 AS is_demo, CAST(DATE '2024-01-01' + CAST(c_custkey % 97 AS INTEGER) AS DATE) AS made, r_name AS exchange
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal >= 0) ORDER BY place""",
}
