"""DuckDB SQL for the queries that SQL can express."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"

ORACLES: dict[str, str] = {
    "op1_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
""",
    "base_pii_counts": rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (
  SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email,
         regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ips,
         list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: {_DIGITS}) AS cards,
         list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: len({_DIGITS})) AS phones FROM t)
SELECT doc_id, n_email, len(list_filter(ips, lambda x: len(list_filter(string_split(x, '.'), lambda p: len(ltrim(p, '0')) > 3 OR CAST('0' || right(p, 3) AS INTEGER) > 255)) = 0)) AS n_ip,
       len(list_filter(cards, lambda x: len(x) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, len(x) + 1), lambda i:
         CASE WHEN i % 2 = 1 THEN CAST(x[len(x) + 1 - i] AS INTEGER) ELSE CAST(x[len(x) + 1 - i] AS INTEGER) * 2 - CASE WHEN CAST(x[len(x) + 1 - i] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0)) AS n_card,
       len(list_filter(phones, lambda n: n BETWEEN 9 AND 15)) AS n_phone
FROM found
""",
    "base_token_bytes": "SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes FROM documents",
    "base_shingle_counts": f"""
WITH t AS (SELECT doc_id, list_transform({_WORDS}, lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents)
SELECT doc_id, CAST(CASE WHEN len(w) < 5 THEN least(len(w), 1) ELSE len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS BIGINT) AS n_shingles FROM t
""",
    "base_mix_sizes": f"""
SELECT doc_id, size, CAST(sum(size) OVER (PARTITION BY source) AS BIGINT) AS source_size FROM (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents)
""",
    "base_quality_rules": f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
windows AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)),
again AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, x) > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM (SELECT rid, i, unnest(range(0, 5)) AS k FROM again) GROUP BY 1),
counted AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0) AS word_chars, len(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words FROM t LEFT JOIN covered USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted
""",
}
