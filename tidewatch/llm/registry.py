"""The registered queries of this package and their SQL."""

from __future__ import annotations

from tidewatch.llm import decontaminate, langid, mixing, neardup, pii, quality, rules, secrets, tokens, urls

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_neardup": neardup.op2_neardup,
    "op3_quality": quality.op3_quality,
    "op4_mix": mixing.op4_mix,
    "op5_urls": urls.op5_urls,
    "op6_rules": rules.op6_rules,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_langid": langid.op8_langid,
    "op9_tokens": tokens.op9_tokens,
    "op10_pii": pii.op10_pii,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Links by full shingle sets of all pairs that share a shingle, components by recursion.
OP2 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS sh
  FROM w),
g AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS i
  FROM g a JOIN g b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY ALL),
l AS (SELECT a, b FROM c WHERE 100 * i >= 85 * (na + nb - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = s.doc_id
"""

_DAY = "TIMESTAMP '2024-01-01' + to_days(CAST({} AS INT))"

OP5 = rf"""
WITH p AS (
  SELECT page_id, url, {_DAY.format("page_id % 360")} AS fetched_at,
    nullif(lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@\[\]]+)', 1), '\.+$', '')), '') AS host,
    lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/+', '/', 'g')) AS path
  FROM pages),
h AS (SELECT DISTINCT host, CAST('0x' || substr(md5(host), 1, 6) AS BIGINT) AS c FROM p WHERE host IS NOT NULL),
t AS (
  SELECT 'spam' AS list, host AS entry, '' AS prefix, {_DAY.format("c % 200")} AS since,
    CASE WHEN c % 2 = 0 THEN {_DAY.format("c % 200 + 60")} END AS until FROM h WHERE c % 3 = 0
  UNION ALL SELECT 'spam', host, '', {_DAY.format("c % 200 + 120")}, NULL FROM h WHERE c % 3 = 0 AND c % 4 = 0
  UNION ALL SELECT 'geo', host, '/de', {_DAY.format("c % 100")}, {_DAY.format("c % 100 + 90")} FROM h WHERE c % 3 = 1
  UNION ALL SELECT 'sector', 'example.org', '', {_DAY.format("300")}, NULL
    FROM (SELECT 1 FROM h WHERE host LIKE '%.example.org' LIMIT 1)),
m AS (
  SELECT p.page_id, count(DISTINCT t.entry || t.prefix) AS n, string_agg(DISTINCT t.list, ',' ORDER BY t.list) AS lists
  FROM p JOIN t ON (p.host = t.entry OR p.host LIKE '%.' || t.entry)
    AND (t.prefix = '' OR p.path = t.prefix OR starts_with(p.path, t.prefix || '/'))
    AND t.since <= p.fetched_at AND (t.until IS NULL OR p.fetched_at < t.until)
  GROUP BY p.page_id)
SELECT p.page_id, p.host, p.fetched_at, CAST(coalesce(m.n, 0) AS BIGINT) AS n_entries,
  coalesce(m.lists, '') AS lists, m.n IS NOT NULL AS blocked
FROM p LEFT JOIN m USING (page_id)
"""

_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS k, array_to_string(w[i : i + least(len(w), 8) - 1], ' ') AS x
  FROM b, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS u(i) WHERE len(w) > 0),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS x
  FROM d, (SELECT DISTINCT k FROM bw) ks, unnest(range(1, len(w) - k + 2)) AS u(i)),
h AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.x = bw.x),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM h, unnest(range(i, i + k)) AS u(j) GROUP BY doc_id),
m AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

ORACLE_SQL = {"op2_neardup": OP2, "op5_urls": OP5, "op7_decontaminate": OP7}
