"""SQL of the operators that SQL can express, for DuckDB."""

from __future__ import annotations

from skyroute.llm.divergence import DIVERGENCE_SQL
from skyroute.llm.ranked_search import RANKED_SQL
from skyroute.llm.sharding import sharding_sql
from skyroute.llm.url_filter import url_filter_sql

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

JACCARD = f"""
WITH RECURSIVE words AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '{_SPACED}'), []) w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4])) WHEN len(w) > 0 THEN [w] ELSE [] END s FROM words),
sized AS (SELECT doc_id, len(s) n, s FROM sets),
rows_ AS (SELECT doc_id, n, unnest(s) x FROM sized),
links AS (
  SELECT a.doc_id a, b.doc_id b FROM rows_ a JOIN rows_ b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
reach AS (SELECT doc_id a, doc_id b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT s.doc_id, CAST(s.n AS BIGINT) n_shingles, c.component_id FROM sized s JOIN (SELECT a doc_id, min(b) component_id FROM reach GROUP BY a) c USING (doc_id)"""

REPEATS = f"""
WITH words AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{_SPACED}'), []) w FROM documents),
spot AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) i FROM words WHERE len(w) >= 13),
win AS (SELECT doc_id, i, w[i:i + 12] x FROM spot),
first_ AS (SELECT x, min(doc_id) f FROM win GROUP BY x),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) g FROM win JOIN first_ USING (x) WHERE f < doc_id GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(len(g), 0) AS BIGINT) n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda v, i: NOT coalesce(list_contains(g, i), FALSE)), ' '), '')) kept_sha256
FROM words LEFT JOIN gone USING (doc_id)"""

CONTAMINATION = f"""
WITH words AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '{_ALNUM}'), []) w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) item, regexp_extract_all({_LOWER}, '{_ALNUM}') w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
pat AS (
  SELECT DISTINCT item, least(len(w), 10) m, w[i:i + least(len(w), 10) - 1] x FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i FROM items WHERE len(w) > 0)
),
spot AS (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) i FROM words, (SELECT DISTINCT m FROM pat) WHERE len(w) >= m),
hits AS (SELECT doc_id, i, a.m, item FROM (SELECT doc_id, i, m, w[i:i + m - 1] x FROM spot) a JOIN pat p ON a.x = p.x),
per AS (
  SELECT doc_id, len(list_distinct(flatten(list(range(i, i + m))))) n_hit, count(DISTINCT item) n_items, list_sort(list(DISTINCT item)) found FROM hits GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items,
  sha256(coalesce(array_to_string(found, ','), '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM words LEFT JOIN per USING (doc_id)"""

_DIGIT = " + ".join(f"{16 >> k} * CAST(substr(bits, i * 5 + {k + 1}, 1) AS INTEGER)" for k in range(5))
ARCHIVES = f"""
WITH p AS (SELECT page_id, coalesce(html, '') h FROM pages WHERE page_id IS NOT NULL),
k AS (SELECT h, max(page_id) keep, CAST(CAST(unhex(sha1(h)) AS BIT) AS VARCHAR) bits FROM p GROUP BY h)
SELECT page_id, CAST(strlen(h) AS BIGINT) payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST({_DIGIT} + 1 AS BIGINT), 1)), '') payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END record_type, CASE WHEN page_id <> keep THEN keep END refers_to
FROM p JOIN k USING (h)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_jaccard_join": JACCARD,
        "op2_substring_dedup": REPEATS,
        "op3_url_filter": url_filter_sql(),
        "op6_decontaminate": CONTAMINATION,
        "op7_warc": ARCHIVES,
        "op11_ranked_search": RANKED_SQL,
        "op12_divergence": DIVERGENCE_SQL,
        "op13_sharding": sharding_sql(),
    }
