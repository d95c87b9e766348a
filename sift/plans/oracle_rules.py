"""DuckDB oracle SQL for the rule queries."""

from __future__ import annotations

from sift.plans.fixtures import REGISTRY_SQL, SEEN_SQL
from sift.plans.oracle_curation import SCORED
from sift.plans.sqltext import with_canonical

WORDS = ("['blog','news','archive','archives','posts','articles','category','categories','tag','tags',"
         "'topics','papers','research','index','latest']")

CANDIDATES = f"""
SELECT CAST(page_id AS VARCHAR) AS cand_id, 'page' AS kind, url FROM pages
UNION ALL SELECT CAST(page_id AS VARCHAR), 'root', regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/' FROM pages
UNION ALL SELECT CAST(page_id AS VARCHAR), 'blog', regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/blog' FROM pages
UNION ALL SELECT CAST(page_id AS VARCHAR), 'news', regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/'
       || regexp_extract(url, '^https?://[^/?#]+/([^/?#]+)', 1) || '/news/' FROM pages
UNION ALL SELECT slug, 'site', site_url FROM ({REGISTRY_SQL}) r
"""

PATH = "regexp_extract(canonical_url, '^(?:[a-z][a-z0-9+.\\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


def specificity_sql(src: str) -> str:
    sites = f"SELECT DISTINCT canonical_url AS site FROM ({with_canonical(REGISTRY_SQL, 'site_url')}) s WHERE site_url IS NOT NULL"
    return f"""
SELECT c.*, CASE WHEN regexp_replace({PATH}, '/', '', 'g') = '' THEN 'homepage'
                 WHEN s.site IS NOT NULL THEN 'registry_site'
                 WHEN list_contains({WORDS}, lower(regexp_extract({PATH}, '([^/]*)/*$', 1))) THEN 'section' END AS reason
FROM ({with_canonical(src, 'url')}) c LEFT JOIN ({sites}) s ON s.site = c.canonical_url
"""


SPECIFICITY = f"SELECT cand_id, kind, url, canonical_url, reason FROM ({specificity_sql(CANDIDATES)}) t"

MAX_AGE = """
SELECT o_orderkey, o_orderpriority = '1-URGENT' AS landmark FROM orders
WHERE o_orderdate IS NULL OR o_orderdate >= TIMESTAMP '2001-08-01 00:00:00' - INTERVAL 12 MONTH
   OR o_orderpriority = '1-URGENT'
"""

STYLE = """
SELECT source, lang, count(*) AS n_docs, sum(hits) AS banned_hits, sum(dashes) AS dashes,
       count(*) FILTER (WHERE dashes >= 3) AS n_dash_overuse
FROM (SELECT source, lang,
             CAST(len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'),
                                  lambda w: w IN ('delve', 'paradigm'))) AS INTEGER) AS hits,
             CAST(len(regexp_extract_all(text, '[—–]| -- | - ')) AS INTEGER) AS dashes
      FROM documents) d
GROUP BY source, lang
"""

BOOST = """
SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS n_trending,
       count(*) FILTER (WHERE event_type = 'click') AS n_discussed,
       CASE WHEN count(*) FILTER (WHERE event_type = 'view') > 0 AND count(*) FILTER (WHERE event_type = 'click') > 0
            THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS boost
FROM events GROUP BY user_id
"""

FUNNEL = f"""
WITH it AS ({specificity_sql(SCORED)}),
seen AS (SELECT DISTINCT canonical_url FROM ({with_canonical(SEEN_SQL, 'url')}) s),
j AS (SELECT it.*, s.canonical_url IS NOT NULL AS was_seen,
             CAST(it.date AS DATE) >= DATE '2026-03-17' - INTERVAL 30 DAY AS recent
      FROM it LEFT JOIN seen s ON s.canonical_url = it.canonical_url)
SELECT source_name, count(*) AS parsed,
       count(*) FILTER (WHERE recent) AS recent,
       count(*) FILTER (WHERE recent AND reason IS NULL) AS specific,
       count(*) FILTER (WHERE recent AND reason IS NULL AND NOT was_seen) AS unseen,
       count(*) FILTER (WHERE recent AND reason IS NULL AND NOT was_seen AND verdict IS DISTINCT FROM 'FAIL') AS passed
FROM j GROUP BY source_name
"""

BATCHES = """
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS ord,
       CASE WHEN count(*) OVER () <= 50 THEN 0 ELSE (row_number() OVER (ORDER BY o_orderkey) - 1) // 20 END AS batch_id
FROM orders
"""

ORACLE = {
    "url_specificity": SPECIFICITY,
    "max_age": MAX_AGE,
    "style_flags": STYLE,
    "cross_source_boost": BOOST,
    "scan_funnel": FUNNEL,
    "batches": BATCHES,
}
