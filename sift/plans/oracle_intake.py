"""DuckDB oracle SQL for the intake queries (built values, not re-parsing)."""

from __future__ import annotations

from sift.plans.fixtures import FEED_ITEMS_SQL, REGISTRY_COPY_SQL, REGISTRY_SQL

PARSE_DATES = """
SELECT event_id,
  CASE event_id % 15
    WHEN 0 THEN strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' GMT'
    WHEN 1 THEN strftime(ts + INTERVAL 9 HOUR, '%a, %d %b %Y %H:%M:%S') || ' +0900'
    WHEN 2 THEN strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' -0000'
    WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
    WHEN 4 THEN strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S+09:00')
    WHEN 5 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ')
    WHEN 6 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
    WHEN 7 THEN strftime(ts, '%Y-%m-%d')
    WHEN 8 THEN strftime(ts, '%Y')
    WHEN 10 THEN strftime(ts - INTERVAL 7 HOUR, '%a, %-d %b %Y %H:%M:%S') || ' PDT'
    WHEN 11 THEN strftime(ts, '%A, %d %b %y %H:%M:%S') || ' GMT'
    WHEN 12 THEN strftime(ts - INTERVAL 5 HOUR, '%d %B %Y %H:%M:%S') || ' EST'
    WHEN 13 THEN strftime(ts, '%a %b %d %H:%M:%S %Y')
    WHEN 14 THEN strftime(ts, '%d-%b-%Y %H:%M:%S') || ' UT'
    ELSE 'junk' END AS date_text,
  CASE WHEN event_id % 15 IN (0, 1, 2, 3, 4, 6, 10, 11, 12, 13, 14) THEN epoch_us(date_trunc('second', ts))
       WHEN event_id % 15 = 5 THEN epoch_us(date_trunc('millisecond', ts))
       WHEN event_id % 15 = 7 THEN epoch_us(date_trunc('day', ts)) END AS parsed_us
FROM events
"""

TIMEFRAMES = """
SELECT event_id, timeframe, cutoff_us, epoch_us(ts) >= cutoff_us AS is_recent FROM (
  SELECT event_id, ts,
    CASE event_type WHEN 'view' THEN CAST(user_id % 10 + 1 AS VARCHAR) || 'd'
                    WHEN 'click' THEN CAST(user_id % 48 + 1 AS VARCHAR) || 'h'
                    WHEN 'purchase' THEN CAST(user_id % 3 + 1 AS VARCHAR) || ' weeks'
                    WHEN 'error' THEN CASE WHEN user_id % 2 = 0 THEN '1 Month' ELSE ' 2 years ' END
                    ELSE 'soon' END AS timeframe,
    epoch_us(TIMESTAMP '2024-01-31 00:00:00') - 3600000000 *
    CASE event_type WHEN 'view' THEN (user_id % 10 + 1) * 24
                    WHEN 'click' THEN user_id % 48 + 1
                    WHEN 'purchase' THEN (user_id % 3 + 1) * 168
                    WHEN 'error' THEN CASE WHEN user_id % 2 = 0 THEN 720 ELSE 17520 END
                    ELSE 168 END AS cutoff_us
  FROM events) t
"""

REGISTRY_TIERS = f"SELECT slug, name, tier FROM ({REGISTRY_SQL}) r WHERE tier IN ('1', '3b')"

REGISTRY_LISTING = f"""
SELECT slug, '[Tier ' || tier || '] ' || name || ': ' || coalesce(nullif(feed_url, ''), '(no feed — WebSearch fallback)') AS line,
       coalesce(length(feed_url) > 0, false) AS has_feed
FROM ({REGISTRY_SQL}) r
"""

SOURCES_PER_TIER = f"""
SELECT tier, count(*) AS n_sources, count(*) FILTER (WHERE length(feed_url) > 0) AS n_feeds
FROM ({REGISTRY_SQL}) r GROUP BY tier
"""

RECONCILE = f"""
WITH l AS (SELECT regexp_replace(lower(trim(name)), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') AS name_key, * FROM ({REGISTRY_SQL}) a),
     r AS (SELECT regexp_replace(lower(trim(name)), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') AS name_key, * FROM ({REGISTRY_COPY_SQL}) b)
SELECT coalesce(l.name_key, r.name_key) AS name_key,
       CASE WHEN r.name IS NULL THEN 'only_left' WHEN l.name IS NULL THEN 'only_right' ELSE 'changed' END AS kind,
       l.tier AS l_tier, r.tier AS r_tier
FROM l FULL OUTER JOIN r ON l.name_key = r.name_key
WHERE r.name IS NULL OR l.name IS NULL
   OR l.tier IS DISTINCT FROM r.tier OR l.feed_url IS DISTINCT FROM r.feed_url OR l.site_url IS DISTINCT FROM r.site_url
"""

ENRICH = f"""
SELECT d.doc_id, d.source, r.tier AS source_tier, r.name AS source_name
FROM documents d JOIN ({REGISTRY_SQL}) r ON r.slug = d.source
"""

FEED_ITEMS = f"""
SELECT f.feed_url, f.snapshot_ord, f.item_pos, f.format, f.title,
       CASE WHEN f.format = 'atom' AND f.lang = 'es' AND NOT contains(f.url, 'youtube.com')
            THEN 'https://www.youtube.com/watch?v=v' || f.doc_id ELSE f.url END AS url,
       f.source AS author, f.date,
       CASE WHEN length(f.clean_text) > 500 THEN substr(f.clean_text, 1, 497) || '...' ELSE f.clean_text END AS summary,
       r.tier AS source_tier, r.name AS source_name
FROM ({FEED_ITEMS_SQL}) f JOIN ({REGISTRY_SQL}) r ON r.feed_url = f.feed_url
WHERE f.format <> 'bad'
  AND (f.lang = 'fr' OR CAST(f.day AS TIMESTAMP) + INTERVAL 10 HOUR >= TIMESTAMP '2026-03-17 00:00:00' - INTERVAL 60 DAY)
"""

FEED_QUARANTINE_KEYS = f"""
SELECT DISTINCT f.feed_url, f.snapshot_ord FROM ({FEED_ITEMS_SQL}) f
JOIN ({REGISTRY_SQL}) r ON r.feed_url = f.feed_url WHERE f.format = 'bad'
"""

FEED_HEALTH = f"""
WITH latest AS (
  SELECT feed_url, arg_max(format, snapshot_ord) AS format, arg_max(n, snapshot_ord) AS n
  FROM (SELECT feed_url, snapshot_ord, any_value(format) AS format, count(*) AS n
        FROM ({FEED_ITEMS_SQL}) f GROUP BY feed_url, snapshot_ord) s
  GROUP BY feed_url)
SELECT r.name, r.feed_url AS url,
       CASE WHEN NOT coalesce(length(r.feed_url) > 0, false) THEN 'no_feed'
            WHEN l.feed_url IS NOT NULL THEN 'alive' ELSE 'dead' END AS status,
       CASE WHEN coalesce(length(r.feed_url) > 0, false) AND l.feed_url IS NOT NULL
            THEN CAST(CASE WHEN l.format = 'bad' THEN 0 ELSE l.n END AS INTEGER) END AS n_items
FROM ({REGISTRY_SQL}) r LEFT JOIN latest l ON l.feed_url = r.feed_url
"""

FEED_HEALTH_COUNTS = f"SELECT status, count(*) AS n_sources FROM ({FEED_HEALTH}) h GROUP BY status"

SUMMARY_TRUNC = """
SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 497) || '...' ELSE text END AS summary,
       substr(coalesce(text, ''), 1, 500) AS description
FROM documents
"""

ORACLE = {
    "parse_dates": PARSE_DATES,
    "timeframe_cutoffs": TIMEFRAMES,
    "registry_tiers": REGISTRY_TIERS,
    "registry_listing": REGISTRY_LISTING,
    "sources_per_tier": SOURCES_PER_TIER,
    "registry_reconcile": RECONCILE,
    "source_enrichment": ENRICH,
    "feed_items": FEED_ITEMS,
    "feed_quarantine": FEED_QUARANTINE_KEYS,
    "feed_health": FEED_HEALTH,
    "feed_health_counts": FEED_HEALTH_COUNTS,
    "summary_truncation": SUMMARY_TRUNC,
}
