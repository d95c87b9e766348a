"""DuckDB oracle SQL for the malformed-JSON queries (expected values from events)."""

from __future__ import annotations

from sift.plans.fixtures import SCANNER_ITEMS_SQL

OUTCOME = ("CASE kind WHEN 2 THEN 'trimmed' WHEN 3 THEN 'quotes' WHEN 4 THEN 'trimmed' "
           "WHEN 5 THEN 'trimmed' WHEN 7 THEN 'failed' ELSE 'clean' END")

RECOVERED = f"""
SELECT msg_id, item_pos, {OUTCOME} AS outcome, title, url, source_tier, source_name
FROM ({SCANNER_ITEMS_SQL}) s
WHERE kind <> 7 AND (kind NOT IN (4, 5) OR item_pos < 3)
"""

STRICT = f"SELECT msg_id, item_pos FROM ({RECOVERED}) r WHERE source_name IS NOT NULL"

STATS = f"""
SELECT t.outcome, t.n_texts, coalesce(i.n_items, 0) AS n_items, coalesce(i.n_dropped, 0) AS n_dropped
FROM (SELECT {OUTCOME} AS outcome, count(*) AS n_texts
      FROM (SELECT DISTINCT msg_id, kind FROM ({SCANNER_ITEMS_SQL}) s) m GROUP BY 1) t
LEFT JOIN (SELECT outcome, count(*) AS n_items, count(*) FILTER (WHERE source_name IS NULL) AS n_dropped
           FROM ({RECOVERED}) r GROUP BY 1) i ON i.outcome = t.outcome
"""

SETTINGS = f"""
SELECT msg_id, {OUTCOME} AS outcome,
       CASE WHEN kind = 7 THEN 'none' WHEN kind IN (1, 5, 11) THEN 'envelope' ELSE 'array' END AS kind,
       CAST(CASE WHEN kind IN (1, 11) THEN coalesce(nullif(msg_id * 10, 0), 0) ELSE 0 END AS BIGINT) AS scanned,
       CAST(CASE kind WHEN 1 THEN nullif(msg_id % 5, 0) WHEN 11 THEN 3 END AS BIGINT) AS sweep_num
FROM (SELECT DISTINCT msg_id, kind FROM ({SCANNER_ITEMS_SQL}) s) m
"""

ORACLE = {
    "json_recovery": RECOVERED,
    "json_strict_items": STRICT,
    "json_recovery_stats": STATS,
    "envelope_settings": SETTINGS,
}
