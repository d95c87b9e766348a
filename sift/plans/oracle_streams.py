"""DuckDB oracle SQL for the streaming queries (their batch meaning)."""

from __future__ import annotations

from sift.plans.oracle_coverage import MERGED

STREAM_INTAKE = """
SELECT DISTINCT 'https://ev.example/u/' || user_id || '/' ||
       CASE WHEN event_type IN ('view', 'click') THEN 'post' ELSE event_type END AS canonical_url
FROM events
WHERE ts >= TIMESTAMP '2024-01-17 00:00:00' AND event_type <> 'error'
"""

WINDOW_COUNTS = """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
       coalesce(CASE event_type WHEN 'view' THEN 'ok' WHEN 'click' THEN 'empty'
                WHEN 'purchase' THEN 'timeout' WHEN 'error' THEN 'error' END, 'no_response') AS status,
       count(*) AS n_entries
FROM events GROUP BY 1, 2
"""

LATEST = f"SELECT source_name, scanner, status, error FROM ({MERGED}) m"

ORACLE = {
    "stream_intake": STREAM_INTAKE,
    "stream_window_counts": WINDOW_COUNTS,
    "stream_latest_status": LATEST,
}
