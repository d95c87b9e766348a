"""DuckDB oracle SQL for the coverage queries."""

from __future__ import annotations

from sift.plans.fixtures import MANIFEST_ENTRIES_SQL
from sift.plans.oracle_curation import digest_sql

MERGED = f"""
SELECT source_name, scanner, status, error, first_manifest, first_entry FROM (
  SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY manifest_ord DESC, entry_ord DESC) AS rn,
         first_value(manifest_ord) OVER (PARTITION BY source_name ORDER BY manifest_ord, entry_ord) AS first_manifest,
         first_value(entry_ord) OVER (PARTITION BY source_name ORDER BY manifest_ord, entry_ord) AS first_entry
  FROM ({MANIFEST_ENTRIES_SQL}) e) t
WHERE rn = 1
"""

BY_STATUS = f"SELECT coalesce(status, 'no_response') AS status, count(*) AS n_sources FROM ({MERGED}) m GROUP BY 1"

TOTALS_CORE = f"""
SELECT CAST(CASE WHEN n > 0 THEN n ELSE 94 END AS BIGINT) AS total_sources, sources_visited,
       CASE WHEN (CASE WHEN n > 0 THEN n ELSE 94 END) > 0
            THEN round_even(sources_visited / (CASE WHEN n > 0 THEN n ELSE 94 END) * 100, 1)
            ELSE 0.0 END AS coverage_pct
FROM (SELECT count(*) AS n, count(*) FILTER (WHERE status IN ('ok', 'empty')) AS sources_visited
      FROM ({MERGED}) m) a
"""

MISSED = f"""
SELECT source_name AS name, scanner, status, error, first_manifest, first_entry
FROM ({MERGED}) m WHERE status IS NULL OR status NOT IN ('ok', 'empty')
"""


def _digest_with_coverage() -> str:
    base = digest_sql(30, sweep_num=3, coverage_line=True)
    # footer: replace the 'Generated' line and add the coverage line
    cov_line = f"""
SELECT 12 AS section_ord, 0 AS part, CAST(NULL AS DOUBLE) AS weighted, CAST(NULL AS BIGINT) AS input_ord,
       2 AS line_ord,
       'Sources: ' || t.sources_visited || '/' || t.total_sources || ' visited ('
       || CAST(CAST(round_even(t.coverage_pct, 0) AS BIGINT) AS VARCHAR) || '%) | '
       || (t.total_sources - t.sources_visited) || ' missed'
       || CASE WHEN len(p.parts) > 0 THEN ' (' || array_to_string(p.parts, ', ') || ')' ELSE '' END AS line
FROM ({TOTALS_CORE}) t,
     (SELECT list_filter([
         CASE WHEN coalesce(max(n_sources) FILTER (WHERE status = 'timeout'), 0) <> 0
              THEN max(n_sources) FILTER (WHERE status = 'timeout') || ' timeout' END,
         CASE WHEN coalesce(max(n_sources) FILTER (WHERE status = 'error'), 0) <> 0
              THEN max(n_sources) FILTER (WHERE status = 'error') || ' error' END,
         CASE WHEN coalesce(max(n_sources) FILTER (WHERE status = 'no_response'), 0) <> 0
              THEN max(n_sources) FILTER (WHERE status = 'no_response') || ' no response' END],
         lambda x: x IS NOT NULL) AS parts
      FROM ({BY_STATUS}) b) p
"""
    return base + " UNION ALL " + cov_line


ORACLE = {
    "coverage_sources": MERGED,
    "coverage_by_status": BY_STATUS,
    "coverage_totals": TOTALS_CORE,
    "coverage_missed": MISSED,
    "digest_with_coverage": _digest_with_coverage(),
}
