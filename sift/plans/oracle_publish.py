"""DuckDB oracle SQL for the publishing queries."""

from __future__ import annotations

from sift.plans.fixtures import MANIFEST_FILES_SQL, REGISTRY_COPY_SQL, REGISTRY_SQL, SOURCE_FEEDS_SQL
from sift.plans.oracle_archive import URL_RE
from sift.plans.oracle_coverage import BY_STATUS, MISSED, TOTALS_CORE
from sift.plans.oracle_coverage import ORACLE as COVERAGE
from sift.plans.oracle_curation import CATS, SCORED
from sift.plans.oracle_json import RECOVERED
from sift.plans.sqltext import CATEGORIES_SQL, q, with_canonical

DATE, GENERATED, CAP = "2026-03-17", "2026-03-17 06:00", 30


def keyed_digest(kept: str, scanned: str) -> str:
    """(desk, line) of a digest for each desk of ``scanned``; a rendered text with line breaks is several lines."""
    block = [
        "'- **' || coalesce(title, 'Untitled') || '** (' || coalesce(CAST(weighted AS VARCHAR), '0') || ')'",
        "'  ' || coalesce(author, 'Unknown') || ' | ' || coalesce(date, '')",
        "'  ' || coalesce(url, '')",
        "'  ' || coalesce(nullif(tldr, ''), summary, '')",
        "'  Scores: R:' || score_r || ' Q:' || score_q || ' N:' || score_n || ' A:' || score_a || ' S:' || score_s",
        "''",
    ]
    sec = (f"SELECT *, CASE WHEN verdict = 'MUST READ' THEN 1 ELSE list_position({CATEGORIES_SQL}, coalesce(category, 'Uncategorized')) + 1 END AS s "
           f"FROM ({kept}) k")
    counts = ", ".join(f"count(*) FILTER (WHERE s = {k}) AS n{k}" for k in range(1, 10))
    stats = (f"SELECT d.desk, scanned, coalesce(passed, 0) AS passed, coalesce(must_reads, 0) AS must_reads, "
             + ", ".join(f"coalesce(n{k}, 0) AS n{k}" for k in range(1, 10))
             + f" FROM (SELECT desk, count(*) AS scanned FROM ({scanned}) i GROUP BY 1) d LEFT JOIN "
               f"(SELECT desk, count(*) AS passed, count(*) FILTER (WHERE verdict = 'MUST READ') AS must_reads, {counts} FROM ({sec}) c GROUP BY 1) p "
               f"ON p.desk = d.desk")
    fixed = [(q(f"# Research Digest — {DATE}"), None), ("''", None), (q("## MUST READ (score >= 4.5)"), None), ("''", None),
             (q("No items scored above 4.5."), "n1 = 0"), ("''", "n1 = 0")]
    for k, cat in enumerate(CATS, 2):
        fixed += [(q(f"## {cat}"), None), ("''", None), (q("No items passed the quality threshold."), f"n{k} = 0"), ("''", f"n{k} = 0")]
    fixed += [(q("## State of the World"), None), ("''", None), (q("[To be synthesized by LLM]"), None), ("''", None),
              (q("## Top 3 Action Items"), None), ("''", None), (q("[To be generated by LLM]"), None), ("''", None), ("'---'", None),
              ("'Items scanned: ' || scanned || ' | Passed: ' || passed || ' | Must-reads: ' || must_reads", None),
              (q(f"Generated: {GENERATED} UTC"), None), ("''", None)]
    body = [f"SELECT desk, {e} AS line FROM ({sec}) c WHERE s IS NOT NULL" for e in block]
    rest = [f"SELECT desk, {e} FROM ({stats}) t" + (f" WHERE {cond}" if cond else "") for e, cond in fixed]
    return f"SELECT desk, unnest(string_split(line, chr(10))) AS line FROM ({' UNION ALL '.join(body + rest)}) l"


_ITEMS = f"SELECT *, author AS desk FROM ({SCORED}) s"
_BEST = f"QUALIFY row_number() OVER (PARTITION BY desk ORDER BY weighted DESC, input_ord) <= {CAP}"
_FIRST = f"SELECT * FROM items WHERE verdict IS DISTINCT FROM 'FAIL' {_BEST}"
_SEEN = with_canonical(f"SELECT desk, unnest(regexp_extract_all(line, {q(URL_RE)})) AS u FROM lines1", "u")
_CANONICAL = with_canonical("SELECT * FROM items WHERE verdict IS DISTINCT FROM 'FAIL'", "url")
_SECOND = f"SELECT * FROM fresh k WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.desk = k.desk AND s.canonical_url = k.canonical_url) {_BEST}"
_WITH = f"""
WITH items AS MATERIALIZED ({_ITEMS}), first AS MATERIALIZED ({_FIRST}), lines1 AS MATERIALIZED ({keyed_digest('SELECT * FROM first', 'SELECT * FROM items')}),
seen AS MATERIALIZED ({_SEEN}), fresh AS MATERIALIZED ({_CANONICAL}), second AS MATERIALIZED ({_SECOND}),
lines2 AS MATERIALIZED ({keyed_digest('SELECT * FROM second', 'SELECT * FROM items')})
"""


def _report(kept: str, name: str) -> str:
    return (f"SELECT d.desk, '{name}', 'report', 'passed ' || count(k.desk) || ' must-reads ' || count(*) FILTER (WHERE k.verdict = 'MUST READ') "
            f"FROM (SELECT DISTINCT desk FROM items) d LEFT JOIN {kept} k ON k.desk = d.desk GROUP BY 1")


PUBLISHED = f"""{_WITH}
SELECT desk, '{DATE}.md' AS file_name, 'line' AS kind, line FROM lines1
UNION ALL SELECT desk, '{DATE}-2.md', 'line', line FROM lines2
UNION ALL {_report('first', f'{DATE}.md')}
UNION ALL {_report('second', f'{DATE}-2.md')}
"""

LATEST = f"""{_WITH}
SELECT DISTINCT desk, unnest(regexp_extract_all(line, {q(URL_RE)})) AS url, file_name FROM (
  SELECT desk, line, '{DATE}.md' AS file_name FROM lines1 WHERE CAST(regexp_extract(desk, '[0-9]+') AS INTEGER) % 2 = 0
  UNION ALL SELECT desk, line, '{DATE}-2.md' FROM lines2 WHERE CAST(regexp_extract(desk, '[0-9]+') AS INTEGER) % 2 = 1) l
"""

_GOOD = f"SELECT *, CASE number % 11 WHEN 9 THEN 'unknown' ELSE scanner END AS named FROM ({MANIFEST_FILES_SQL}) m WHERE number % 11 NOT IN (3, 7)"

MANIFEST_SOURCES = f"""
SELECT source_name, arg_max(named, number) AS scanner, arg_max(struct_pack(v := status), number).v AS status,
       arg_max(struct_pack(v := error), number).v AS error, min(number) AS first_number, arg_min(entry_ord, number) AS first_entry
FROM ({_GOOD}) g GROUP BY 1
"""

_KEY = "regexp_replace(lower(trim(name)), '[^\\p{L}\\p{N}]+', ' ', 'g')"

REGISTRY_PROSE = f"""
WITH l AS (SELECT {_KEY} AS name_key, * FROM ({REGISTRY_SQL}) a), r AS (SELECT {_KEY} AS name_key, * FROM ({REGISTRY_COPY_SQL}) b)
SELECT coalesce(l.name_key, r.name_key) AS name_key,
       CASE WHEN r.name IS NULL THEN 'only_left' WHEN l.name IS NULL THEN 'only_right' ELSE 'changed' END AS kind, l.tier AS l_tier, r.tier AS r_tier
FROM l FULL OUTER JOIN r ON l.name_key = r.name_key
WHERE r.name IS NULL OR l.name IS NULL OR l.tier IS DISTINCT FROM r.tier OR l.site_url IS DISTINCT FROM r.site_url
"""

BOOSTED = f"""
WITH i AS (SELECT doc_id, weighted AS unboosted, doc_id % (SELECT max(user_id) + 1 FROM events) AS user_id FROM ({SCORED}) s),
b AS (SELECT user_id, bool_or(event_type = 'view') AND bool_or(event_type = 'click') AS twice FROM events GROUP BY 1),
w AS (SELECT doc_id, i.user_id, unboosted, CASE WHEN twice THEN least(round(unboosted + 0.5, 2), 5.0) ELSE unboosted END AS weighted FROM i LEFT JOIN b USING (user_id))
SELECT *, CASE WHEN weighted >= 4.5 THEN 'MUST READ' WHEN weighted >= 3.5 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM w
"""

ORACLE = {
    "registry_prose": REGISTRY_PROSE,
    "large_feed_items": f"""
SELECT source, item_pos, 'rss' AS format, title, url, source AS author, date,
       CASE WHEN length(clean_text) > 500 THEN substr(clean_text, 1, 497) || '...' ELSE clean_text END AS summary FROM ({SOURCE_FEEDS_SQL}) f""",
    "boosted_verdicts": BOOSTED,
    "published_digests": PUBLISHED,
    "latest_published": LATEST,
    "manifest_sources": MANIFEST_SOURCES,
    "manifest_quarantine": f"SELECT DISTINCT number FROM ({MANIFEST_FILES_SQL}) m WHERE number % 11 = 3",
    "coverage_report": f"SELECT t.*, b.status, b.n_sources FROM ({TOTALS_CORE}) t, ({BY_STATUS}) b",
    "coverage_missed_file": f"SELECT name, scanner, status, error FROM ({MISSED}) m",
    "digest_from_report": COVERAGE["digest_with_coverage"],
    "json_strict_sink": f"""
WITH r AS ({RECOVERED}), n AS (SELECT count(*) FILTER (WHERE source_name IS NOT NULL) AS n_kept, count(*) FILTER (WHERE source_name IS NULL) AS n_dropped FROM r)
SELECT msg_id, item_pos, title, url, n_kept, n_dropped FROM r, n WHERE source_name IS NOT NULL""",
}
