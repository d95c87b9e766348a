"""DuckDB oracle SQL for the curation queries (independent of the Spark code)."""

from __future__ import annotations

from sift.plans.fixtures import ITEMS_SQL, SEEN_SQL
from sift.plans.sqltext import CATEGORIES_SQL, q, with_canonical

CATS = ["AI Labs & Models", "Developer Tools & IDEs", "Engineering & Infrastructure",
        "Research Papers", "MLOps & ML Systems", "Agents & Frameworks", "Video & Audio",
        "Market & Funding"]

SCORED = f"""
SELECT *, CASE WHEN weighted >= 4.5 THEN 'MUST READ' WHEN weighted >= 3.5 THEN 'PASS' ELSE 'FAIL' END AS verdict
FROM (SELECT *, round((score_r * 1.5::DOUBLE + score_q * 1.0::DOUBLE + score_n * 1.5::DOUBLE
                       + score_a * 1.0::DOUBLE + score_s * 1.0::DOUBLE) / 6.0::DOUBLE, 2) AS weighted
      FROM ({ITEMS_SQL}) _it) _sc
"""

KEPT = f"""
SELECT * FROM ({with_canonical(SCORED, 'url')}) _k
WHERE verdict IS DISTINCT FROM 'FAIL'
  AND canonical_url NOT IN (SELECT canonical_url FROM ({with_canonical(SEEN_SQL, 'url')}) _s)
"""

SCORE_ITEMS = f"""
SELECT doc_id, score_r, score_q, score_n, score_a, score_s, weighted, verdict FROM ({SCORED}) t
"""

CANONICAL_URLS = f"""
SELECT doc_id, url, canonical_url FROM ({with_canonical(ITEMS_SQL, 'url')}) t
"""

SEEN_ANTI_JOIN = f"SELECT doc_id, canonical_url, weighted, verdict FROM ({KEPT}) t"

TOP_ITEMS = f"""
SELECT CAST(row_number() OVER (ORDER BY weighted DESC, input_ord) AS BIGINT) AS rank, doc_id, weighted
FROM ({KEPT}) t
QUALIFY rank <= 25
"""


def digest_sql(cap: int, date: str = "2026-03-17", generated: str = "2026-03-17 06:00",
               sweep_num: int | None = None, coverage_line: bool = False) -> str:
    """Digest lines; with ``coverage_line`` the footer leaves line 2 to a
    coverage line the caller unions in."""
    tag = f" (sweep #{sweep_num})" if sweep_num else ""
    g = 3 if coverage_line else 2
    capped = (f"SELECT * FROM ({KEPT}) k ORDER BY weighted DESC, input_ord LIMIT {cap}"
              if cap > 0 else f"SELECT * FROM ({KEPT}) k")
    sec = (f"SELECT *, CASE WHEN verdict = 'MUST READ' THEN 1 "
           f"ELSE list_position({CATEGORIES_SQL}, coalesce(category, 'Uncategorized')) + 1 END AS section_ord "
           f"FROM ({capped}) c")
    block = [
        "'- **' || coalesce(title, 'Untitled') || '** (' || coalesce(CAST(weighted AS VARCHAR), '0') || ')'",
        "'  ' || coalesce(author, 'Unknown') || ' | ' || coalesce(date, '')",
        "'  ' || coalesce(url, '')",
        "'  ' || coalesce(nullif(tldr, ''), summary, '')",
        "'  Scores: R:' || score_r || ' Q:' || score_q || ' N:' || score_n || ' A:' || score_a || ' S:' || score_s",
        "''",
    ]
    body = " UNION ALL ".join(
        f"SELECT section_ord, 1 AS part, weighted, input_ord, {i} AS line_ord, {expr} AS line "
        f"FROM sec WHERE section_ord IS NOT NULL" for i, expr in enumerate(block))
    counts = ", ".join(f"count(*) FILTER (WHERE section_ord = {k}) AS n{k}" for k in range(1, 10))
    fixed = [(0, 0, 0, q(f"# Research Digest — {date}"), None), (0, 0, 1, "''", None),
             (1, 0, 0, q("## MUST READ (score >= 4.5)"), None), (1, 0, 1, "''", None),
             (1, 2, 0, q("No items scored above 4.5."), "n1 = 0"), (1, 2, 1, "''", "n1 = 0")]
    for i, cat in enumerate(CATS):
        k = i + 2
        fixed += [(k, 0, 0, q(f"## {cat}"), None), (k, 0, 1, "''", None),
                  (k, 2, 0, q("No items passed the quality threshold."), f"n{k} = 0"),
                  (k, 2, 1, "''", f"n{k} = 0")]
    fixed += [(10, 0, 0, q("## State of the World"), None), (10, 0, 1, "''", None),
              (10, 0, 2, q("[To be synthesized by LLM]"), None), (10, 0, 3, "''", None),
              (11, 0, 0, q("## Top 3 Action Items"), None), (11, 0, 1, "''", None),
              (11, 0, 2, q("[To be generated by LLM]"), None), (11, 0, 3, "''", None),
              (12, 0, 0, "'---'", None),
              (12, 0, 1, "'Items scanned: ' || (SELECT count(*) FROM items) || ' | Passed: ' || passed "
                         "|| ' | Must-reads: ' || must_reads", None),
              (12, 0, g, q(f"Generated: {generated} UTC{tag}"), None), (12, 0, g + 1, "''", None)]
    fixed_sql = " UNION ALL ".join(
        f"SELECT {s} AS section_ord, {p} AS part, CAST(NULL AS DOUBLE) AS weighted, "
        f"CAST(NULL AS BIGINT) AS input_ord, {lo} AS line_ord, {e} AS line FROM stats"
        + (f" WHERE {cond}" if cond else "") for s, p, lo, e, cond in fixed)
    return (f"WITH items AS ({ITEMS_SQL}), sec AS ({sec}), "
            f"stats AS (SELECT count(*) AS passed, count(*) FILTER (WHERE verdict = 'MUST READ') AS must_reads, "
            f"{counts} FROM sec) "
            f"{body} UNION ALL {fixed_sql}")


DIGEST_STATS = f"""
SELECT (SELECT count(*) FROM ({ITEMS_SQL}) i) AS scanned, count(*) AS passed,
       count(*) FILTER (WHERE verdict = 'MUST READ') AS must_reads
FROM ({KEPT}) k
"""

CATEGORY_ROLLUP = f"""
SELECT CAST(c.ord AS INTEGER) AS category_ord, c.category,
       count(k.doc_id) FILTER (WHERE k.verdict IS DISTINCT FROM 'MUST READ') AS n_items
FROM (SELECT unnest({CATEGORIES_SQL}) AS category, generate_subscripts({CATEGORIES_SQL}, 1) AS ord) c
LEFT JOIN ({KEPT}) k ON k.category = c.category
GROUP BY c.ord, c.category
"""

ORACLE = {
    "score_items": SCORE_ITEMS,
    "canonical_urls": CANONICAL_URLS,
    "seen_anti_join": SEEN_ANTI_JOIN,
    "top_items": TOP_ITEMS,
    "digest_lines": digest_sql(30),
    "flagship": digest_sql(0),
    "digest_stats": DIGEST_STATS,
    "category_rollup": CATEGORY_ROLLUP,
}
