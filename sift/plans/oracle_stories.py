"""DuckDB oracle SQL for story grouping (F6) and best item per story."""

from __future__ import annotations

from sift.plans.oracle_curation import SCORED
from sift.plans.fixtures import REGISTRY_SQL

# Exact Jaccard on the sets of five-word shingles, at least 80 percent: pairs are counted by the shingles they share.
_CTES = r"""
texts AS (
  SELECT doc_id AS id, text FROM documents
  UNION ALL SELECT -item_id - 1, text FROM benchmark),
reps AS (SELECT md5(text) AS h, min(id) AS rep, any_value(text) AS text FROM texts WHERE text IS NOT NULL GROUP BY 1),
w AS (SELECT rep, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM reps),
sh AS MATERIALIZED (SELECT rep, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE []::VARCHAR[] END) AS s FROM w),
sizes AS (SELECT rep, len(s) AS n FROM sh),
flat AS MATERIALIZED (SELECT rep, unnest(s) AS x FROM sh),
common AS (SELECT a.rep AS x, b.rep AS y, count(*) AS c FROM flat a JOIN flat b ON a.x = b.x AND a.rep < b.rep GROUP BY 1, 2),
near AS (SELECT x, y FROM common JOIN sizes p ON p.rep = x JOIN sizes q ON q.rep = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
pairs AS MATERIALIZED (SELECT x, y FROM near UNION ALL SELECT y, x FROM near),
reach(x, y) AS (SELECT x, y FROM pairs UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON p.x = r.y),
comp AS MATERIALIZED (SELECT x AS rep, least(x, min(y)) AS story_id FROM reach GROUP BY x),
grp AS (SELECT t.id, coalesce(c.story_id, r.rep, t.id) AS story_id
        FROM texts t LEFT JOIN reps r ON r.h = md5(t.text) LEFT JOIN comp c ON c.rep = r.rep)"""


STORY_GROUPS = f"WITH RECURSIVE {_CTES} SELECT id, story_id FROM grp"

_KEY = "struct_pack(p := coalesce(is_primary, false), w := coalesce(weighted, 0.0), o := -input_ord)"

BEST = f"""
WITH RECURSIVE {_CTES},
it AS (SELECT s.*, g.story_id, coalesce(reg.tier IN ('1', '2', '3'), false) AS is_primary
       FROM ({SCORED}) s JOIN grp g ON g.id = s.doc_id
       LEFT JOIN ({REGISTRY_SQL}) reg ON reg.slug = s.source_name)
SELECT story_id, b.d AS doc_id, b.w AS weighted, b.p AS is_primary, n_items FROM (
  SELECT story_id, arg_max(struct_pack(d := doc_id, w := weighted, p := is_primary), {_KEY}) AS b,
         count(*) AS n_items
  FROM it GROUP BY story_id) t
"""

ORACLE = {
    "story_groups": STORY_GROUPS,
    "best_per_story": BEST,
}
