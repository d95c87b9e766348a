"""DuckDB oracle SQL for the archive queries."""

from __future__ import annotations

from sift.plans.fixtures import ARCHIVE_FILES_SQL, URL_TEXTS_SQL
from sift.plans.sqltext import WS, q

NAME_RE = r"^(\d{4}-\d{2}-\d{2})(?:-(\d+))?\.md$"
URL_RE = 'https?://[^' + WS[1:-1] + r')\]>"]+'

LATEST = f"""
SELECT folder, arg_max(file_name, struct_pack(d := dd, s := ss)) AS latest_file,
       max(struct_pack(digest_date := dd, digest_seq := ss)).digest_date AS digest_date,
       max(struct_pack(digest_date := dd, digest_seq := ss)).digest_seq AS digest_seq
FROM (SELECT folder, file_name, regexp_extract(file_name, {q(NAME_RE)}, 1) AS dd,
             CAST(coalesce(nullif(regexp_extract(file_name, {q(NAME_RE)}, 2), ''), '0') AS BIGINT) AS ss
      FROM ({ARCHIVE_FILES_SQL}) f WHERE regexp_matches(file_name, {q(NAME_RE)})) t
GROUP BY folder
"""

EXTRACT = f"""
SELECT doc_id, url, CAST(min(pos) AS INTEGER) AS first_pos FROM (
  SELECT doc_id, unnest(m) AS url, generate_subscripts(m, 1) - 1 AS pos
  FROM (SELECT doc_id, regexp_extract_all(text, {q(URL_RE)}) AS m FROM ({URL_TEXTS_SQL}) t) x) y
GROUP BY doc_id, url
"""

NEXT_NAME = f"""
WITH files AS ({ARCHIVE_FILES_SQL}),
wanted AS (SELECT folder, max(order_date) AS digest_date FROM files GROUP BY folder),
taken AS (
  SELECT DISTINCT folder, regexp_extract(file_name, {q(NAME_RE)}, 1) AS digest_date,
         CASE WHEN regexp_extract(file_name, {q(NAME_RE)}, 2) = '' THEN 1
              WHEN CAST(regexp_extract(file_name, {q(NAME_RE)}, 2) AS BIGINT) >= 2
              THEN CAST(regexp_extract(file_name, {q(NAME_RE)}, 2) AS BIGINT) END AS slot
  FROM files WHERE regexp_matches(file_name, {q(NAME_RE)})),
taken2 AS (SELECT * FROM taken WHERE slot IS NOT NULL),
free AS (
  SELECT w.folder, w.digest_date, min(s.slot) AS slot
  FROM wanted w, (SELECT range AS slot FROM range(1, 100000)) s
  WHERE (s.slot = 1 OR s.slot >= 2)
    AND NOT EXISTS (SELECT 1 FROM taken2 t WHERE t.folder = w.folder AND t.digest_date = w.digest_date
                    AND t.slot = s.slot)
    AND s.slot <= 1 + (SELECT count(*) FROM taken2 t WHERE t.folder = w.folder AND t.digest_date = w.digest_date)
  GROUP BY w.folder, w.digest_date)
SELECT folder, digest_date, CAST(CASE WHEN slot = 1 THEN 0 ELSE slot END AS BIGINT) AS digest_seq,
       digest_date || CASE WHEN slot = 1 THEN '' ELSE '-' || slot END || '.md' AS file_name
FROM free
"""

ORACLE = {
    "latest_digest": LATEST,
    "extract_urls": EXTRACT,
    "next_digest_name": NEXT_NAME,
}
