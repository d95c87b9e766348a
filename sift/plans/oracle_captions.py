"""DuckDB oracle SQL for the caption and transcript queries."""

from __future__ import annotations

from sift.plans.fixtures import CAPTION_FILES_SQL, caption_lines_sql

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

def _kept(gaps: bool) -> str:
    return f"""
SELECT media_id, line_no, regexp_replace(l, '<[^>]+>', '', 'g') AS clean FROM (
  SELECT *, last_value(m IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY line_no
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS st
  FROM (SELECT media_id, line_no, trim(line, {WS}) AS l,
               CASE WHEN starts_with(trim(line, {WS}), 'WEBVTT') THEN NULL
                    WHEN starts_with(trim(line, {WS}), 'NOTE') THEN 'note'
                    WHEN trim(line, {WS}) = '' THEN 'blank' END AS m
        FROM ({caption_lines_sql(gaps)}) c) x) y
WHERE NOT starts_with(l, 'WEBVTT') AND NOT starts_with(l, 'NOTE') AND st IS DISTINCT FROM 'note'
  AND NOT contains(l, '-->') AND l <> '' AND NOT regexp_matches(l, '^\\p{{Nd}}+$')
  AND regexp_replace(l, '<[^>]+>', '', 'g') <> ''
"""

def _transcripts(gaps: bool) -> str:
    return f"""
SELECT media_id, string_agg(clean, ' ' ORDER BY line_no) AS transcript FROM (
  SELECT media_id, clean, min(line_no) AS line_no FROM ({_kept(gaps)}) k GROUP BY media_id, clean) f
GROUP BY media_id
"""

KEPT, TRANSCRIPTS = _kept(False), _transcripts(False)

PREFERRED = f"""
SELECT media_id, arg_min(file_name, struct_pack(p := prio, f := file_name)) AS file_name, CAST(min(prio) AS INTEGER) AS pattern_rank
FROM (SELECT *, CASE WHEN starts_with(file_name, '.') THEN NULL
                     WHEN ends_with(file_name, '.en.vtt') THEN 1 WHEN ends_with(file_name, '.en-orig.vtt') THEN 2
                     WHEN ends_with(file_name, '.vtt') THEN 3 WHEN ends_with(file_name, '.en.srt') THEN 4
                     WHEN ends_with(file_name, '.srt') THEN 5 END AS prio
      FROM ({CAPTION_FILES_SQL}) f) t
WHERE prio IS NOT NULL GROUP BY media_id
"""

SEGMENTS = """
SELECT l_orderkey, l_linenumber, CAST(i AS INTEGER) AS part_idx, CAST(i * 600 AS DOUBLE) AS start_s,
       CAST(CASE WHEN d <= 600 THEN d ELSE least((i + 1) * 600, d) END AS DOUBLE) AS end_s
FROM (SELECT l_orderkey, l_linenumber, l_quantity * 37.0::DOUBLE AS d FROM lineitem) t,
     LATERAL (SELECT unnest(range(0, CASE WHEN d <= 600 THEN 1 ELSE CAST(ceil(d / 600) AS BIGINT) END)) AS i) s
"""

ASSEMBLED = "SELECT conv_id AS media_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id"

CHOICE = f"""
WITH caps AS ({_transcripts(True)}),
parts AS ({ASSEMBLED}),
fetched AS (SELECT conv_id AS media_id FROM conversations WHERE turn = 0 AND conv_id % 11 <> 0),
c AS (SELECT f.media_id, t.transcript FROM fetched f LEFT JOIN caps t ON t.media_id = f.media_id)
SELECT coalesce(c.media_id, p.media_id) AS media_id,
       CASE WHEN c.media_id IS NOT NULL THEN 'Talk ' || c.media_id ELSE 'Audio ' || p.media_id END AS title,
       CASE WHEN c.media_id IS NOT NULL THEN 'https://video.example/w/' || c.media_id ELSE 'https://video.example/a/' || p.media_id END AS url,
       CASE WHEN c.media_id IS NOT NULL THEN 'host ' || c.media_id END AS author,
       CASE WHEN length(c.transcript) > 0 THEN c.transcript ELSE p.transcript END AS transcript,
       CASE WHEN length(c.transcript) > 0 THEN 'captions' WHEN p.transcript IS NOT NULL THEN 'openrouter' END AS method,
       '7' AS source_tier
FROM c FULL OUTER JOIN parts p ON p.media_id = c.media_id
"""

OUTCOMES = f"""
SELECT m.media_id, CASE WHEN m.media_id % 11 = 0 THEN NULL ELSE t.transcript END AS transcript, 'captions' AS method,
       CASE WHEN m.media_id % 11 = 0 THEN 'HTTP Error 429'
            WHEN coalesce(length(t.transcript), 0) = 0 THEN 'No English captions available' END AS error
FROM (SELECT conv_id AS media_id FROM conversations WHERE turn = 0) m
LEFT JOIN ({_transcripts(True)}) t ON t.media_id = m.media_id
"""

MEDIA = """
SELECT media_id, 'Talk ' || media_id AS title,
       CASE WHEN conv_id % 4 = 0 THEN NULL ELSE 'https://video.example/w/' || media_id END AS url,
       CASE WHEN conv_id % 2 = 0 AND conv_id % 6 = 0 THEN 'channel ' || media_id ELSE 'host ' || media_id END AS author,
       CASE WHEN conv_id % 2 = 0 THEN '20240101' ELSE '20240102' END AS date,
       CASE WHEN conv_id % 2 = 0 THEN conv_id * 10 END AS views,
       CASE WHEN conv_id % 2 = 0 THEN substr(text, 1, 500) ELSE '' END AS description
FROM (SELECT *, turn * 4294967296 + conv_id AS media_id FROM conversations) c
"""

STRIP = "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS text FROM pages"

ORACLE = {
    "caption_lines_kept": KEPT,
    "caption_transcripts": TRANSCRIPTS,
    "preferred_caption_file": PREFERRED,
    "audio_segments": SEGMENTS,
    "assembled_transcripts": ASSEMBLED,
    "transcript_choice": CHOICE,
    "caption_outcomes": OUTCOMES,
    "media_metadata": MEDIA,
    "strip_tags": STRIP,
}
