"""DuckDB SQL for the operators that SQL can express on whole tables."""

from sift.llm.mixing import SEED
from sift.llm.url_rules import WILDCARD_RULES

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

EXACT_DEDUP = f"""
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UP}', '{_LOW}')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""


def _like(glob: str) -> str:
    return glob.replace("%", r"\%").replace("_", r"\_").replace("*", "%")


_WILD_HIT = " ".join(
    f"WHEN '.' || host LIKE '{_like(h)}' ESCAPE '\\' AND path LIKE '{_like(p)}' ESCAPE '\\' THEN '{h}{p}'" for h, p in WILDCARD_RULES)

URL_RULES = f"""
WITH u AS (SELECT page_id, url IS NOT NULL AND contains(url, '://') AS known,
                  CASE WHEN url IS NULL OR NOT contains(url, '://') THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest
           FROM pages),
s AS (SELECT page_id, known, translate(regexp_extract(rest, '^[^/?#]*'), '{_UP}', '{_LOW}') AS host,
             regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1, 's') AS path FROM u),
r AS (SELECT *, '.' || host AS dotted FROM s),
d AS (SELECT page_id, known, host, path,
       CASE WHEN dotted LIKE '%.example.org' AND path LIKE '/en/1%' THEN 'example.org/en/1'
            WHEN dotted LIKE '%.example.org' AND path LIKE '/es/%' THEN 'example.org/es/'
            WHEN dotted LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/'
            WHEN dotted LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/'
            WHEN dotted LIKE '%.org' AND path LIKE '/%' THEN 'org/' END AS rule,
       CASE WHEN NOT known THEN NULL {_WILD_HIT} END AS wild FROM r)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL OR wild IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN rule IS NULL THEN wild END AS wildcard
FROM d
"""

CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) t(i)),
e AS (SELECT *, length(text) + length(text) - length(replace(replace(text, '\', ''), '#', ''))
             + (length(text) - length(replace(text, '</', ''))) // 2 AS text_chars FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + length(role) + 2 + text_chars + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

MIXING = f"""
WITH size AS (SELECT source, sum(greatest(coalesce(length(text), 0), 1)) AS size FROM documents GROUP BY 1),
w AS (SELECT *, pow(size::DOUBLE, 0.5) AS weight FROM size),
t AS (SELECT sum(weight) AS all_weight, sum(size) AS all_size FROM w),
r AS (SELECT source, round(weight / all_weight * (all_size / size), 9) AS rate FROM w, t),
p AS (SELECT source, rate, greatest(ceil(rate / 64), 1)::INT AS parts FROM r),
q AS (SELECT *, rate / parts AS part FROM p),
cdf AS (SELECT q.*, list_transform(range(0, (ceil(part + 10 * sqrt(part) + 20) + 1)::INT),
                                   lambda k: list_sum(list_transform(range(0, k + 1), lambda j: exp(j * ln(part) - part - lgamma(j + 1))))) AS cdf FROM q),
n AS (SELECT d.*, list_sum(list_transform(range(1, parts + 1), lambda part: len(list_filter(cdf, lambda c: c <=
             ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || part), 1, 13))::BIGINT / 4503599627370496.0)))) AS copies
      FROM documents d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source)
SELECT doc_id, text, lang, source, n_chars, unnest(range(0, copies::BIGINT))::INT AS copy FROM n
"""

DIVERGENCE = f"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY 1, 2 HAVING count(*) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM d) JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS n_all FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY 1, 2),
q AS (SELECT lang, term, 1 + 1000000000 * (l.n + 2) // (sum(l.n) OVER (PARTITION BY lang) + 2 * v) AS q FROM l JOIN v USING (lang)),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + 1000000000 * (coalesce(n, 0) + 2) // (n_all + 2 * v) AS p
      FROM s JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r
QUALIFY part = 'pair' OR rank <= 10
"""

ORACLE = {
    "op4_source_mixing": MIXING,
    "op7_exact_dedup": EXACT_DEDUP,
    "op9_url_rules": URL_RULES,
    "op10_chat_format": CHAT,
    "op12_source_divergence": DIVERGENCE,
}
