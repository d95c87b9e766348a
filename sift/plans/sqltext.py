"""DuckDB SQL building blocks for the independent oracle queries.

These are written in DuckDB's dialect (RE2 regexes, list lambdas) and are
kept apart from the Spark column functions on purpose: the oracle must not
share an expression with the code it checks.
"""

from __future__ import annotations

TRACKING = "['utm_source','utm_medium','utm_campaign','utm_content','utm_term','ref','source','via']"
NETLOC = ("['ftp','http','gopher','nntp','telnet','imap','wais','file','mms','https','shttp',"
          "'snews','prospero','rtsp','rtsps','rtspu','rsync','svn','svn+ssh','sftp','nfs','git',"
          "'git+ssh','ws','wss','itms-services']")
WS = (r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
SPLIT = r"(?s)^([a-z][a-z0-9+.\-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"

CATEGORIES_SQL = ("['AI Labs & Models','Developer Tools & IDEs','Engineering & Infrastructure',"
                  "'Research Papers','MLOps & ML Systems','Agents & Frameworks','Video & Audio',"
                  "'Market & Funding']")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _dec(x: str) -> str:
    return f"coalesce(try(url_decode(replace({x}, '+', ' '))), replace({x}, '+', ' '))"


def _enc(x: str) -> str:
    return f"replace(url_encode({x}), '%20', '+')"


def with_canonical(src: str, url_col: str, out: str = "canonical_url") -> str:
    """SELECT over ``src`` adding column ``out`` = canonical form of ``url_col``."""
    u = (f"regexp_replace(lower(regexp_replace(regexp_replace(coalesce(CAST({url_col} AS VARCHAR), ''), "
         f"{q('^' + WS + '+|' + WS + '+$')}, '', 'g'), '/+$', '')), '[\\t\\r\\n]', '', 'g')")
    pieces = ("list_filter(string_split(substr(_pt.q, 2), '&'), "
              "lambda p: instr(p, '=') > 0 AND length(p) > instr(p, '='))")
    key = _dec("split_part(p, '=', 1)")
    val = _dec("substr(p, instr(p, '=') + 1)")
    kv = (f"list_filter(list_transform({pieces}, lambda p: {{'k': {key}, 'v': {val}}}), "
          f"lambda e: NOT list_contains({TRACKING}, e.k))")
    query = ("array_to_string(list_transform(list_sort(list_transform(_kv, "
             "lambda e, i: {'f': list_position(list_transform(_kv, lambda z: z.k), e.k), 'i': i, "
             f"'s': {_enc('e.k')} || '=' || {_enc('e.v')}}})), lambda y: y.s), '&')")
    path0 = r"regexp_replace(_pt.p, '/index\.html(;[^/]*)?$', '\1')"
    path = f"(CASE WHEN _pt.a <> '' AND starts_with({path0}, ';') THEN '/' || {path0} ELSE {path0} END)"
    host = r"regexp_replace(substr(_pt.a, 3), '^www\.', '')"
    prefix = (f"(CASE WHEN _pt.a <> '' THEN '//' || {host} "
              f"WHEN list_contains({NETLOC}, split_part(_pt.s, ':', 1)) AND ({path} = '' OR starts_with({path}, '/')) "
              f"THEN '//' ELSE '' END)")
    final = (f"_pt.s || {prefix} || {path} || "
             f"(CASE WHEN coalesce({query}, '') <> '' THEN '?' || {query} ELSE '' END)")
    return (f"SELECT * EXCLUDE (_u, _pt, _kv), {final} AS {out} FROM ("
            f"SELECT *, {kv} AS _kv FROM ("
            f"SELECT *, regexp_extract(_u, {q(SPLIT)}, ['s','a','p','q']) AS _pt FROM ("
            f"SELECT *, {u} AS _u FROM ({src}) _s0) _s1) _s2) _s3")
