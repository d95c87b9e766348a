"""URL column functions: canonical form (B1) and URL extraction.

Everything here is a Catalyst expression (regex split + higher-order array
functions), so it runs inside the JVM and pushes through joins and filters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sift.functions.let import let

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
# Query parameters removed from a canonical URL:
TRACKING_PARAMS = ("utm_source", "utm_medium", "utm_campaign", "utm_content",
                   "utm_term", "ref", "source", "via")
# Pattern of a URL inside free text (a run of characters up to whitespace,
# closing parenthesis, closing bracket, '>' or a double quote):
URL_IN_TEXT = r'https?://[^\s)\]>"]+'
# Schemes that get a '//' prefix when the authority is empty (Python's
# urllib.parse.uses_netloc, which the canonical form follows):
NETLOC_SCHEMES = ("ftp", "http", "gopher", "nntp", "telnet", "imap", "wais",
                  "file", "mms", "https", "shttp", "snews", "prospero", "rtsp",
                  "rtsps", "rtspu", "rsync", "svn", "svn+ssh", "sftp", "nfs",
                  "git", "git+ssh", "ws", "wss", "itms-services")
# ---------------------------------------------------------------------------

# Characters Python's str.strip() removes (str.isspace), written so that both
# Java regex and RE2 read them the same way.
WS_CLASS = (r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
# scheme, authority, path, query, fragment (RFC 3986 appendix B, with the
# scheme restricted to the characters a scheme may hold).
URL_SPLIT = r"(?s)^([a-z][a-z0-9+.\-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def _decode(c: Column) -> Column:
    # form decoding: '+' is a space; a '%' that starts no valid escape stays
    # a literal '%' while the valid escapes around it are still decoded
    lenient = F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(lenient), F.replace(c, F.lit("+"), F.lit(" ")))


def _encode(c: Column) -> Column:
    # Java's form encoder keeps '*' and escapes '~'; the canonical form does the reverse
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")),
                     F.lit("*"), F.lit("%2A"))


def clean_query(query: Column) -> Column:
    """Query text without '?' → cleaned query text.

    Drops pieces without '=' or with an empty value and tracking keys;
    repeated keys are grouped at the place of their first occurrence.
    An empty query skips the array work.
    """
    pieces = F.filter(F.split(query, "&"),
                      lambda p: (F.instr(p, "=") > 0) & (F.length(p) > F.instr(p, "=")))
    kv = F.transform(pieces, lambda p: F.struct(
        _decode(F.substring_index(p, "=", 1)).alias("k"),
        _decode(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("v")))
    tracking = F.array(*[F.lit(t) for t in TRACKING_PARAMS])
    kv = F.filter(kv, lambda x: ~F.array_contains(tracking, x["k"]))

    def group(pairs: Column) -> Column:
        names = F.array_distinct(F.transform(pairs, lambda x: x["k"]))
        grouped = F.flatten(F.transform(names, lambda n: F.transform(
            F.filter(pairs, lambda x: x["k"] == n),
            lambda x: F.concat(_encode(x["k"]), F.lit("="), _encode(x["v"])))))
        return F.array_join(grouped, "&")

    return F.when(query == "", F.lit("")).otherwise(let(kv, group))


def canonical_url(url: Column) -> Column:
    """B1: canonical URL used for seen-dedup.

    trim → cut trailing '/' of the whole text → lower-case → split →
    drop 'www.' from the host, '/index.html' from the path, tracking and
    empty parameters and the fragment.  Not idempotent by design
    (``http://a/b/?ref=x`` keeps the path slash).
    """
    u = F.coalesce(url.cast("string"), F.lit(""))
    u = F.regexp_replace(u, f"^{WS_CLASS}+|{WS_CLASS}+$", "")
    u = F.lower(F.regexp_replace(u, "/+$", ""))
    u = F.regexp_replace(u, r"[\t\r\n]", "")

    def split(s: Column) -> Column:
        path = F.regexp_replace(F.regexp_extract(s, URL_SPLIT, 3), r"/index\.html(;[^/]*)?$", "$1")
        return F.struct(F.regexp_extract(s, URL_SPLIT, 1).alias("scheme"),
                        F.regexp_extract(s, URL_SPLIT, 2).alias("auth"), path.alias("path"),
                        clean_query(F.regexp_replace(F.regexp_extract(s, URL_SPLIT, 4), r"^\?", "")).alias("q"))

    def build(p: Column) -> Column:
        scheme, auth, q = p["scheme"], p["auth"], p["q"]
        path = F.when((auth != "") & p["path"].startswith(";"), F.concat(F.lit("/"), p["path"])).otherwise(p["path"])
        host = F.regexp_replace(auth, r"^//(www\.)?", "")
        prefix = (F.when(auth != "", F.concat(F.lit("//"), host))
                  .when(F.substring_index(scheme, ":", 1).isin(*NETLOC_SCHEMES)
                        & ((p["path"] == "") | p["path"].startswith("/")), F.lit("//"))
                  .otherwise(F.lit("")))
        return F.concat(scheme, prefix, path, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))

    return let(let(u, split), build)


# the text pattern with '\s' spelled out as Python's whitespace set
URL_IN_TEXT_JVM = URL_IN_TEXT.replace(r"\s", WS_CLASS[1:-1])


def extract_urls(text: Column) -> Column:
    """All URL matches of a text, in order (duplicates kept; see A9 for uniqueness)."""
    return F.regexp_extract_all(text, F.lit(URL_IN_TEXT_JVM), 0)
