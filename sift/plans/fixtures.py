"""Item-shaped views over the driver tables.

The driver ships TPC-H-like tables plus ``documents`` and ``pages``.  The
curation jobs want scored items, a seen set and a source registry; these
views derive them by fixed rules so that the Spark job and the DuckDB oracle
can each build the same input independently.  Every rule reads the whole
table; nothing is sampled.

Item rules (one item per document):
* url: the page ``doc_id mod |pages|``, decorated by ``doc_id mod 4``
  (0 as is, 1 ``www.`` host, 2 ``utm_medium`` parameter before the fragment,
  3 upper-cased with a path slash before the fragment);
* scores: R,Q,N,A = 1 + (doc_id div d) mod 5 with d = 1, 5, 25, 125 and
  S = 1 + (7·doc_id div 3) mod 5;
* category: the ``doc_id mod 9``-th listed category, none for 8;
* title: first line of the text; summary: B6 of the text;
  author: the document's source; date: 2026-03-16 minus ``doc_id mod 365`` days.
The seen set (previous digest) is every page served over https.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sift.functions.text import truncate_summary
from sift.plans.sqltext import CATEGORIES_SQL
from sift.operators.digest import CATEGORIES
from sift.sources.tables import read_table

ITEM_DATE_BASE = "2026-03-16"


def _decorate(url, k):
    base = F.regexp_extract(url, r"^[^#]*", 0)
    frag = F.regexp_extract(url, r"#.*$", 0)
    sep = F.when(F.instr(base, "?") > 0, F.lit("&")).otherwise(F.lit("?"))
    return (F.when(k == 1, F.regexp_replace(url, r"^(https?://)(www\.)?", "$1www."))
            .when(k == 2, F.concat(base, sep, F.lit("utm_medium=feed"), frag))
            .when(k == 3, F.concat(F.upper(base), F.lit("/"), frag))
            .otherwise(url))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "source")
    pages = read_table(spark, sf_dir, "pages", "page_id", "url")
    n_pages = pages.agg(F.count(F.lit(1))).scalar()
    d = F.col("doc_id")
    cats = F.array(*[F.lit(c) for c in CATEGORIES])
    joined = docs.withColumn("page_id", d % n_pages).join(pages, "page_id")
    return joined.select(
        d.alias("input_ord"),
        d.alias("doc_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        _decorate(F.col("url"), d % 4).alias("url"),
        F.col("source").alias("author"),
        F.date_format(F.date_sub(F.lit(ITEM_DATE_BASE).cast("date"), (d % 365).cast("int")),
                      "yyyy-MM-dd").alias("date"),
        truncate_summary(F.col("text")).alias("summary"),
        F.lit(None).cast("string").alias("tldr"),
        F.when(d % 9 < 8, F.element_at(cats, (d % 9 + 1).cast("int"))).alias("category"),
        F.struct(
            F.expr("CAST(1 + doc_id % 5 AS INT)").alias("R"),
            F.expr("CAST(1 + (doc_id DIV 5) % 5 AS INT)").alias("Q"),
            F.expr("CAST(1 + (doc_id DIV 25) % 5 AS INT)").alias("N"),
            F.expr("CAST(1 + (doc_id DIV 125) % 5 AS INT)").alias("A"),
            F.expr("CAST(1 + ((doc_id * 7) DIV 3) % 5 AS INT)").alias("S"),
        ).alias("scores"),
        F.col("source").alias("source_name"),
    )


def seen_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of the previous digest: every https page."""
    pages = read_table(spark, sf_dir, "pages", "url")
    return pages.where(F.col("url").startswith("https://"))


# --- SQL twins (DuckDB) ----------------------------------------------------

ITEMS_SQL = """
SELECT d.doc_id AS input_ord, d.doc_id,
       split_part(d.text, chr(10), 1) AS title,
       CASE d.doc_id % 4
         WHEN 1 THEN regexp_replace(p.url, '^(https?://)(www\\.)?', '\\1www.')
         WHEN 2 THEN regexp_extract(p.url, '^[^#]*', 0)
                     || CASE WHEN instr(regexp_extract(p.url, '^[^#]*', 0), '?') > 0 THEN '&' ELSE '?' END
                     || 'utm_medium=feed' || regexp_extract(p.url, '#.*$', 0)
         WHEN 3 THEN upper(regexp_extract(p.url, '^[^#]*', 0)) || '/' || regexp_extract(p.url, '#.*$', 0)
         ELSE p.url END AS url,
       d.source AS author,
       strftime(DATE '2026-03-16' - CAST(d.doc_id % 365 AS INTEGER), '%Y-%m-%d') AS date,
       CASE WHEN length(d.text) > 500 THEN substr(d.text, 1, 497) || '...' ELSE d.text END AS summary,
       CAST(NULL AS VARCHAR) AS tldr,
       CASE WHEN d.doc_id % 9 < 8 THEN {cats}[CAST(d.doc_id % 9 AS INTEGER) + 1] END AS category,
       CAST(1 + d.doc_id % 5 AS INTEGER) AS score_r,
       CAST(1 + (d.doc_id // 5) % 5 AS INTEGER) AS score_q,
       CAST(1 + (d.doc_id // 25) % 5 AS INTEGER) AS score_n,
       CAST(1 + (d.doc_id // 125) % 5 AS INTEGER) AS score_a,
       CAST(1 + (d.doc_id * 7 // 3) % 5 AS INTEGER) AS score_s,
       d.source AS source_name
FROM documents d
JOIN pages p ON p.page_id = d.doc_id % (SELECT count(*) FROM pages)
""".replace("{cats}", CATEGORIES_SQL)

SEEN_SQL = "SELECT url FROM pages WHERE starts_with(url, 'https://')"


# --- coverage manifests from events -----------------------------------------
# One manifest entry per event: the user is the source, the event type the
# status (view ok, click empty, purchase timeout, error error, signup: no
# status), the hour the scanner, the event id the position; a manifest holds
# the events of one day.

def manifest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "props")
    return manifest_entries_from(ev)


def manifest_entries_from(ev: DataFrame) -> DataFrame:
    """The manifest rule over an events frame (batch or stream)."""
    et = F.col("event_type")
    status = (F.when(et == "view", "ok").when(et == "click", "empty")
               .when(et == "purchase", "timeout").when(et == "error", "error"))
    return ev.select(
        F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("manifest_ord"),
        F.col("event_id").alias("entry_ord"),
        F.concat(F.lit("scanner_"), F.lpad(F.hour("ts").cast("string"), 2, "0")).alias("scanner"),
        F.concat(F.lit("source_"), F.col("user_id").cast("string")).alias("source_name"),
        status.alias("status"),
        F.when(et == "error", F.col("props")).alias("error"),
        F.col("ts").cast("timestamp").alias("event_ts"))


MANIFEST_ENTRIES_SQL = """
SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS manifest_ord,
       event_id AS entry_ord,
       'scanner_' || lpad(CAST(hour(ts) AS VARCHAR), 2, '0') AS scanner,
       'source_' || CAST(user_id AS VARCHAR) AS source_name,
       CASE event_type WHEN 'view' THEN 'ok' WHEN 'click' THEN 'empty'
            WHEN 'purchase' THEN 'timeout' WHEN 'error' THEN 'error' END AS status,
       CASE WHEN event_type = 'error' THEN props END AS error
FROM events
"""


# Landed manifest files: one JSON file per scanner (hour) and day with the last
# event of each user; by (24 * day + hour) mod 11: 3 cut in half (no JSON),
# 5 an array of two manifests (the second without sources), 7 without coverage,
# 9 without the scanner's name.

def write_manifests(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The manifest files of the events under ``path``, one folder (number) each."""
    ev = manifest_entries(spark, sf_dir).withColumn("number", F.col("manifest_ord") * 24 + F.hour("event_ts"))
    last = ev.groupBy("number", "scanner", "source_name").agg(F.max_by(F.struct("status", "error"), "entry_ord").alias("info"))
    # users in name order; null fields are left out of the JSON text
    body = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_name", F.to_json("info").alias("j")))), lambda e: F.concat(
        F.lit('"'), e["source_name"], F.lit('": '), e["j"])), ", "), F.lit("}"))
    k = F.col("number") % 11
    name = F.when(k == 9, F.lit("")).otherwise(F.concat(F.lit('"scanner": "'), F.col("scanner"), F.lit('", ')))
    whole = F.concat(F.lit('{"coverage": {'), name, F.lit('"sources": '), F.col("body"), F.lit("}}"))
    text = (F.when(k == 3, F.substring(whole, 1, F.floor(F.length(whole) / 2).cast("int")))
             .when(k == 5, F.concat(F.lit("["), whole, F.lit(', {"coverage": {"scanner": "idle", "sources": {}}}]')))
             .when(k == 7, F.lit('{"items": []}')).otherwise(whole))
    files = last.groupBy("number", "scanner").agg(body.alias("body")).select(F.lpad(F.col("number").cast("string"), 6, "0").alias("number"), text.alias("text"))
    files.repartition("number").write.partitionBy("number").text(path)


MANIFEST_FILES_SQL = f"""
SELECT number, scanner, source_name, status, error,
       row_number() OVER (PARTITION BY number ORDER BY source_name) - 1 AS entry_ord
FROM (SELECT manifest_ord * 24 + CAST(substr(scanner, 9) AS BIGINT) AS number, scanner, source_name,
             arg_max(struct_pack(v := status), entry_ord).v AS status, arg_max(struct_pack(v := error), entry_ord).v AS error
      FROM ({MANIFEST_ENTRIES_SQL}) e GROUP BY 1, 2, 3) l
"""


# --- digest archive from orders ---------------------------------------------
# Each customer is an archive folder; each order leaves one file named by its
# date, with suffix by order key: '' (base), '-2', '-3', '-1' (never blocks),
# '.ko' (other edition, skipped) or '-notes' (not a digest).

ARCHIVE_SUFFIXES = ("", "-2", "-3", "-1", ".ko", "-notes")


def archive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    suf = F.element_at(F.array(*[F.lit(x) for x in ARCHIVE_SUFFIXES]),
                       (F.col("o_orderkey") % len(ARCHIVE_SUFFIXES) + 1).cast("int"))
    return o.select(F.col("o_custkey").alias("folder"),
                    F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), suf, F.lit(".md")).alias("file_name"),
                    F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"))


ARCHIVE_FILES_SQL = """
SELECT o_custkey AS folder,
       strftime(o_orderdate, '%Y-%m-%d') || ['', '-2', '-3', '-1', '.ko', '-notes'][CAST(o_orderkey % 6 AS INTEGER) + 1] || '.md' AS file_name,
       strftime(o_orderdate, '%Y-%m-%d') AS order_date
FROM orders
"""


def url_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their item URL spliced in three times (start, inside a
    parenthesis, with a trailing comma) so extraction sees repeats and stops."""
    it = items(spark, sf_dir).select("doc_id", "url")
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.join(it, "doc_id").select(
        "doc_id", F.concat(F.col("url"), F.lit(" "), F.col("text"), F.lit(" ("), F.col("url"),
                           F.lit(") and "), F.col("url"), F.lit(", end")).alias("text"))


URL_TEXTS_SQL = f"""
SELECT d.doc_id, i.url || ' ' || d.text || ' (' || i.url || ') and ' || i.url || ', end' AS text
FROM documents d JOIN ({ITEMS_SQL}) i ON i.doc_id = d.doc_id
"""


# --- source registry from supplier ------------------------------------------
# slug 'src<suppkey>' (documents name their source that way), tier by nation,
# a feed unless the balance is negative, a site for every source.

TIERS = ("1", "2", "3", "3b", "4", "5", "6", "7", "8")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    key = F.col("s_suppkey").cast("string")
    return s.select(
        F.concat(F.lit("src"), key).alias("slug"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("https://site"), key, F.lit(".example.com/")).alias("site_url"),
        F.when(F.col("s_acctbal") >= 0, F.concat(F.lit("https://feeds.example/src"), key, F.lit(".xml"))).alias("feed_url"),
        F.element_at(F.array(*[F.lit(t) for t in TIERS]), (F.col("s_nationkey") % 9 + 1).cast("int")).alias("tier"))


REGISTRY_SQL = """
SELECT 'src' || s_suppkey AS slug, s_name AS name,
       'https://site' || s_suppkey || '.example.com/' AS site_url,
       CASE WHEN s_acctbal >= 0 THEN 'https://feeds.example/src' || s_suppkey || '.xml' END AS feed_url,
       ['1','2','3','3b','4','5','6','7','8'][CAST(s_nationkey % 9 AS INTEGER) + 1] AS tier
FROM supplier
"""


def registry_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second copy of the registry that drifted: by supplier key, 3 → gone,
    5 → renamed, 7 → other tier; plus every nation as a new source."""
    reg = registry(spark, sf_dir).withColumn("k", F.regexp_extract("slug", r"\d+", 0).cast("bigint") % 10)
    reg = (reg.where(F.col("k") != 3)
              .withColumn("name", F.when(F.col("k") == 5, F.concat(F.col("name"), F.lit(" Labs"))).otherwise(F.col("name")))
              .withColumn("tier", F.when(F.col("k") == 7, F.lit("3b")).otherwise(F.col("tier")))
              .drop("k"))
    n = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    extra = n.select(F.concat(F.lit("nat"), F.col("n_nationkey").cast("string")).alias("slug"),
                     F.col("n_name").alias("name"), F.lit(None).cast("string").alias("site_url"),
                     F.lit(None).cast("string").alias("feed_url"), F.lit("8").alias("tier"))
    return reg.unionByName(extra)


REGISTRY_COPY_SQL = f"""
SELECT slug, CASE WHEN k = 5 THEN name || ' Labs' ELSE name END AS name, site_url, feed_url,
       CASE WHEN k = 7 THEN '3b' ELSE tier END AS tier
FROM (SELECT *, CAST(regexp_extract(slug, '\\d+', 0) AS BIGINT) % 10 AS k FROM ({REGISTRY_SQL}) r) t
WHERE k <> 3
UNION ALL
SELECT 'nat' || n_nationkey, n_name, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), '8' FROM nation
"""


def write_registry_copies(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The registry as a JSON document and its drifted copy as prose, a file each: headings by tier, two suppliers
    in a bullet, nations (without a site) in one each."""
    reg = registry(spark, sf_dir)
    doc = F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("slug", "name", "site_url", "feed_url", "tier"))).alias("sources")))
    reg.agg(doc.alias("text")).write.text(f"{path}/json")
    site = F.when(F.col("site_url").isNotNull(), F.concat(F.lit(" ("), F.regexp_replace("site_url", "^https://|/$", ""), F.lit(")"))).otherwise(F.lit(""))
    entry = F.struct("slug", F.concat("name", site).alias("e"))
    lines = registry_copy(spark, sf_dir).groupBy("tier", F.col("site_url").isNull().alias("bare")).agg(
        F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["e"]).alias("es"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size("es") - 1) / 2).cast("int")), lambda j: F.array_join(F.slice("es", 2 * j + 1, 2), ", "))
    bullets = F.transform(F.when(F.col("bare"), F.col("es")).otherwise(pairs), lambda b: F.concat(F.lit("- "), b, F.lit(" — posts, notes (weekly)")))
    sections = lines.groupBy("tier").agg(F.flatten(F.collect_list(bullets)).alias("bs")).select(
        F.struct("tier", F.concat(F.lit("### Tier "), F.col("tier"), F.lit(": sources (all)\n"), F.array_join("bs", "\n"), F.lit("\n")).alias("t")).alias("s"))
    text = sections.agg(F.concat(F.lit("# Guide\n\n- not a source (no.example)\n\n## Source Registry\n\n"), F.array_join(F.transform(
        F.sort_array(F.collect_list("s")), lambda s: s["t"]), "\n"), F.lit("\n## Rules\n\n- a rule (no.example)\n")).alias("text"))
    text.write.text(f"{path}/prose")


# --- landed feed snapshots from documents -------------------------------------
# A snapshot holds the documents of one source with the same doc_id div 8
# (at most 8 items).  By that bucket mod 5: 0 Atom, 1 RSS 1.0/RDF, 4 cut in
# half (malformed), else RSS 2.0.  Item: title, item URL, the source as
# author (dc:creator for even ids), a date 2026-03-16 minus doc_id mod 365
# days at 10:00 (French texts carry an unreadable date), the text as
# description; Atom entries carry a self link first, summary or content by
# parity, and Spanish ones a video id.

SNAPSHOT_BUCKET = 8


def _esc(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def feed_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    it = items(spark, sf_dir).select("doc_id", "title", "url")
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    d = docs.join(it, "doc_id")
    bucket = F.floor(F.col("doc_id") / SNAPSHOT_BUCKET).cast("bigint")
    day = F.date_sub(F.lit(ITEM_DATE_BASE).cast("date"), (F.col("doc_id") % 365).cast("int"))
    rss_date = F.when(F.col("lang") == "fr", F.lit("recently")).otherwise(
        F.concat(F.date_format(day, "EEE, dd MMM yyyy"), F.lit(" 10:00:00 GMT")))
    iso_date = F.when(F.col("lang") == "fr", F.lit("recently")).otherwise(
        F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T10:00:00Z")))
    text = _esc(F.regexp_replace("text", r"[\x00-\x08\x0B\x0C\x0E-\x1F\r]", ""))
    even = F.col("doc_id") % 2 == 0
    who = F.when(even, F.lit("dc:creator")).otherwise(F.lit("author"))
    rss_item = F.concat(
        F.lit("<item><title>"), _esc(F.col("title")), F.lit("</title><link>"), _esc(F.col("url")),
        F.lit("</link><"), who, F.lit(">"), F.col("source"), F.lit("</"), who, F.lit("><pubDate>"),
        rss_date, F.lit("</pubDate><description>"), text, F.lit("</description></item>"))
    when_tag = F.when(even, F.lit("published")).otherwise(F.lit("updated"))
    body_tag = F.when(even, F.lit("summary")).otherwise(F.lit("content"))
    atom_entry = F.concat(
        F.lit("<entry><title>"), _esc(F.col("title")),
        F.lit("</title><link rel=\"self\" href=\"https://feeds.example/self/"), F.col("doc_id").cast("string"),
        F.lit("\"/><link href=\""), F.replace(_esc(F.col("url")), F.lit("\""), F.lit("&quot;")),
        F.lit("\"/><author><name>"), F.col("source"), F.lit("</name></author><"), when_tag, F.lit(">"),
        iso_date, F.lit("</"), when_tag, F.lit("><"), body_tag, F.lit(">"), text, F.lit("</"), body_tag, F.lit(">"),
        F.when(F.col("lang") == "es", F.concat(F.lit("<yt:videoId>v"), F.col("doc_id").cast("string"),
                                                F.lit("</yt:videoId>"))).otherwise(F.lit("")),
        F.lit("</entry>"))
    fmt = F.when(bucket % 5 == 0, F.lit("atom")).when(bucket % 5 == 1, F.lit("rdf")) \
           .when(bucket % 5 == 4, F.lit("bad")).otherwise(F.lit("rss"))
    g = (d.select("source", bucket.alias("snapshot_ord"), fmt.alias("kind"),
                  F.struct("doc_id", F.when(fmt == "atom", atom_entry).otherwise(rss_item).alias("x")).alias("e"))
          .groupBy("source", "snapshot_ord", "kind")
          .agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["x"]), "").alias("inner")))
    full = (F.when(F.col("kind") == "atom", F.concat(
                F.lit('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:yt="http://www.youtube.com/xml/schemas/2015">'),
                F.col("inner"), F.lit("</feed>")))
             .when(F.col("kind") == "rdf", F.concat(
                F.lit('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/">'),
                F.col("inner"), F.lit("</rdf:RDF>")))
             .otherwise(F.concat(
                F.lit('<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>feed</title>'),
                F.col("inner"), F.lit("</channel></rss>"))))
    body = F.when(F.col("kind") == "bad", F.substring(full, 1, (F.length(full) / 2).cast("int"))).otherwise(full)
    return g.select(F.concat(F.lit("https://feeds.example/"), F.col("source"), F.lit(".xml")).alias("feed_url"),
                    "snapshot_ord", body.alias("body"))


def write_source_feeds(spark: SparkSession, sf_dir: str, path: str) -> None:
    """One RSS 2.0 file for each source under ``path/source=<name>``: all its documents as items, by id."""
    it = items(spark, sf_dir).select("doc_id", "title", "url", "date")
    d = read_table(spark, sf_dir, "documents", "doc_id", "text", "source").join(it, "doc_id")
    text = _esc(F.regexp_replace("text", r"[\x00-\x08\x0B\x0C\x0E-\x1F\r]", ""))
    item = F.concat(F.lit("<item><title>"), _esc(F.col("title")), F.lit("</title><link>"), _esc(F.col("url")), F.lit("</link><author>"), F.col("source"),
                    F.lit("</author><pubDate>"), F.col("date"), F.lit("</pubDate><description>"), text, F.lit("</description></item>"))
    rows = d.select("source", F.col("doc_id").alias("ord"), item.alias("line"))
    ends = rows.select("source").distinct().select("source", F.inline(F.array(
        F.struct(F.lit(-1).cast("bigint").alias("ord"), F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>all</title>').alias("line")),
        F.struct(F.lit(2 ** 62).alias("ord"), F.lit("</channel></rss>").alias("line")))))
    (rows.unionByName(ends).repartition("source").sortWithinPartitions("source", "ord").select("source", "line").write.partitionBy("source").text(path))


SOURCE_FEEDS_SQL = f"""
SELECT d.source, CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) - 1 AS BIGINT) AS item_pos, trim(i.title) AS title, i.url, i.date,
       trim(regexp_replace(d.text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\r]', '', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS clean_text
FROM documents d JOIN ({ITEMS_SQL}) i ON i.doc_id = d.doc_id
"""


# expected items of the snapshots, straight from the documents
FEED_ITEMS_SQL = f"""
SELECT 'https://feeds.example/' || d.source || '.xml' AS feed_url, d.doc_id // 8 AS snapshot_ord,
       CASE (d.doc_id // 8) % 5 WHEN 0 THEN 'atom' WHEN 1 THEN 'rdf' WHEN 4 THEN 'bad' ELSE 'rss' END AS format,
       CAST(row_number() OVER (PARTITION BY d.source, d.doc_id // 8 ORDER BY d.doc_id) - 1 AS INTEGER) AS item_pos,
       d.doc_id, d.lang, d.source, trim(i.title) AS title, i.url,
       CASE WHEN d.lang = 'fr' THEN 'recently'
            WHEN (d.doc_id // 8) % 5 = 0 THEN strftime(DATE '2026-03-16' - CAST(d.doc_id % 365 AS INTEGER), '%Y-%m-%d') || 'T10:00:00Z'
            ELSE strftime(DATE '2026-03-16' - CAST(d.doc_id % 365 AS INTEGER), '%a, %d %b %Y') || ' 10:00:00 GMT' END AS date,
       DATE '2026-03-16' - CAST(d.doc_id % 365 AS INTEGER) AS day,
       trim(regexp_replace(d.text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\r]', '', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS clean_text
FROM documents d JOIN ({ITEMS_SQL}) i ON i.doc_id = d.doc_id
"""


# --- date texts and timeframes from events -------------------------------------
# The event time written in one of fifteen styles by event_id mod 15: RFC 2822
# with GMT, with +0900 (local time shifted), with -0000; ISO with Z, with
# +09:00, with milliseconds; 'yyyy-MM-dd HH:mm:ss'; date only; '2024'; 'junk';
# then mail dates with PDT (local time shifted), with a two-digit year and full
# weekday, with a full month name and EST, in the C library's order, with hyphens.
# Timeframe texts by event type: view 'Nd', click 'Nh', purchase 'N weeks',
# error '1 Month' / ' 2 years ', signup 'soon' (N from the user id).

EVENTS_NOW = "2024-01-31 00:00:00"


def date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", "event_id", "ts")
    ts = F.col("ts")
    plus9 = ts + F.expr("INTERVAL 9 HOURS")
    k = F.col("event_id") % 15
    minus = lambda h: ts - F.expr(f"INTERVAL {h} HOURS")
    txt = (F.when(k == 0, F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
            .when(k == 1, F.concat(F.date_format(plus9, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0900")))
            .when(k == 2, F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" -0000")))
            .when(k == 3, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            .when(k == 4, F.date_format(plus9, "yyyy-MM-dd'T'HH:mm:ss'+09:00'"))
            .when(k == 5, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
            .when(k == 6, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
            .when(k == 7, F.date_format(ts, "yyyy-MM-dd"))
            .when(k == 8, F.date_format(ts, "yyyy"))
            .when(k == 10, F.concat(F.date_format(minus(7), "EEE, d MMM yyyy HH:mm:ss"), F.lit(" PDT")))
            .when(k == 11, F.concat(F.date_format(ts, "EEEE, dd MMM yy HH:mm:ss"), F.lit(" GMT")))
            .when(k == 12, F.concat(F.date_format(minus(5), "dd MMMM yyyy HH:mm:ss"), F.lit(" EST")))
            .when(k == 13, F.date_format(ts, "EEE MMM dd HH:mm:ss yyyy"))
            .when(k == 14, F.concat(F.date_format(ts, "dd-MMM-yyyy HH:mm:ss"), F.lit(" UT")))
            .otherwise(F.lit("junk")))
    return ev.select("event_id", txt.alias("date_text"))


def timeframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    u, et = F.col("user_id"), F.col("event_type")
    tf = (F.when(et == "view", F.concat((u % 10 + 1).cast("string"), F.lit("d")))
           .when(et == "click", F.concat((u % 48 + 1).cast("string"), F.lit("h")))
           .when(et == "purchase", F.concat((u % 3 + 1).cast("string"), F.lit(" weeks")))
           .when(et == "error", F.when(u % 2 == 0, F.lit("1 Month")).otherwise(F.lit(" 2 years ")))
           .otherwise(F.lit("soon")))
    return ev.select("event_id", "ts", tf.alias("timeframe"))


# --- scanner output texts from events -------------------------------------------
# A message holds the five events with the same event_id div 5, one item per
# event (title, url, tier by user, source name).  By message id mod 12:
# 0 clean array, 1 clean envelope with meta, 2 prose before the array,
# 3 stray quotes in the titles, 4 array cut inside the 4th item with
# '... [TRUNCATED', 5 envelope cut the same way with '…[TRUNCATED',
# 6 source_name missing on odd events, 7 no JSON at all, 8 an array that ends
# with a string and a number, 9 every title given twice (the last one counts),
# 10 a NaN in every item, 11 an envelope whose meta numbers are text.

MSG_SIZE = 5


def scanner_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    msg = F.floor(F.col("event_id") / MSG_SIZE).cast("bigint")
    kind = msg % 12
    eid = F.col("event_id").cast("string")
    title = F.when(kind == 3, F.concat(F.lit("Event "), eid, F.lit(' "'), F.col("event_type"), F.lit('" seen'))) \
             .otherwise(F.concat(F.lit("Event "), eid, F.lit(" "), F.col("event_type")))
    tier = F.element_at(F.array(*[F.lit(t) for t in TIERS]), (F.col("user_id") % 9 + 1).cast("int"))
    name = F.when((kind == 6) & (F.col("event_id") % 2 == 1), F.lit("")).otherwise(
        F.concat(F.lit(', "source_name": "user '), F.col("user_id").cast("string"), F.lit('"')))
    before = F.when(kind == 9, F.lit('"title": "old", ')).when(kind == 10, F.lit('"score": NaN, ')).otherwise(F.lit(""))
    item = F.concat(F.lit("{"), before, F.lit('"title": "'), title, F.lit('", "url": "https://ev.example/e/'), eid,
                    F.lit('", "source_tier": "'), tier, F.lit('"'), name, F.lit("}"))
    pos = (F.col("event_id") % MSG_SIZE + 1)
    g = (ev.select(msg.alias("msg_id"), kind.alias("kind"), F.struct(pos.alias("pos"), item.alias("x")).alias("e"))
           .groupBy("msg_id", "kind").agg(F.array_sort(F.collect_list("e")).alias("es")))
    allj = F.array_join(F.transform("es", lambda e: e["x"]), ", ")
    head3 = F.array_join(F.transform(F.filter("es", lambda e: e["pos"] <= 3), lambda e: e["x"]), ", ")
    part4 = F.coalesce(F.element_at(F.transform(F.filter("es", lambda e: e["pos"] == 4),
                                                lambda e: F.substring(e["x"], 1, 10)), 1), F.lit(""))
    k = F.col("kind")
    raw = (F.when(k == 1, F.concat(F.lit('{"items": ['), allj, F.lit('], "meta": {"scanned": '),
                                   (F.col("msg_id") * 10).cast("string"), F.lit(', "sweep_num": '),
                                   (F.col("msg_id") % 5).cast("string"), F.lit("}}")))
            .when(k == 2, F.concat(F.lit("Here are the results:\n["), allj, F.lit("]")))
            .when(k == 4, F.concat(F.lit("["), head3, F.lit(", "), part4, F.lit("... [TRUNCATED 99 chars]")))
            .when(k == 5, F.concat(F.lit('{"items": ['), head3, F.lit(", "), part4, F.lit("…[TRUNCATED")))
            .when(k == 7, F.lit("scanner failed: timeout after 300 s"))
            .when(k == 8, F.concat(F.lit("["), allj, F.lit(', "see above", 7]')))
            .when(k == 11, F.concat(F.lit('{"items": ['), allj, F.lit('], "meta": {"scanned": "'),
                                    (F.col("msg_id") * 10).cast("string"), F.lit('", "sweep_num": "3"}}')))
            .otherwise(F.concat(F.lit("["), allj, F.lit("]"))))
    return g.select("msg_id", raw.alias("raw"))


# the items each message should yield, from the events themselves
SCANNER_ITEMS_SQL = """
SELECT event_id // 5 AS msg_id, (event_id // 5) % 12 AS kind, CAST(event_id % 5 AS INTEGER) AS item_pos,
       CASE WHEN (event_id // 5) % 12 = 3 THEN 'Event ' || event_id || ' "' || event_type || '" seen'
            ELSE 'Event ' || event_id || ' ' || event_type END AS title,
       'https://ev.example/e/' || event_id AS url,
       ['1','2','3','3b','4','5','6','7','8'][CAST(user_id % 9 AS INTEGER) + 1] AS source_tier,
       CASE WHEN (event_id // 5) % 12 = 6 AND event_id % 2 = 1 THEN NULL ELSE 'user ' || user_id END AS source_name
FROM events
UNION ALL
SELECT msg_id, 8, CAST(n + i AS INTEGER), NULL, NULL, NULL, NULL
FROM (SELECT event_id // 5 AS msg_id, max(event_id % 5) + 1 AS n FROM events WHERE (event_id // 5) % 12 = 8 GROUP BY 1) m, range(2) r(i)
"""


# --- caption files from conversations ------------------------------------------
# Each conversation is a video (media_id = conv_id).  Its caption file: a
# WEBVTT header, then per turn a cue number, a cue time, the text lines
# (assistant lines wrapped in a voice tag; turn 2 opens with a line starting
# 'NOTE', which mutes the rest of that turn), after turn 1 its first line once
# more and a two-line NOTE block closed by a blank, then a blank.
# For the queries about missing captions only (``gaps``), videos with conv_id
# mod 3 = 0 have no caption file and with mod 7 = 0 the file holds no speech.
# Caption fetches fail there for conv_id mod 11 = 0.

def caption_lines(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    cv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    if gaps:
        cv = cv.where(F.col("conv_id") % 3 != 0)
    t = F.col("turn")
    raw = F.split(F.col("text"), "\n")
    raw = F.when(t == 2, F.concat(F.array(F.concat(F.lit("NOTE that "), F.element_at(raw, 1))),
                                  F.slice(raw, F.lit(2), F.size(raw)))).otherwise(raw)
    spoken = F.when(F.col("role") == "assistant",
                    F.transform(raw, lambda x: F.concat(F.lit("<v Assistant>"), x, F.lit("</v>")))).otherwise(raw)
    if gaps:
        spoken = F.when(F.col("conv_id") % 7 == 0, F.array().cast("array<string>")).otherwise(spoken)
    repeat = F.when(t == 1, F.slice(spoken, 1, 1)).otherwise(F.array().cast("array<string>"))
    note = F.when(t == 1, F.array(F.lit("NOTE generated by the fixture"), F.lit("second note line"), F.lit(""))) \
            .otherwise(F.array().cast("array<string>"))
    cue = F.array((t + 1).cast("string"),
                  F.concat(F.lit("00:"), F.lpad(t.cast("string"), 2, "0"), F.lit(":00.000 --> 00:"),
                           F.lpad((t + 1).cast("string"), 2, "0"), F.lit(":00.000")))
    block = F.concat(cue, spoken, repeat, note, F.array(F.lit("")))
    body = cv.select(F.col("conv_id").alias("media_id"), t, F.posexplode(block).alias("pos", "line")) \
             .select("media_id", (F.shiftleft(t.cast("bigint"), 32) + F.col("pos")).alias("line_no"), "line")
    header = cv.where(t == 0).select(F.col("conv_id").alias("media_id"), F.lit(-1).cast("bigint").alias("line_no"),
                                     F.lit("WEBVTT").alias("line"))
    return header.unionByName(body)


def caption_lines_sql(gaps: bool = False) -> str:
    silent = "conv_id % 7 = 0" if gaps else "false"
    return f"""
WITH cv AS (SELECT * FROM conversations {"WHERE conv_id % 3 <> 0" if gaps else ""}),
b AS (
  SELECT conv_id, turn,
    [CAST(turn + 1 AS VARCHAR), '00:' || lpad(CAST(turn AS VARCHAR), 2, '0') || ':00.000 --> 00:' || lpad(CAST(turn + 1 AS VARCHAR), 2, '0') || ':00.000']
    || CASE WHEN {silent} THEN []::VARCHAR[] ELSE sp END
    || CASE WHEN turn = 1 AND NOT ({silent}) THEN sp[1:1] ELSE []::VARCHAR[] END
    || CASE WHEN turn = 1 THEN ['NOTE generated by the fixture', 'second note line', ''] ELSE []::VARCHAR[] END
    || [''] AS block
  FROM (SELECT *, CASE WHEN role = 'assistant' THEN list_transform(rw, lambda x: '<v Assistant>' || x || '</v>') ELSE rw END AS sp
        FROM (SELECT *, CASE WHEN turn = 2 THEN ['NOTE that ' || string_split(text, chr(10))[1]] || string_split(text, chr(10))[2:]
                             ELSE string_split(text, chr(10)) END AS rw FROM cv) r) s)
SELECT conv_id AS media_id, CAST(-1 AS BIGINT) AS line_no, 'WEBVTT' AS line FROM cv WHERE turn = 0
UNION ALL
SELECT conv_id, CAST(turn * 4294967296 + generate_subscripts(block, 1) - 1 AS BIGINT), unnest(block) FROM b
"""


def caption_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files left by a caption download: one per turn, extension by (conv + turn) mod 7."""
    cv = read_table(spark, sf_dir, "conversations", "conv_id", "turn")
    exts = (".en.vtt", ".en-orig.vtt", ".vtt", ".en.srt", ".srt", ".txt", ".en.vtt.part")
    ext = F.element_at(F.array(*[F.lit(e) for e in exts]), ((F.col("conv_id") + F.col("turn")) % 7 + 1).cast("int"))
    return cv.select(F.col("conv_id").alias("media_id"),
                     F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_t"),
                              F.col("turn").cast("string"), ext).alias("file_name"))


CAPTION_FILES_SQL = """
SELECT conv_id AS media_id,
       'c' || conv_id || '_t' || turn || ['.en.vtt', '.en-orig.vtt', '.vtt', '.en.srt', '.srt', '.txt', '.en.vtt.part'][CAST((conv_id + turn) % 7 AS INTEGER) + 1] AS file_name
FROM conversations
"""


def media_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two metadata export shapes, one recording per turn: a search export (url, uploader or
    only channel, description) and a caption-tool export (webpage_url)."""
    cv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    media = F.shiftleft(F.col("turn").cast("bigint"), 32) + F.col("conv_id")
    cid = media.cast("string")
    search = cv.where(F.col("conv_id") % 2 == 0).select(
        media.alias("media_id"), F.concat(F.lit("Talk "), cid).alias("title"),
        F.when(F.col("conv_id") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("https://video.example/w/"), cid)).alias("url"),
        F.when(F.col("conv_id") % 6 == 0, F.lit(None)).otherwise(F.concat(F.lit("host "), cid)).alias("uploader"),
        F.concat(F.lit("channel "), cid).alias("channel"),
        F.lit("20240101").alias("upload_date"), (F.length("text") * 0.5).alias("duration"),
        (F.col("conv_id") * 10).alias("view_count"), F.col("text").alias("description"))
    tool = cv.where(F.col("conv_id") % 2 == 1).select(
        media.alias("media_id"), F.concat(F.lit("Talk "), cid).alias("title"),
        F.concat(F.lit("https://video.example/w/"), cid).alias("webpage_url"),
        F.concat(F.lit("host "), cid).alias("uploader"),
        F.lit("20240102").alias("upload_date"), (F.length("text") * 0.5).alias("duration"))
    return search.unionByName(tool, allowMissingColumns=True)
