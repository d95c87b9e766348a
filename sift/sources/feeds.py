"""Landed feed snapshots → items.

One ``from_xml`` call with a union schema reads RSS 2.0 (``channel.item``),
RSS 1.0/RDF (top-level ``item``) and Atom (``entry``); PERMISSIVE mode puts a
malformed body into ``_corrupt`` instead of failing the job, and such
snapshots yield no items but are counted.  Parallelism is the partitioning
of the snapshot table; there is no per-row Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sift.functions.dates import cutoff, is_recent, parse_date
from sift.functions.text import first_nonempty, trimmed, truncate_summary
from sift.session import ensure_checkpoint_dir
from sift.sources.registry import enrich, has_feed

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
VIDEO_HOST = "youtube.com"
VIDEO_URL = "https://www.youtube.com/watch?v="
DEFAULT_LINK_REL = "alternate"
# ---------------------------------------------------------------------------

ATOM_NAMESPACE = "http://www.w3.org/2005/Atom"

# Elements that a feed may repeat are arrays, of which the first counts; Spark keeps the last of a plain field.
_RSS_ITEM = ("struct<title:string,link:string,`dc:creator`:array<string>,author:array<string>,"
             "pubDate:string,description:string>")
_ATOM_ENTRY = ("struct<title:string,link:array<struct<_rel:string,_href:string>>,"
               "author:array<struct<name:string>>,published:string,updated:string,summary:string,"
               "content:string,`yt:videoId`:string>")
FEED_SCHEMA = (f"struct<channel:struct<item:array<{_RSS_ITEM}>>,item:array<{_RSS_ITEM}>,"
               f"entry:array<{_ATOM_ENTRY}>,_corrupt:string>")
XML_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}

ITEM_COLS = ["title", "url", "author", "date", "summary"]


def _s(c: Column) -> Column:
    return F.coalesce(trimmed(c), F.lit(""))


def unprefixed_atom(body: Column) -> Column:
    """A feed whose Atom elements carry a prefix, without that prefix."""
    root = r"^\s*(?:<\?[^>]*>\s*|<!--(?s:.*?)-->\s*)*<([A-Za-z_][\w.-]*):feed\b[^>]*" + ATOM_NAMESPACE
    prefix = F.regexp_extract(body, root, 1)
    return F.when(prefix != "", F.regexp_replace(body, F.concat(F.lit("(</?)"), prefix, F.lit(":")), F.lit("$1"))).otherwise(body)


def _first(values: Column) -> Column:
    return F.try_element_at(values, F.lit(1))


def parse_snapshots(snapshots: DataFrame, body_col: str = "body") -> DataFrame:
    """A5: add ``feed`` (parsed) and ``format`` ∈ atom / rss / rdf / bad / empty."""
    parsed = snapshots.withColumn("feed", F.from_xml(unprefixed_atom(F.col(body_col)), FEED_SCHEMA, XML_OPTIONS))
    f = F.col("feed")
    fmt = (F.when(f["entry"].isNotNull(), F.lit("atom"))
            .when(f["channel"]["item"].isNotNull(), F.lit("rss"))
            .when(f["item"].isNotNull(), F.lit("rdf"))
            .when(f["_corrupt"].isNotNull() | f.isNull(), F.lit("bad"))
            .otherwise(F.lit("empty")))
    return parsed.withColumn("format", fmt)


def _rss_fields(it: Column) -> Column:
    """A3: title, link, creator→author, pubDate, description."""
    return F.struct(
        _s(it["title"]).alias("title"),
        _s(it["link"]).alias("url"),
        F.coalesce(trimmed(first_nonempty(_first(it["dc:creator"]), _first(it["author"]))), F.lit("")).alias("author"),
        _s(it["pubDate"]).alias("date"),
        truncate_summary(_s(it["description"])).alias("summary"))


def choose_link(links: Column) -> Column:
    """First link with rel alternate (no rel = alternate), else the first one's href."""
    alt = F.filter(links, lambda l: F.coalesce(l["_rel"], F.lit(DEFAULT_LINK_REL)) == DEFAULT_LINK_REL)
    first_alt = F.try_element_at(alt, F.lit(1))
    first_any = F.try_element_at(F.filter(links, lambda l: F.coalesce(l["_href"], F.lit("")) != ""), F.lit(1))
    return F.coalesce(first_alt["_href"], first_any["_href"], F.lit(""))


def _atom_fields(e: Column) -> Column:
    """A4 (+B8, B9): link choice, author name, published→updated, summary→content."""
    link = choose_link(e["link"])
    vid = F.coalesce(e["yt:videoId"], F.lit(""))
    link = F.when((vid != "") & ~link.contains(VIDEO_HOST), F.concat(F.lit(VIDEO_URL), vid)).otherwise(link)
    return F.struct(
        _s(e["title"]).alias("title"),
        link.alias("url"),
        _s(_first(e["author"])["name"]).alias("author"),
        F.coalesce(trimmed(first_nonempty(e["published"], e["updated"])), F.lit("")).alias("date"),
        truncate_summary(F.coalesce(trimmed(first_nonempty(e["summary"], e["content"])), F.lit(""))).alias("summary"))


def snapshot_items(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """A3/A4: one row per item with its position in the snapshot."""
    f = F.col("feed")
    items = (F.when(F.col("format") == "atom", F.transform(f["entry"], _atom_fields))
              .when(F.col("format") == "rss", F.transform(f["channel"]["item"], _rss_fields))
              .when(F.col("format") == "rdf", F.transform(f["item"], _rss_fields)))
    return (parsed.select(*keep, "format", F.posexplode(items).alias("item_pos", "it"))
                  .select(*keep, "format", "item_pos", *[F.col(f"it.{c}").alias(c) for c in ITEM_COLS]))


def read_large(spark: SparkSession, path: str, tag: str = "item") -> tuple[DataFrame, DataFrame]:
    """A3/A4 for feed files of any size: (items, quarantine), read item by item in parallel.

    ``tag`` is the element of an item (``item`` for RSS and RDF, ``entry`` for
    Atom, with its prefix if the feed gives it one).  The text source cuts the
    file at the element's end tag, which Hadoop's reader does across splits, so
    one file is read by as many tasks as it has splits, and only an item has to
    fit in memory.  Each item is parsed on its own by the schema of the small
    path.  ``item_pos`` counts from 0 in each file: the items of the splits before,
    then the place in the split (a few rows for each split; no sort of the items).
    An item that is no XML, or whose CDATA holds the end tag, goes to the
    quarantine with its text; what stands behind the last item is no item.
    """
    atom = tag.rpartition(":")[2] == "entry"
    kind = (_ATOM_ENTRY if atom else _RSS_ITEM)[:-1] + ",_corrupt:string>"
    end = f"</{tag}>"
    found = (spark.read.option("lineSep", end).text(path)
                  .select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("split"),
                          F.monotonically_increasing_id().alias("id"), F.col("value")))
    start = rf"(?s)<{tag}[\s>/].*$"
    body = F.regexp_extract("value", start, 0)
    prefix = tag.rpartition(":")[0]
    plain = F.regexp_replace(F.concat(body, F.lit(end)), rf"(</?){prefix}:", "$1") if prefix else F.concat(body, F.lit(end))
    whole = F.when(body != "", plain)
    # rows are numbered as they were read, and written once: the numbers do not change afterwards
    read = found.select("file_path", "split", "id", F.col("value").contains("<rdf:RDF").alias("rdf"), whole.alias("text"))
    read = read.withColumn("it", F.from_xml("text", kind, XML_OPTIONS))
    read = read.select("file_path", "split", "id", "rdf", F.when(F.col("it._corrupt").isNotNull() | F.col("it").isNull(), F.col("text")).alias("bad"),
                       (_atom_fields if atom else _rss_fields)(F.col("it")).alias("it"), F.col("text").isNotNull().alias("is_item"))
    ensure_checkpoint_dir(spark)
    read = read.checkpoint()
    splits = read.groupBy("file_path", "split").agg(F.min("id").alias("first"), F.count_if("is_item").alias("n"), F.max("rdf").alias("rdf"))
    before = Window.partitionBy("file_path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("file_path")
    placed = splits.select("file_path", "split", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("passed"), F.max("rdf").over(every).alias("is_rdf"))
    rows = read.where("is_item").join(placed, ["file_path", "split"]).withColumn("item_pos", F.col("passed") + F.col("id") - F.col("first"))
    fmt = F.lit("atom") if atom else F.when(F.col("is_rdf"), F.lit("rdf")).otherwise(F.lit("rss"))
    items = rows.where(F.col("bad").isNull()).select("file_path", fmt.alias("format"), "item_pos", *[F.col(f"it.{c}").alias(c) for c in ITEM_COLS])
    return items, rows.where(F.col("bad").isNotNull()).select("file_path", "item_pos", F.col("bad").alias("text"))


def item_counts(parsed: DataFrame) -> Column:
    f = F.col("feed")
    return F.coalesce(F.size(f["entry"]), F.size(f["channel"]["item"]), F.size(f["item"]), F.lit(0))


def ingest(snapshots: DataFrame, registry: DataFrame, timeframe: str, now: str,
           tiers: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Snapshots ⋈ registry(feed_url) → parse → cutoff (C2) → tier/name.

    Returns (items, quarantine): quarantine holds malformed snapshots and those
    that look like a feed but gave no item, with the reason.
    """
    reg = registry.where(has_feed())
    if tiers:
        reg = reg.where(F.col("tier").isin(*tiers))
    joined = snapshots.join(reg.select("feed_url", "slug"), "feed_url")
    parsed = parse_snapshots(joined)
    quarantine = parsed.where(F.col("format").isin("bad", "empty")).select(
        "feed_url", "snapshot_ord", F.col("format").alias("reason"), "body")
    items = snapshot_items(parsed, ["feed_url", "slug", "snapshot_ord"])
    now_ts = F.lit(now).cast("timestamp")
    items = items.withColumn("published_at", parse_date(F.col("date")))
    items = items.where(is_recent(F.col("published_at"), cutoff(F.lit(timeframe), now_ts)))
    return enrich(items, registry, "slug"), quarantine
