"""Source registry: scan (A1), listing (A2), tier filter (C3), enrichment (D2),
per-tier counts (E7), feed health (A7) and copy reconciliation (D4).

The registry is a small dimension (one row per source).  Joins against it
carry no broadcast hint: AQE measures the scanned side at run time and
broadcasts it when it is under the threshold, keeping a shuffle join when a
registry grows past it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
NO_FEED_LABEL = "(no feed — WebSearch fallback)"
ALIVE_MIN_BYTES = 100          # a body of more bytes counts as alive
STATUS_ALIVE, STATUS_DEAD, STATUS_NO_FEED = "alive", "dead", "no_feed"
# ---------------------------------------------------------------------------

REGISTRY_SCHEMA = ("sources array<struct<slug:string,name:string,site_url:string,"
                   "feed_url:string,tier:string>>")


def read_registry_json(spark: SparkSession, path: str) -> DataFrame:
    """A1: the registry document (``{"sources": [...]}``) as rows."""
    doc = spark.read.schema(REGISTRY_SCHEMA).option("multiLine", "true").json(path)
    return doc.select(F.inline("sources"))


# Form of the prose registry: a heading for each tier, a bullet for one source or several.
TIER_HEADING = r"(?m)^### Tier (\w+):.*$"
BULLET = r"(?m)^- (.*)$"
DESCRIPTION = r"(?s) — .*$"                   # behind the names
SITE = r"^([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?:/[^\s,)]*)?)"   # in parentheses behind a name; other remarks are no site


def read_registry_prose(spark: SparkSession, path: str) -> DataFrame:
    """The registry's prose copy (markdown) as rows ``name, site_url, tier``.

    A bullet reads ``- Name (site) — remark``, ``- Name (site), Name (site)`` or
    ``- Label: name, name``; a label goes before each of its names, and a single
    site at the end of a bullet is that of all its names.  Lines outside the tier
    headings are not read.
    """
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"\r\n?", "\n").alias("text"))
    # the first piece stands before the first tier; a section ends at the next heading of any level
    sections = F.arrays_zip(F.regexp_extract_all("text", F.lit(TIER_HEADING), 1).alias("tier"),
                            F.slice(F.split("text", TIER_HEADING, -1), F.lit(2), F.greatest(F.size(F.split("text", TIER_HEADING, -1)) - 1, F.lit(0))).alias("body"))
    bullets = (text.select(F.inline(sections))
                   .select("tier", F.explode(F.regexp_extract_all(F.regexp_extract("body", r"(?s)^(.*?)(?:\n#.*)?$", 1), F.lit(BULLET), 1)).alias("bullet")))
    head = F.trim(F.regexp_replace("bullet", DESCRIPTION, ""))
    label = F.regexp_extract(head, r'^([^:("]+): ', 1)
    names = F.split(F.regexp_replace(head, r'^[^:("]+: ', ""), r",\s+(?![^(]*\))")
    parts = F.transform(names, lambda n: F.struct(F.trim(F.regexp_replace(n, r"\s*\([^)]*\)\s*$", "")).alias("name"),
                                                 F.regexp_extract(F.regexp_extract(n, r"\(([^)]*)\)\s*$", 1), SITE, 1).alias("site")))
    listed = bullets.select("tier", label.alias("label"), parts.alias("parts"))
    sites = F.filter(F.transform("parts", lambda p: p["site"]), lambda site: site != "")
    shared = F.when((F.size(sites) == 1) & (F.element_at("parts", -1)["site"] != ""), F.element_at(sites, 1)).otherwise(F.lit(""))
    rows = listed.select("tier", "label", shared.alias("shared"), F.explode("parts").alias("p")).where(F.col("p.name") != "")
    site = F.coalesce(F.nullif(F.col("p.site"), F.lit("")), F.nullif(F.col("shared"), F.lit("")))
    return rows.select(F.concat(F.when(F.col("label") != "", F.concat("label", F.lit(" "))).otherwise(F.lit("")), F.col("p.name")).alias("name"),
                       F.concat(F.lit("https://"), site).alias("site_url"), "tier")


def has_feed(c: Column = None) -> Column:
    c = F.col("feed_url") if c is None else c
    return F.coalesce(F.length(c) > 0, F.lit(False))


def parse_tiers(tier_list: str | None) -> list[str] | None:
    """Comma list → trimmed tier ids (None/empty → no filter)."""
    if not tier_list:
        return None
    return [t.strip() for t in tier_list.split(",")]


def filter_tiers(registry: DataFrame, tiers: list[str] | None) -> DataFrame:
    """Keep the listed tiers (pushed into the registry scan)."""
    return registry if not tiers else registry.where(F.col("tier").isin(*tiers))


def listing(registry: DataFrame, only_no_feed: bool = False, only_has_feed: bool = False) -> DataFrame:
    """A2: one line per source; no-feed wins when both flags are given."""
    if only_no_feed:
        registry = registry.where(~has_feed())
    elif only_has_feed:
        registry = registry.where(has_feed())
    shown = F.coalesce(F.nullif(F.col("feed_url"), F.lit("")), F.lit(NO_FEED_LABEL))
    return registry.select("slug", F.concat(F.lit("[Tier "), F.col("tier"), F.lit("] "), F.col("name"),
                                            F.lit(": "), shown).alias("line"))


def per_tier(registry: DataFrame) -> DataFrame:
    """Sources and sources with a feed per tier."""
    return registry.groupBy("tier").agg(F.count(F.lit(1)).alias("n_sources"),
                                        F.count_if(has_feed()).alias("n_feeds"))


def enrich(items: DataFrame, registry: DataFrame, key: str = "source") -> DataFrame:
    """Add ``source_tier`` and ``source_name`` by the registry slug."""
    reg = registry.select(F.col("slug").alias(key), F.col("tier").alias("source_tier"),
                          F.col("name").alias("source_name"))
    return items.join(reg, key, "inner")


def feed_health(registry: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Per source alive / dead / no_feed from its latest snapshot.

    ``snapshots``: ``feed_url, snapshot_ord, body, n_items`` (items parsed).
    A feed with no snapshot (fetch failed) is dead.
    """
    # lengths, not bodies, go through the aggregate
    sized = snapshots.select("feed_url", "snapshot_ord", F.struct(F.octet_length("body").alias("n_bytes"), "n_items").alias("s"))
    latest = sized.groupBy("feed_url").agg(F.max_by("s", "snapshot_ord").alias("s")).select("feed_url", "s.n_bytes", "s.n_items")
    j = registry.join(latest, "feed_url", "left")
    status = (F.when(~has_feed(), F.lit(STATUS_NO_FEED))
               .when(F.coalesce(F.col("n_bytes"), F.lit(0)) > ALIVE_MIN_BYTES, F.lit(STATUS_ALIVE))
               .otherwise(F.lit(STATUS_DEAD)))
    return j.select("name", F.col("feed_url").alias("url"), status.alias("status"),
                    F.when(status == STATUS_ALIVE, F.col("n_items")).alias("n_items"))


def health_counts(health: DataFrame) -> DataFrame:
    """A7 summary: number of sources per status."""
    return health.groupBy("status").agg(F.count(F.lit(1)).alias("n_sources"))


def name_key(c: Column) -> Column:
    """Normalised source name used to match registry copies."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}]+", " ")


def site_key(c: Column) -> Column:
    """A site as both copies write it: without a trailing slash."""
    return F.regexp_replace(c, "/+$", "")


def reconcile(left: DataFrame, right: DataFrame, cols: tuple[str, ...] = ("tier", "feed_url", "site_url")) -> DataFrame:
    """Full outer join of two registry copies by normalised name →
    ``only_left``, ``only_right`` or ``changed`` (one of ``cols`` differs)."""
    lk = left.select(name_key(F.col("name")).alias("name_key"),
                     *[F.col(c).alias(f"l_{c}") for c in cols], F.col("name").alias("l_name"))
    rk = right.select(name_key(F.col("name")).alias("name_key"),
                      *[F.col(c).alias(f"r_{c}") for c in cols], F.col("name").alias("r_name"))
    j = lk.join(rk, "name_key", "full_outer")
    differs = None
    for c in cols:
        d = ~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))
        differs = d if differs is None else differs | d
    kind = (F.when(F.col("r_name").isNull(), F.lit("only_left"))
             .when(F.col("l_name").isNull(), F.lit("only_right"))
             .when(differs, F.lit("changed")))
    return j.select("name_key", kind.alias("kind"), "l_tier", "r_tier").where(F.col("kind").isNotNull())
