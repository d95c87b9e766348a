"""Rule queries: URL specificity (C4), max age (C5), style flags (C6),
cross-source boost (D3), scan funnel (E8) and batching (F4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sift.functions.dates import is_recent, parse_date
from sift.functions.scoring import score
from sift.operators import rules
from sift.operators.dedup import canonical_seen
from sift.operators.rank import batches
from sift.plans import fixtures
from sift.sources.tables import read_table

ORDERS_NOW = "2001-08-01 00:00:00"
ITEMS_NOW = "2026-03-17 00:00:00"


def url_candidates(spark, sf_dir):
    """Every page URL, its host root, a /blog page and a /<lang>/news/ page,
    plus the registry's site URLs."""
    p = read_table(spark, sf_dir, "pages", "page_id", "url")
    root = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    lang = F.regexp_extract("url", r"^https?://[^/?#]+/([^/?#]+)", 1)
    kinds = F.array(
        F.struct(F.lit("page").alias("kind"), F.col("url").alias("u")),
        F.struct(F.lit("root").alias("kind"), F.concat(root, F.lit("/")).alias("u")),
        F.struct(F.lit("blog").alias("kind"), F.concat(root, F.lit("/blog")).alias("u")),
        F.struct(F.lit("news").alias("kind"), F.concat(root, F.lit("/"), lang, F.lit("/news/")).alias("u")))
    pages = p.select(F.col("page_id").cast("string").alias("cand_id"), F.inline(kinds)) \
             .select("cand_id", "kind", F.col("u").alias("url"))
    reg = fixtures.registry(spark, sf_dir).select(F.col("slug").alias("cand_id"), F.lit("site").alias("kind"),
                                                 F.col("site_url").alias("url"))
    return pages.unionByName(reg)


def q_url_specificity(spark, sf_dir):
    """C4: why a URL is not an article page (null reason = specific)."""
    out = rules.specificity(url_candidates(spark, sf_dir), fixtures.registry(spark, sf_dir))
    return out.select("cand_id", "kind", "url", "canonical_url", "reason")


def q_max_age(spark, sf_dir):
    """Orders as items dated by order date; urgent ones are landmarks."""
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_orderpriority")
    keep = rules.within_age(F.col("o_orderdate").cast("timestamp"), F.lit(ORDERS_NOW).cast("timestamp"),
                            F.col("o_orderpriority") == "1-URGENT")
    return o.where(keep).select("o_orderkey", (F.col("o_orderpriority") == "1-URGENT").alias("landmark"))


def q_style_flags(spark, sf_dir):
    """Banned-word hits and dash overuse per source and language."""
    d = read_table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    f = rules.style_flags(d)
    return f.groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("banned_hits").alias("banned_hits"),
        F.sum("dashes").alias("dashes"), F.count_if("dash_overuse").alias("n_dash_overuse"))


def q_cross_source_boost(spark, sf_dir):
    """D3: users (stories) seen in views (trending) and clicks (discussion)."""
    ev = read_table(spark, sf_dir, "events", "user_id", "event_type")
    return rules.cross_source_boost(ev, "user_id", "event_type", "view", "click")


def q_scan_funnel(spark, sf_dir):
    """Per source, items parsed → recent → specific → unseen → passed."""
    it = score(fixtures.items(spark, sf_dir))
    reg = fixtures.registry(spark, sf_dir)
    spec = rules.specificity(it, reg)
    seen = canonical_seen(fixtures.seen_urls(spark, sf_dir)).withColumn("_seen", F.lit(True))
    j = spec.join(seen, "canonical_url", "left")
    published = parse_date(F.col("date"))
    recent = is_recent(published, F.lit(ITEMS_NOW).cast("timestamp") - F.expr("INTERVAL 30 DAYS"))
    stages = [("recent", recent), ("specific", F.col("reason").isNull()),
              ("unseen", F.col("_seen").isNull()), ("passed", ~F.col("verdict").eqNullSafe("FAIL"))]
    return rules.funnel(j, "source_name", stages)


def q_batches(spark, sf_dir):
    """orders in key order, batches of 20 (one batch up to 50 items)."""
    o = read_table(spark, sf_dir, "orders", "o_orderkey")
    return batches(o, "o_orderkey").select("o_orderkey", "ord", "batch_id")
