"""Intake queries: dates, timeframes, registry, feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from sift.functions.dates import cutoff, is_recent, parse_date
from sift.functions.text import cut_description, truncate_summary
from sift.plans import fixtures
from sift.sources import feeds, registry as rg
from sift.sources.tables import read_table

FEED_TIMEFRAME = "60 days"
FEED_NOW = "2026-03-17 00:00:00"
TIER_LIST = " 1, 3b "


def q_parse_dates(spark, sf_dir):
    """B2: ten date styles parsed back to an instant (epoch microseconds)."""
    t = fixtures.date_texts(spark, sf_dir)
    return t.select("event_id", "date_text", F.unix_micros(parse_date(F.col("date_text"))).alias("parsed_us"))


def q_timeframe_cutoffs(spark, sf_dir):
    """B3 + C2: cutoff per timeframe text and the recency flag of the event."""
    t = fixtures.timeframes(spark, sf_dir)
    now = F.lit(fixtures.EVENTS_NOW).cast("timestamp")
    c = cutoff(F.col("timeframe"), now)
    return t.select("event_id", "timeframe", F.unix_micros(c).alias("cutoff_us"),
                    is_recent(F.col("ts").cast("timestamp"), c).alias("is_recent"))


def q_registry_tiers(spark, sf_dir):
    """A1 + C3: registry rows of the tiers in a comma list."""
    reg = rg.filter_tiers(fixtures.registry(spark, sf_dir), rg.parse_tiers(TIER_LIST))
    return reg.select("slug", "name", "tier")


def q_registry_listing(spark, sf_dir):
    """A2: listing lines with the no-feed fallback label."""
    reg = fixtures.registry(spark, sf_dir)
    return rg.listing(reg).join(reg.select("slug", rg.has_feed().alias("has_feed")), "slug")


def q_sources_per_tier(spark, sf_dir):
    """E7."""
    return rg.per_tier(fixtures.registry(spark, sf_dir))


def q_registry_reconcile(spark, sf_dir):
    """Differences between two registry copies."""
    return rg.reconcile(fixtures.registry(spark, sf_dir), fixtures.registry_copy(spark, sf_dir))


def q_source_enrichment(spark, sf_dir):
    """Documents get their source's tier and name."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "source")
    return rg.enrich(docs, fixtures.registry(spark, sf_dir)).select("doc_id", "source", "source_tier", "source_name")


def q_feed_items(spark, sf_dir):
    """A3-A6 (+B6, B8, B9, C2, D2): items of the landed snapshots."""
    items, _ = feeds.ingest(fixtures.feed_snapshots(spark, sf_dir), fixtures.registry(spark, sf_dir),
                            FEED_TIMEFRAME, FEED_NOW)
    return items.select("feed_url", "snapshot_ord", F.col("item_pos").cast("int").alias("item_pos"), "format",
                        "title", "url", "author", "date", "summary", "source_tier", "source_name")


def q_feed_quarantine(spark, sf_dir):
    """A5: malformed snapshots are set aside, not fatal."""
    _, bad = feeds.ingest(fixtures.feed_snapshots(spark, sf_dir), fixtures.registry(spark, sf_dir),
                          FEED_TIMEFRAME, FEED_NOW)
    return bad.select("feed_url", "snapshot_ord")


def _health(spark, sf_dir):
    snaps = feeds.parse_snapshots(fixtures.feed_snapshots(spark, sf_dir))
    snaps = snaps.select("feed_url", "snapshot_ord", "body", feeds.item_counts(snaps).alias("n_items"))
    return rg.feed_health(fixtures.registry(spark, sf_dir), snaps)


def q_feed_health(spark, sf_dir):
    """Alive / dead / no_feed per source from its latest snapshot."""
    return _health(spark, sf_dir).select("name", "url", "status", F.col("n_items").cast("int").alias("n_items"))


def q_feed_health_counts(spark, sf_dir):
    """A7 summary counts."""
    return rg.health_counts(_health(spark, sf_dir))


def q_summary_truncation(spark, sf_dir):
    """Summary cut to 497 + '...' past 500 chars; descriptions cut at 500."""
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", truncate_summary(F.col("text")).alias("summary"),
                    cut_description(F.col("text")).alias("description"))
