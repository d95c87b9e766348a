"""Malformed-JSON queries over the events-derived scanner output."""

from __future__ import annotations

from pyspark.sql import functions as F

from sift.plans import fixtures
from sift.sources import jsonfix as jf


def recovered(spark, sf_dir):
    return jf.recover(fixtures.scanner_texts(spark, sf_dir))


def q_json_recovery(spark, sf_dir):
    """A10: every recovered item with the path that recovered it."""
    it = jf.items_of(recovered(spark, sf_dir))
    return it.select("msg_id", F.col("item_pos").cast("int").alias("item_pos"), "outcome",
                     F.col("item")["title"].alias("title"), F.col("item")["url"].alias("url"),
                     F.col("item")["source_tier"].alias("source_tier"),
                     F.col("item")["source_name"].alias("source_name"))


def q_json_strict_items(spark, sf_dir):
    """Items that have all four required keys."""
    it = jf.items_of(recovered(spark, sf_dir), strict=True)
    return it.select("msg_id", F.col("item_pos").cast("int").alias("item_pos"))


def q_json_recovery_stats(spark, sf_dir):
    """Texts, items and strict drops per outcome."""
    return jf.recovery_stats(recovered(spark, sf_dir))


def q_envelope_settings(spark, sf_dir):
    """Run settings per text; meta beats defaults (no arguments given)."""
    u = jf.unwrap(recovered(spark, sf_dir))
    return u.select("msg_id", "outcome", F.coalesce("kind", F.lit("none")).alias("kind"),
                    F.col("scanned").cast("bigint").alias("scanned"),
                    F.col("sweep_num").cast("bigint").alias("sweep_num"))
