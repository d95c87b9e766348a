"""Coverage queries over the events-derived manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sift.operators import coverage as cv
from sift.plans import curation, fixtures


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.merge_sources(fixtures.manifest_entries(spark, sf_dir))


def q_coverage_sources(spark, sf_dir):
    """Last status per source, first position kept."""
    return merged(spark, sf_dir)


def q_coverage_by_status(spark, sf_dir):
    """E2."""
    return cv.by_status(merged(spark, sf_dir))


def q_coverage_totals(spark, sf_dir):
    """E3."""
    return cv.totals(merged(spark, sf_dir))


def q_coverage_missed(spark, sf_dir):
    """E4."""
    return cv.missed(merged(spark, sf_dir)).select(
        F.col("source_name").alias("name"), "scanner", "status", "error", "first_manifest", "first_entry")


def q_digest_with_coverage(spark, sf_dir):
    """H2: capped digest whose footer carries the coverage line and a sweep tag."""
    return curation.digest(spark, sf_dir, curation.DIGEST_CAP,
                           coverage=cv.report(merged(spark, sf_dir)), sweep_num=3)
