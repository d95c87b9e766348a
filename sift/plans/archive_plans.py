"""Archive queries: latest digest (A8), URL extraction (A9), next name."""

from __future__ import annotations

from pyspark.sql import functions as F

from sift.plans import fixtures
from sift.sources import archive as ar


def q_latest_digest(spark, sf_dir):
    """Newest digest per folder by (date, suffix)."""
    return ar.latest_digest(fixtures.archive_files(spark, sf_dir), ["folder"])


def q_extract_urls(spark, sf_dir):
    """Unique URLs per text with their first position."""
    return ar.unique_urls(fixtures.url_texts(spark, sf_dir), ["doc_id"]).select(
        "doc_id", "url", F.col("first_pos").cast("int").alias("first_pos"))


def q_next_digest_name(spark, sf_dir):
    """First free file name per folder for a digest on its latest order date."""
    files = fixtures.archive_files(spark, sf_dir)
    wanted = files.groupBy("folder").agg(F.max("order_date").alias("digest_date"))
    return ar.next_sequence(files, wanted, ["folder"]).select(
        "folder", "digest_date", F.col("digest_seq").cast("bigint").alias("digest_seq"), "file_name")
