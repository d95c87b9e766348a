"""Curation plans over the item fixture: score → dedup → cap → render (H4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sift.functions.scoring import score
from sift.functions.urls import canonical_url
from sift.operators import dedup as dd
from sift.operators import digest as dg
from sift.operators.rank import top_n, top_n_ranked
from sift.plans import fixtures

DIGEST_DATE = "2026-03-17"
GENERATED_AT = "2026-03-17 06:00"
TOP_CAP = 25
DIGEST_CAP = 30


def scored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(fixtures.items(spark, sf_dir))


def q_score_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4 + B5 over every item."""
    s = scored_items(spark, sf_dir)
    return s.select("doc_id",
                    F.col("scores.R").alias("score_r"), F.col("scores.Q").alias("score_q"),
                    F.col("scores.N").alias("score_n"), F.col("scores.A").alias("score_a"),
                    F.col("scores.S").alias("score_s"), "weighted", "verdict")


def q_canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1 over every item URL (four decorations of every page)."""
    it = fixtures.items(spark, sf_dir)
    return it.select("doc_id", "url", canonical_url(F.col("url")).alias("canonical_url"))


def kept_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dd.dedup(scored_items(spark, sf_dir), fixtures.seen_urls(spark, sf_dir))


def q_seen_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 + D1: FAIL and already-seen items removed."""
    return kept_items(spark, sf_dir).select("doc_id", "canonical_url", "weighted", "verdict")


def q_top_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: best 25 after dedup, ties in input order."""
    return top_n_ranked(kept_items(spark, sf_dir), TOP_CAP).select(
        F.col("rank").cast("bigint").alias("rank"), "doc_id", "weighted")


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.items(spark, sf_dir).agg(F.count(F.lit(1)).alias("scanned"))


def digest(spark: SparkSession, sf_dir: str, cap: int, coverage: DataFrame | None = None,
           sweep_num: int | None = None) -> DataFrame:
    kept = top_n(kept_items(spark, sf_dir), cap, materialize=True)
    return dg.render(kept, DIGEST_DATE, scanned=_scanned(spark, sf_dir), coverage=coverage,
                     sweep_num=sweep_num, generated_at=GENERATED_AT)


def q_digest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the best 30 unseen items."""
    return digest(spark, sf_dir, DIGEST_CAP)


def q_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4: the whole curation without a cap (every unseen passing item)."""
    return digest(spark, sf_dir, 0)


def q_digest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5: scanned / passed / must-reads of the uncapped digest."""
    kept = kept_items(spark, sf_dir)
    st = dg.digest_stats(kept, [])
    return st.select(_scanned(spark, sf_dir).select("scanned").scalar().alias("scanned"),
                     "passed", "must_reads")


def q_category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items per listed category, empty categories kept, fixed order."""
    return dg.category_rollup(kept_items(spark, sf_dir)).select(
        F.col("category_ord").cast("int").alias("category_ord"), "category", "n_items")
