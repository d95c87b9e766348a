"""Story queries: near-copy grouping (F6) and one item per story."""

from __future__ import annotations

from pyspark.sql import functions as F

from sift.functions.scoring import score
from sift.operators import stories
from sift.plans import fixtures
from sift.sources.tables import read_table

PRIMARY_TIERS = ("1", "2", "3")


def story_texts(spark, sf_dir):
    """Documents (id = doc_id) and benchmark passages (id = -(item_id + 1))."""
    d = read_table(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), "text")
    b = read_table(spark, sf_dir, "benchmark", "item_id", "text").select((-F.col("item_id") - 1).alias("id"), "text")
    return d.unionByName(b)


def q_story_groups(spark, sf_dir):
    """story id of every text (least id among its near copies)."""
    return stories.story_groups(story_texts(spark, sf_dir), "id", "text")


def q_best_per_story(spark, sf_dir):
    """per story the primary-source, best-scored, earliest item."""
    it = score(fixtures.items(spark, sf_dir))
    reg = fixtures.registry(spark, sf_dir).select(F.col("slug").alias("source_name"),
                                                 F.col("tier").isin(*PRIMARY_TIERS).alias("is_primary"))
    st = stories.story_groups(story_texts(spark, sf_dir), "id", "text").withColumnRenamed("id", "doc_id")
    j = (it.join(reg, "source_name", "left").join(st, "doc_id")
           .withColumn("is_primary", F.coalesce("is_primary", F.lit(False))))    # unknown source: commentary
    best = stories.best_per_story(j.select("story_id", "doc_id", "input_ord", "weighted", "is_primary"))
    return best.select("story_id", "doc_id", "weighted", "is_primary", "n_items")
