"""Story grouping (F6) and one item per story.

F6: two texts are near copies when the Jaccard similarity of their sets of
five-word shingles is at least ``PERCENT`` / 100; stories are the connected
components of that relation.  The join is the exact one of
``sift.llm.jaccard_join``, on texts whose words are lower-cased and parted by
one space, so it needs that subpackage when it is called.

Equal texts are one story, also without words.  A null text is a copy of
nothing and is its own story.  A least id that stands for two texts joins
their stories.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sift.operators.components import components
from sift.session import ensure_checkpoint_dir

PERCENT = 80


def plain_words(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")


def story_groups(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, story_id`` for every text (story_id = least id in the story)."""
    from sift.llm.jaccard_join import LEAF, PIVOTS, JaccardJoin
    from sift.llm.scratch import stage

    ensure_checkpoint_dir(texts.sparkSession)
    plain = stage(texts.where(F.col(text_col).isNotNull())
                       .select(F.col(id_col).alias("id"), F.md5(F.col(text_col)).alias("_h"), plain_words(F.col(text_col)).alias("text")), "plain-texts")
    keyed = plain.select("id", "_h", F.xxhash64("text").alias("text_hash"))
    reps = keyed.groupBy("_h").agg(F.min("id").alias("rep"), F.first("text_hash").alias("text_hash"))
    near = JaccardJoin(plain, "id", "text", PERCENT, LEAF, PIVOTS).run()
    near = near.select(F.col("doc_id").alias("rep"), "text_hash", "component_id").distinct()
    story = stage(reps.join(near, ["rep", "text_hash"], "left").select("_h", "rep", F.coalesce("component_id", "rep").alias("story_id")), "stories")
    both = (story.groupBy("rep").agg(F.min("story_id").alias("b"), F.collect_set("story_id").alias("all"))
                 .where(F.size("all") > 1).select(F.explode("all").alias("a"), "b"))
    merged = components(both).select(F.col("node").alias("story_id"), "component")
    story = story.join(merged, "story_id", "left").select("_h", F.coalesce("component", "story_id").alias("story_id"))
    textless = texts.where(F.col(text_col).isNull()).select(F.col(id_col), F.col(id_col).alias("story_id"))
    return keyed.join(story, "_h").select(F.col("id").alias(id_col), "story_id").unionByName(textless)


def best_per_story(items: DataFrame, story_col: str = "story_id",
                   primary_col: str = "is_primary", order_col: str = "input_ord") -> DataFrame:
    """per story the item to keep — primary source first, then the best
    weighted score, then input order.  A ``max_by`` aggregate, so a story
    holding most items is combined map-side instead of in one window task."""
    rank_key = F.struct(F.coalesce(F.col(primary_col), F.lit(False)).alias("p"),
                        F.coalesce(F.col("weighted"), F.lit(0.0)).alias("w"),
                        (-F.col(order_col)).alias("o"))
    return (items.groupBy(story_col)
                 .agg(F.max_by(F.struct(*[c for c in items.columns if c != story_col]), rank_key).alias("best"),
                      F.count(F.lit(1)).alias("n_items"))
                 .select(story_col, "best.*", "n_items"))
