"""Curation rules stated in prose by the reference.

Each rule is a column predicate or a keyed aggregate; lists the reference
only names by example are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sift.functions.scoring import verdict
from sift.functions.urls import canonical_url

# Words that mark a section, index or archive page when they are the last
# path segment (the reference gives examples only: /blog, /news, the bare
# host).  A parameter, not a fixed value.
SECTION_WORDS = ("blog", "news", "archive", "archives", "posts", "articles", "category",
                 "categories", "tag", "tags", "topics", "papers", "research", "index", "latest")
# Style flags: banned words are named only by example ("delve", "paradigm");
# dash overuse means at least this many dashes in one text.
BANNED_WORDS = ("delve", "paradigm")
DASH_LIMIT = 3
CROSS_SOURCE_BOOST = 0.5          # the rule gives no size
MAX_SCORE = 5.0                   # the rubric's axes end at 5


def url_path(canonical: Column) -> Column:
    return F.regexp_extract(canonical, r"^(?:[a-z][a-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def specificity(urls: DataFrame, registry: DataFrame, url_col: str = "url",
                words: tuple[str, ...] = SECTION_WORDS) -> DataFrame:
    """C4: ``reason`` is homepage / registry_site / section, null if specific.

    The registry's site URLs are canonicalised and matched with a left join on
    the canonical key (a small dimension: AQE broadcasts it when it is small).
    """
    sites = (registry.where(F.col("site_url").isNotNull())
                     .select(canonical_url(F.col("site_url")).alias("_site")).distinct()
                     .withColumn("_is_site", F.lit(True)))
    keyed = urls.withColumn("_canon", canonical_url(F.col(url_col)))
    j = keyed.join(sites, keyed["_canon"] == sites["_site"], "left")
    path = url_path(F.col("_canon"))
    last = F.lower(F.regexp_extract(path, r"([^/]*)/*$", 1))
    reason = (F.when(F.regexp_replace(path, "/", "") == "", F.lit("homepage"))
               .when(F.col("_is_site"), F.lit("registry_site"))
               .when(last.isin(*words), F.lit("section")))
    return j.withColumn("reason", reason).drop("_site", "_is_site").withColumnRenamed("_canon", "canonical_url")


def within_age(published_at: Column, now: Column, landmark: Column, months: int = 12) -> Column:
    """Kept if undated, not older than ``months``, or a landmark."""
    return (published_at.isNull() | (published_at >= F.add_months(now, -months))
            | F.coalesce(landmark, F.lit(False)))


def style_flags(texts: DataFrame, text_col: str = "text", words: tuple[str, ...] = BANNED_WORDS,
                dash_limit: int = DASH_LIMIT) -> DataFrame:
    """Banned-word hits and dash count per text, and the overuse flag."""
    tokens = F.split(F.lower(F.col(text_col)), r"[^\p{L}\p{N}]+")
    banned = F.array(*[F.lit(w) for w in words])
    return texts.select(
        "*",
        F.size(F.filter(tokens, lambda t: F.array_contains(banned, t))).alias("banned_hits"),
        F.regexp_count(F.col(text_col), F.lit("[—–]| -- | - ")).alias("dashes")) \
        .withColumn("dash_overuse", F.col("dashes") >= dash_limit)


def cross_source_boost(mentions: DataFrame, story_col: str, group_col: str,
                       trending: str, discussed: str, boost: float = CROSS_SOURCE_BOOST) -> DataFrame:
    """D3: per story, whether it trends in one kind of source and is discussed
    in another; ``boost`` is added when both hold (partial aggregation)."""
    g = F.col(group_col)
    out = mentions.groupBy(story_col).agg(
        F.count_if(g == trending).alias("n_trending"), F.count_if(g == discussed).alias("n_discussed"))
    both = (F.col("n_trending") > 0) & (F.col("n_discussed") > 0)
    return out.withColumn("boost", F.when(both, F.lit(boost)).otherwise(F.lit(0.0)))


def boosted(scored: DataFrame, boosts: DataFrame, story_col: str, best: float = MAX_SCORE) -> DataFrame:
    """D3 applied: each item's score raised by its story's boost, to the best score at most, and judged again.

    ``weighted`` and ``verdict`` are the new ones; the score before is ``unboosted``.  An item without a score stays without.
    """
    raised = F.least(F.round(F.col("weighted") + F.coalesce("boost", F.lit(0.0)), 2), F.lit(best))
    joined = scored.join(boosts.select(story_col, "boost"), story_col, "left").withColumn("unboosted", F.col("weighted"))
    return (joined.withColumn("weighted", F.when(F.col("weighted").isNotNull(), raised)).withColumn("verdict", verdict(F.col("weighted"))).drop("boost"))


def funnel(items: DataFrame, source_col: str, stages: list[tuple[str, Column]]) -> DataFrame:
    """Items surviving each successive stage, per source, in one pass."""
    cum = None
    aggs = [F.count(F.lit(1)).alias("parsed")]
    for name, cond in stages:
        cum = cond if cum is None else cum & cond
        aggs.append(F.count_if(F.coalesce(cum, F.lit(False))).alias(name))
    return items.groupBy(source_col).agg(*aggs)
