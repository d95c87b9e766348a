"""Seen-set and verdict filtering (C1, D1) and latest-digest lookup helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sift.functions.scoring import VERDICT_FAIL
from sift.functions.urls import canonical_url


def drop_failed(items: DataFrame) -> DataFrame:
    """Drop FAIL verdicts; rows without a verdict are kept."""
    return items.where(~F.col("verdict").eqNullSafe(F.lit(VERDICT_FAIL)))


def canonical_seen(seen: DataFrame, url_col: str = "url") -> DataFrame:
    """Distinct canonical keys of a seen set (map-side partial distinct)."""
    return (seen.select(canonical_url(F.col(url_col)).alias("canonical_url"))
                .distinct())


def drop_seen(items: DataFrame, seen: DataFrame, url_col: str = "url",
              seen_url_col: str = "url") -> DataFrame:
    """Anti join on the canonical URL (both sides canonicalised).

    Duplicates inside the batch are kept (that is F5's job).  No broadcast
    hint: AQE turns the sort-merge anti join into a broadcast one at run time
    when the measured seen side is under ``autoBroadcastJoinThreshold``, and
    keeps the shuffle join (with skew splitting) when the history is large.
    """
    keyed = items.withColumn("canonical_url", canonical_url(F.col(url_col)))
    return keyed.join(canonical_seen(seen, seen_url_col), "canonical_url", "left_anti")


def dedup(items: DataFrame, seen: DataFrame, url_col: str = "url") -> DataFrame:
    """C1 then D1, the reference's dedup step."""
    return drop_seen(drop_failed(items), seen, url_col)
