"""Rubric scoring (B4) and verdicts (B5) as plain column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
# Axis weights (R relevance, Q quality, N novelty, A actionability, S signal):
WEIGHTS = {"R": 1.5, "Q": 1.0, "N": 1.5, "A": 1.0, "S": 1.0}
WEIGHT_DIVISOR = 6.0
PASS_THRESHOLD = 3.5
MUST_READ_THRESHOLD = 4.5
VERDICT_MUST_READ = "MUST READ"
VERDICT_PASS = "PASS"
VERDICT_FAIL = "FAIL"
# ---------------------------------------------------------------------------

SCORES_TYPE = "struct<R:int,Q:int,N:int,A:int,S:int>"


def weighted_score(scores: Column) -> Column:
    """Weighted mean of the five axes, rounded to 2 places.

    A missing axis yields null (the row is then quarantined by the caller)
    instead of failing the whole job.
    """
    total = None
    for axis, w in WEIGHTS.items():
        term = scores[axis].cast("double") * F.lit(w)
        total = term if total is None else total + term
    return F.round(total / F.lit(WEIGHT_DIVISOR), 2)


def verdict(weighted: Column) -> Column:
    """Verdict on the rounded score; null score → null verdict."""
    return (F.when(weighted >= MUST_READ_THRESHOLD, F.lit(VERDICT_MUST_READ))
            .when(weighted >= PASS_THRESHOLD, F.lit(VERDICT_PASS))
            .when(weighted.isNotNull(), F.lit(VERDICT_FAIL)))


def score(items: DataFrame, scores_col: str = "scores") -> DataFrame:
    """Add ``weighted`` and ``verdict`` (narrow, no shuffle)."""
    return (items.withColumn("weighted", weighted_score(F.col(scores_col)))
                 .withColumn("verdict", verdict(F.col("weighted"))))
