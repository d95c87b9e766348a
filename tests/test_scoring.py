"""Hand-derived scores and verdict edges."""

import pytest
from pyspark.sql import functions as F

from sift.functions.scoring import score

CASES = [
    ((5, 5, 5, 5, 5), 5.0, "MUST READ"),
    ((5, 4, 5, 4, 4), 4.5, "MUST READ"),
    ((5, 4, 4, 5, 4), 4.42, "PASS"),
    ((4, 3, 4, 3, 3), 3.5, "PASS"),
    ((3, 4, 3, 3, 4), 3.33, "FAIL"),
    ((1, 1, 1, 1, 1), 1.0, "FAIL"),
]


@pytest.mark.parametrize("axes,weighted,verdict", CASES)
def test_score(spark, axes, weighted, verdict):
    df = spark.createDataFrame([axes], "R int, Q int, N int, A int, S int")
    out = score(df.select(F.struct("R", "Q", "N", "A", "S").alias("scores"))).first()
    assert out.weighted == weighted
    assert out.verdict == verdict


def test_missing_axis_gives_null(spark):
    df = spark.createDataFrame([(5, 5, 5, 5, None)], "R int, Q int, N int, A int, S int")
    out = score(df.select(F.struct("R", "Q", "N", "A", "S").alias("scores"))).first()
    assert out.weighted is None and out.verdict is None


def test_all_integer_scores_in_range(spark):
    import itertools
    rows = list(itertools.product(range(1, 6), repeat=5))
    df = spark.createDataFrame(rows, "R int, Q int, N int, A int, S int")
    out = score(df.select(F.struct("R", "Q", "N", "A", "S").alias("scores")))
    got = {tuple(r.scores): r.weighted for r in out.collect()}
    for (r, q, n, a, s), w in got.items():
        assert w == round((1.5 * r + q + 1.5 * n + a + s) / 6.0, 2)
        assert 1.0 <= w <= 5.0
