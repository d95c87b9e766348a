"""G1 top-N stability, F4 dense order and batching, independent of partitioning."""

import pytest
from pyspark.sql import functions as F

from sift.operators.rank import batches, dense_order, prefix_sums, top_n


def test_top_n_stable_and_missing_is_zero(spark):
    rows = [(i, w) for i, w in enumerate([3.5, None, 4.0, 3.5, 4.0, 1.0])]
    df = spark.createDataFrame(rows, "input_ord long, weighted double")
    assert [r.input_ord for r in top_n(df, 4).collect()] == [2, 4, 0, 3]
    assert top_n(df, 0).count() == 6


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_dense_order_any_partitioning(spark, parts):
    df = spark.range(0, 3000).select((F.col("id") * 7 % 3001).alias("k")).repartition(parts)
    got = sorted((r.k, r.ord) for r in dense_order(df, "k", num_partitions=parts).collect())
    assert [o for _, o in got] == list(range(1, 3001))


def test_dense_order_by_two_columns(spark):
    df = spark.range(0, 500).select((F.col("id") % 7).alias("score"), (F.col("id") * 3).alias("key"))
    out = dense_order(df, F.col("score").desc(), "key", num_partitions=5)
    want = sorted(((i % 7, i * 3) for i in range(500)), key=lambda r: (-r[0], r[1]))
    assert [(r.score, r.key) for r in sorted(out.collect(), key=lambda r: r.ord)] == want


@pytest.mark.parametrize("size", [1, 255, 256, 257, 70000])
def test_prefix_sums_in_levels(spark, size):
    counts = spark.range(0, size).select("id", (F.col("id") % 5).alias("n")).where(F.col("id") % 11 != 3)
    got = {r.id: r.start for r in prefix_sums(counts, "id", "n", size, "start").collect()}
    run, want = 0, {}
    for i in range(size):
        if i % 11 != 3:
            want[i], run = run, run + i % 5
    assert got == want


def test_numbering_sends_nothing_through_the_driver(spark):
    plans = []
    for parts in (3, 40):
        out = batches(spark.range(0, 3000).withColumnRenamed("id", "input_ord"), num_partitions=parts)
        plans.append(len(out._jdf.queryExecution().optimizedPlan().toString().splitlines()))
    assert plans[0] == plans[1]


def test_batches(spark):
    small = spark.range(0, 50).withColumnRenamed("id", "input_ord")
    assert {r.batch_id for r in batches(small).collect()} == {0}
    big = spark.range(0, 51).withColumnRenamed("id", "input_ord")
    got = {r.input_ord: r.batch_id for r in batches(big).collect()}
    assert got[19] == 0 and got[20] == 1 and got[50] == 2
    assert batches(spark.range(0).withColumnRenamed("id", "input_ord")).count() == 0
