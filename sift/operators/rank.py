"""Top-N (G1), in-section order (G2 lives in digest) and dense batching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sift.session import ensure_checkpoint_dir

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
BATCH_TRIGGER = 50     # up to this many items → one batch
BATCH_SIZE = 20        # otherwise batches of 20 in input order
# ---------------------------------------------------------------------------

#: Partitions whose counts one window adds up.
BLOCK = 256


def top_n(items: DataFrame, n: int, order_col: str = "input_ord", materialize: bool = False) -> DataFrame:
    """G1: best ``n`` by weighted (missing = 0), ties in input order.

    ``n <= 0`` returns the input untouched and unsorted.  The plan is a
    TakeOrderedAndProject: each task keeps its own top ``n`` and only
    ``n × tasks`` rows meet in the final merge.  With ``materialize`` the
    ``n`` rows are checkpointed once, so a caller that reads them twice does
    not get a second plan (used under an aggregate, Spark would otherwise
    range-sort every row before the limit).
    """
    if n <= 0:
        return items
    top = (items.orderBy(F.coalesce(F.col("weighted"), F.lit(0.0)).desc(), F.col(order_col).asc())
                .limit(n))
    if materialize:
        ensure_checkpoint_dir(items.sparkSession)
        top = top.checkpoint(eager=True)
    return top


def top_n_ranked(items: DataFrame, n: int, order_col: str = "input_ord") -> DataFrame:
    """G1 with a 1-based rank column; the window runs over the ``n`` kept rows only."""
    top = top_n(items, n, order_col)
    w = Window.orderBy(F.coalesce(F.col("weighted"), F.lit(0.0)).desc(), F.col(order_col).asc())
    return top.withColumn("rank", F.row_number().over(w))


def prefix_sums(counts: DataFrame, index: str, value: str, size: int, out_col: str) -> DataFrame:
    """Sum of ``value`` over the smaller indexes, by levels of ``BLOCK`` indexes.

    ``index`` runs from 0 below ``size``.  A window never holds more than
    ``BLOCK`` rows, and the number of levels is the logarithm of ``size``.
    """
    level = counts.select(F.col(index).alias("_i"), F.col(value).alias("_v"), F.floor(F.col(index) / BLOCK).cast("bigint").alias("_block"))
    before = Window.partitionBy("_block").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    within = level.withColumn("_within", F.coalesce(F.sum("_v").over(before), F.lit(0)))
    if size <= BLOCK:
        return within.select(F.col("_i").alias(index), F.col("_within").alias(out_col))
    totals = level.groupBy(F.col("_block").alias("_upper")).agg(F.sum("_v").alias("_sum"))
    above = prefix_sums(totals, "_upper", "_sum", -(-size // BLOCK), "_above")
    return (within.join(above, F.col("_block") == F.col("_upper"))
                  .select(F.col("_i").alias(index), (F.col("_within") + F.col("_above")).alias(out_col)))


def dense_order(df: DataFrame, *order: str | Column, out_col: str = "ord",
                num_partitions: int | None = None) -> DataFrame:
    """Dense 1-based position by ``order`` without a single-task window.

    Range-partition and sort, write each row with its partition and its place in
    it (the checkpoint, so both stay as they are if an executor is lost), count
    the rows of each partition, and join the partitions' prefix sums.  Nothing
    goes through the driver, and the plan does not grow with the partitions.
    Rows that are equal in ``order`` get their numbers in any order.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = ranged.select("*", F.spark_partition_id().cast("bigint").alias("_pid"),
                           F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")).checkpoint()
    counts = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    starts = prefix_sums(counts, "_pid", "_n", n, "_start")
    return placed.join(starts, "_pid").select(*df.columns, (F.col("_start") + F.col("_place") + 1).alias(out_col))


def batches(items: DataFrame, order_col: str = "input_ord",
            num_partitions: int | None = None) -> DataFrame:
    """≤ 50 items → one batch (id 0); else batches of 20 in input order.

    Adds ``ord`` (dense, 1-based) and ``batch_id``.  Zero items → no rows.
    """
    ranked = dense_order(items, order_col, num_partitions=num_partitions)
    total = ranked.agg(F.max("ord")).scalar()
    return ranked.withColumn("batch_id", F.when(total <= BATCH_TRIGGER, F.lit(0))
                             .otherwise(F.floor((F.col("ord") - 1) / BATCH_SIZE)).cast("bigint"))
