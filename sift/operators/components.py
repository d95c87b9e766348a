"""Connected components by alternating large-star and small-star rounds.

Each round hangs every node's larger (then smaller) neighbours under its
smallest one.  Rounds grow with the logarithm of the longest path in practice;
there is no limit on them, the loop ends when nothing changes.  The edges are
checkpointed every round, in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sift.session import ensure_checkpoint_dir


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    return (both.where("b > a").join(least, "a").where("b != least")
                .select(F.col("b").alias("a"), F.col("least").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    hung = down.join(least, "a").where("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return hung.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b) that is not its component's smallest."""
    ensure_checkpoint_dir(links.sparkSession)
    edges = (links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .distinct().checkpoint())
    before, now = None, _state(edges)
    while now != before:
        edges = _small_star(_large_star(edges)).checkpoint()
        before, now = now, _state(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
