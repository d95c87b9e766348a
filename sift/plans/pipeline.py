"""H4: end-to-end curation against a published archive (A8 → A9 → D1 → G1 →
H3 → A12 → publish); one job can curate many digests (one per key) at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sift.functions.scoring import score
from sift.operators import dedup as dd
from sift.operators import digest as dg
from sift.operators.rank import top_n
from sift.session import ensure_checkpoint_dir
from sift.sources import store


#: Key of the items that have none (a folder name cannot be empty).
NO_KEY = "(none)"


def best_per_key(items: DataFrame, keys: list[str], n: int) -> DataFrame:
    """G1 for every digest key: its best ``n`` by weighted (missing = 0), ties in input order.

    Spark limits the window's groups before the shuffle too, so a key that holds
    most rows sends at most ``n`` of them from a task.
    """
    order = Window.partitionBy(*keys).orderBy(F.coalesce(F.col("weighted"), F.lit(0.0)).desc(), F.col("input_ord").asc())
    return items.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")


def run_pipeline(spark: SparkSession, items: DataFrame, archive_path: str, date_str: str, *,
                 max_items: int = 0, keys: list[str] | None = None, coverage: DataFrame | None = None,
                 sweep_num: int | None = None, generated_at: str = "1970-01-01 00:00") -> DataFrame:
    """Score, drop seen and failed items, cap, render, publish; returns the
    per-digest report (keys, file name, passed, must-reads).

    Every key of ``items`` gets a digest, with placeholders if none of its
    items is left.  The surviving items are computed once, before anything is
    written, and feed the lines and the report.  A null key is the key
    ``NO_KEY``.  The file's date is that of the rendered header line.
    """
    keys = list(keys or [])
    scored = score(items.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit(NO_KEY)) for k in keys}))
    ensure_checkpoint_dir(spark)
    scanned = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("scanned")).checkpoint()
    kept = dd.drop_failed(scored)
    seen = store.latest_seen(spark, archive_path, keys)
    if seen is not None:
        kept = kept.withColumn("canonical_url", dd.canonical_url(F.col("url")))
        seen_keys = seen.select(*keys, dd.canonical_url(F.col("url")).alias("canonical_url")).distinct()
        kept = kept.join(seen_keys, [*keys, "canonical_url"], "left_anti")
    if max_items > 0:
        kept = best_per_key(kept, keys, max_items) if keys else top_n(kept, max_items)
    kept = kept.checkpoint()
    lines = dg.render(kept, date_str, keys=keys, scanned=scanned,
                      coverage=coverage, sweep_num=sweep_num, generated_at=generated_at)
    published = store.publish(spark, lines, archive_path, keys, date_str)
    stats = dg.digest_stats(kept, keys).select(*keys, "passed", "must_reads")
    report = published.join(stats, keys, "left") if keys else published.crossJoin(F.broadcast(stats))   # one row
    return report.select(*keys, "file_name", F.coalesce("passed", F.lit(0)).alias("passed"),
                         F.coalesce("must_reads", F.lit(0)).alias("must_reads"))
