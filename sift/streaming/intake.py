"""Continuous item intake with Structured Streaming.

file stream → parse date (B2) → cutoff (C2) → canonical URL (B1) →
``dropDuplicatesWithinWatermark`` on the canonical URL (short memory, bounded
state) → ``foreachBatch``: anti join with the seen table (long memory beyond
the watermark), append the new items and their keys to the seen table.

The watermark runs on the arrival time (the time of the micro-batch), so it
only bounds the short memory: no item is late, however old its date is within
the cutoff.  Undated items are kept (C2).

The seen table (``streaming.seen``) is a few compacted runs of batches.  A
micro-batch reads only buckets that its own URLs fall into, and only batches
before its own: a batch that is replayed after either of its two writes sees
the same history as the first time, and overwrites its own folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sift.functions.dates import is_recent, parse_date
from sift.functions.urls import canonical_url
from sift.sources.tables import path_exists
from sift.streaming.seen import INITIAL_BATCH, SeenTable, bucket_of

def prepare(items: DataFrame, cutoff_ts: str, url_col: str = "url", date_col: str = "date",
            watermark: str = "2 days") -> DataFrame:
    """Streaming-safe part: parse, filter, key, watermark, short-memory dedup."""
    published = parse_date(F.col(date_col))
    keyed = (items.withColumn("published_at", published)
                  .where(is_recent(F.col("published_at"), F.lit(cutoff_ts).cast("timestamp")))
                  .withColumn("canonical_url", canonical_url(F.col(url_col)))
                  .withColumn("_event_time", F.current_timestamp()))
    return (keyed.withWatermark("_event_time", watermark)
                 .dropDuplicatesWithinWatermark(["canonical_url"]))


def seen_writer(spark: SparkSession, seen: SeenTable, out_path: str):
    """foreachBatch function: drop URLs that earlier batches have seen, keep one
    row per URL, write the batch and add its URLs to the seen table."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # the batch feeds several jobs: compute it once (the stateful part must
        # not run twice), then release it
        fresh = batch.drop("_event_time").persist()
        try:
            seen.compact(batch_id)
            buckets = [r[0] for r in fresh.select(bucket_of(F.col("canonical_url"))).distinct().collect()]   # at most BUCKETS
            known = seen.read(batch_id, buckets)
            new = fresh if known is None else fresh.join(known.withColumnRenamed("key", "canonical_url"), "canonical_url", "left_anti")
            new = new.dropDuplicates(["canonical_url"]).persist()
            try:
                new.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
                seen.add(new.select(F.col("canonical_url").alias("key")), batch_id)
            finally:
                new.unpersist()
        finally:
            fresh.unpersist()

    return write


def run_available(spark: SparkSession, raw: DataFrame, to_items, cutoff_ts: str,
                  work_dir: str, initial_seen: DataFrame | None = None,
                  watermark: str = "2 days") -> DataFrame | None:
    """Run the intake over everything available now and return the output (None if no batch ever ran).

    ``raw`` is a streaming frame; ``to_items`` maps it to items (url, date, ...).  State,
    checkpoint, seen table and output live under ``work_dir`` (a shared
    folder on a cluster).
    """
    seen, out_path = SeenTable(spark, f"{work_dir}/seen"), f"{work_dir}/out"
    if initial_seen is not None:
        seen.add(initial_seen.select(canonical_url(F.col("url")).alias("key")).distinct(), INITIAL_BATCH)
    q = (prepare(to_items(raw), cutoff_ts, watermark=watermark)
         .writeStream.foreachBatch(seen_writer(spark, seen, out_path))
         .option("checkpointLocation", f"{work_dir}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out_path).drop("batch") if path_exists(spark, out_path) else None
