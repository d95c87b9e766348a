"""Running coverage per tumbling window with Structured Streaming.

Status counts per event-time window (E2 over time) and the latest status
per source (E1), from a stream of manifest entries.  With ``append`` output
and a watermark the state is bounded (a window is final and dropped once
the watermark passes its end); ``complete`` keeps every window and is meant
for bounded replays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sift.operators.coverage import STATUS_NO_RESPONSE


def window_counts(entries: DataFrame, time_col: str, window: str = "1 day",
                  watermark: str = "1 hour") -> DataFrame:
    status = F.coalesce(F.col("status"), F.lit(STATUS_NO_RESPONSE))
    return (entries.withWatermark(time_col, watermark)
                   .groupBy(F.window(time_col, window).alias("w"), status.alias("status"))
                   .agg(F.count(F.lit(1)).alias("n_entries"))
                   .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                           "status", "n_entries"))


def latest_status(entries: DataFrame) -> DataFrame:
    """E1 as a stateful stream: last entry per source by (manifest, position)."""
    pos = F.struct("manifest_ord", "entry_ord")
    return (entries.groupBy("source_name")
                   .agg(F.max_by(F.struct("scanner", "status", "error"), pos).alias("last"))
                   .select("source_name", "last.scanner", "last.status", "last.error"))


def run_available(spark: SparkSession, stream: DataFrame, out_path: str, checkpoint: str,
                  output_mode: str = "complete", keys: tuple[str, ...] = ()) -> DataFrame:
    """Run a streaming aggregate over all available input into parquet.

    ``complete``: each micro-batch replaces the table with the full result.
    ``append``: each writes its rows to its own folder, named by its id, so
    closed windows add up and a replayed batch replaces only itself.
    ``update``: the same, and the table read back has, of each key, the row of
    its latest batch.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        target = out_path if output_mode == "complete" else f"{out_path}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(target)

    if output_mode == "update" and not keys:
        raise ValueError("update mode needs the keys of a row")
    q = (stream.writeStream.outputMode(output_mode).foreachBatch(write)
               .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    written = spark.read.parquet(out_path)
    if output_mode == "append":
        return written.drop("batch")
    if output_mode == "update":
        columns = [c for c in written.columns if c not in (*keys, "batch")]
        return (written.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("last"))
                       .select(*keys, *[F.col(f"last.{c}").alias(c) for c in columns]))
    return written
