"""Streaming queries (S1, S2) run to completion over the events file.

Each run gets its own folder under the session's checkpoint directory (a
shared folder on a cluster) for stream state, seen table and output.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sift.plans import fixtures
from sift.session import ensure_checkpoint_dir
from sift.sources.tables import read_table, stream_table
from sift.streaming import coverage as scov
from sift.streaming import intake

STREAM_CUTOFF = "2024-01-17 00:00:00"


def _work_dir(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def _events_stream(spark, sf_dir):
    return stream_table(spark, sf_dir, "events")


def event_items(ev):
    """Events as feed items: one URL per user and kind (views and clicks share
    the 'post' page), tracking parameter on odd events, ISO date."""
    kind = F.when(F.col("event_type").isin("view", "click"), F.lit("post")).otherwise(F.col("event_type"))
    url = F.concat(F.lit("https://ev.example/u/"), F.col("user_id").cast("string"), F.lit("/"), kind,
                   F.when(F.col("event_id") % 2 == 1, F.lit("?utm_source=feed")).otherwise(F.lit("")))
    return ev.select("event_id", url.alias("url"),
                     F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"))


def q_stream_intake(spark, sf_dir):
    """New items of the last two weeks, one per canonical URL, minus the
    URLs of the previous digest (the error pages)."""
    seen = event_items(read_table(spark, sf_dir, "events").where(F.col("event_type") == "error"))
    out = intake.run_available(spark, _events_stream(spark, sf_dir), event_items, STREAM_CUTOFF,
                               _work_dir(spark, "intake"), initial_seen=seen)
    return out.select("canonical_url")


def q_stream_window_counts(spark, sf_dir):
    """Manifest entries per day and status, as a streaming aggregate."""
    entries = fixtures.manifest_entries_from(_events_stream(spark, sf_dir))
    counts = scov.window_counts(entries, "event_ts", "1 day")
    wd = _work_dir(spark, "window-counts")
    out = scov.run_available(spark, counts, f"{wd}/out", f"{wd}/checkpoint")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                      "status", "n_entries")


def q_stream_latest_status(spark, sf_dir):
    """Latest status per source kept as streaming state."""
    entries = fixtures.manifest_entries_from(_events_stream(spark, sf_dir))
    wd = _work_dir(spark, "latest-status")
    # update mode: a batch writes only the sources that it changed
    return scov.run_available(spark, scov.latest_status(entries), f"{wd}/out", f"{wd}/checkpoint",
                              output_mode="update", keys=("source_name",))
