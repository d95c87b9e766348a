"""S1/S2 under availableNow equal their batch meaning; a restart adds nothing."""

from pyspark.sql import functions as F

from sift.operators import coverage as cv
from sift.plans import fixtures, stream_plans
from sift.sources.tables import read_table, stream_table
from sift.streaming import coverage as scov
from sift.streaming import intake
from sift.streaming.seen import SeenTable

from testpaths import SF_SMALL


def test_intake_restart_adds_nothing(spark):
    wd = stream_plans._work_dir(spark, "test-intake")
    ev = lambda: stream_table(spark, SF_SMALL, "events")
    out1 = intake.run_available(spark, ev(), stream_plans.event_items, stream_plans.STREAM_CUTOFF, wd)
    n1 = out1.count()
    out2 = intake.run_available(spark, ev(), stream_plans.event_items, stream_plans.STREAM_CUTOFF, wd)
    assert out2.count() == n1 > 0
    assert out2.select("canonical_url").distinct().count() == n1


def test_latest_status_equals_batch(spark):
    stream = scov.latest_status(fixtures.manifest_entries_from(stream_table(spark, SF_SMALL, "events")))
    wd = stream_plans._work_dir(spark, "test-latest")
    got = {tuple(r) for r in scov.run_available(spark, stream, f"{wd}/out", f"{wd}/ck").collect()}
    batch = cv.merge_sources(fixtures.manifest_entries(spark, SF_SMALL)).select("source_name", "scanner", "status", "error")
    assert got == {tuple(r) for r in batch.collect()}


def test_window_counts_append_emits_final_windows(spark):
    """Append mode + watermark (bounded state): every emitted window equals
    the complete result, and the windows still open at the end are the only
    ones missing."""
    entries = lambda: fixtures.manifest_entries_from(stream_table(spark, SF_SMALL, "events"))
    wd = stream_plans._work_dir(spark, "test-append")
    full = scov.run_available(spark, scov.window_counts(entries(), "event_ts", "1 day", "1 hour"),
                              f"{wd}/full", f"{wd}/ck-full", output_mode="complete")
    appended = []

    def collect(batch, _):
        appended.extend(tuple(r) for r in batch.collect())

    q = (scov.window_counts(entries(), "event_ts", "1 day", "1 hour").writeStream.outputMode("append")
         .foreachBatch(collect).option("checkpointLocation", f"{wd}/ck-append").trigger(availableNow=True).start())
    q.awaitTermination()
    complete = {tuple(r) for r in full.collect()}
    assert appended and set(appended) <= complete
    last_end = max(r.window_end for r in full.collect())
    assert {r for r in complete if r not in set(appended)} == {r for r in complete if r[1] == last_end}


def test_backlog_behind_newer_items_is_kept(spark):
    """A later batch may hold items dated long before those already seen, dated or not."""
    wd = stream_plans._work_dir(spark, "test-backlog")
    schema = "url string, date string"
    stream = lambda: spark.readStream.schema(schema).parquet(f"{wd}/in")
    batches = [[("https://a.example/new", "2024-01-30T00:00:00Z"), ("https://a.example/undated", None)],
               [("https://a.example/old", "2024-01-25T00:00:00Z"), ("https://a.example/new", "2024-01-30T00:00:00Z")],
               [("https://a.example/older", "2024-01-18T00:00:00Z"), ("https://a.example/cut", "2024-01-10T00:00:00Z")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{wd}/in")
        out = intake.run_available(spark, stream(), lambda x: x, "2024-01-17 00:00:00", wd)
    assert sorted(r.url for r in out.collect()) == [f"https://a.example/{x}" for x in ("new", "old", "older", "undated")]


def _batch(spark, *urls):
    return spark.createDataFrame([(u, u) for u in urls], "url string, canonical_url string").withColumn(
        "_event_time", F.current_timestamp())


def test_replayed_batch_keeps_its_items(spark):
    """A batch may be replayed after its output was written, or after both writes."""
    wd = stream_plans._work_dir(spark, "test-replay")
    write = intake.seen_writer(spark, SeenTable(spark, f"{wd}/seen"), f"{wd}/out")
    read = lambda: {(r.batch, r.canonical_url) for r in spark.read.parquet(f"{wd}/out").collect()}
    write(_batch(spark, "a", "b", "b"), 0)
    write(_batch(spark, "a", "b", "b"), 0)                              # after both writes
    assert read() == {(0, "a"), (0, "b")}
    write(_batch(spark, "b", "c"), 1)
    _batch(spark, "c", "d").drop("_event_time").write.parquet(f"{wd}/out/batch=2")   # only the first write happened
    write(_batch(spark, "c", "d"), 2)
    write(_batch(spark, "b", "c"), 1)                                   # an older batch once more
    assert read() == {(0, "a"), (0, "b"), (1, "c"), (2, "d")}
    write(_batch(spark, "a", "b", "c", "d"), 3)
    assert read() == {(0, "a"), (0, "b"), (1, "c"), (2, "d")}


def test_seen_table_is_compacted_and_survives_replays(spark, monkeypatch):
    wd = stream_plans._work_dir(spark, "test-compact")
    table = SeenTable(spark, f"{wd}/seen", fan=2)
    write = intake.seen_writer(spark, table, f"{wd}/out")
    want = {}
    for n in range(13):
        urls = [f"u{n}", f"u{n // 2}", f"u{n // 3}"]
        if n == 9:      # stopped in the middle of a merge: the merged folder has no _SUCCESS yet
            with monkeypatch.context() as m:
                real = SeenTable._write
                m.setattr(SeenTable, "_write", lambda self, keys, first, last, k: real(self, keys, first, last, k) if first == last else 1 / 0)
                try:
                    write(_batch(spark, *urls), n)
                except ZeroDivisionError:
                    pass
        write(_batch(spark, *urls), n)
        if n % 4 == 3:  # replayed after both of its writes
            write(_batch(spark, *urls), n)
        want[n] = set(urls) - set().union(*want.values())
        assert len(table.runs()) <= 2 * (n + 2).bit_length() + 2
    got = {}
    for r in spark.read.parquet(f"{wd}/out").collect():
        got.setdefault(r.batch, set()).add(r.canonical_url)
    assert got == {n: u for n, u in want.items() if u}
    assert sorted(r.key for r in table.read(13).collect()) == sorted(set().union(*want.values()))
    assert sum(b - a + 1 for a, b in table._cover(13)) == 13                # every batch in one run
    plan = table.read(13, [3, 5])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(bucket, [3,5])]" in plan


def _write_day(spark, folder, day, rows):
    df = spark.createDataFrame([(f"2024-01-{day:02d} {h:02d}:00:00", s, src, day, i) for i, (h, s, src) in enumerate(rows)],
                               "t string, status string, source_name string, manifest_ord long, entry_ord long")
    df.withColumn("event_ts", F.col("t").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)


def test_append_adds_up_over_micro_batches(spark):
    wd = stream_plans._work_dir(spark, "test-append-many")
    src = f"{wd}/in"
    schema = "t string, status string, source_name string, manifest_ord long, entry_ord long, event_ts timestamp"
    for day in range(1, 6):
        _write_day(spark, src, day, [(1, "visited", "s"), (2, None, "s")])
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    counts = scov.window_counts(stream(), "event_ts", "1 day", "1 hour")
    out = scov.run_available(spark, counts, f"{wd}/out", f"{wd}/ck", output_mode="append").collect()
    assert sorted((r.window_start.day, r.status, r.n_entries) for r in out) == sorted(
        (d, s, 1) for d in range(1, 5) for s in ("visited", "no_response"))


def test_update_mode_reads_the_latest_row(spark):
    wd = stream_plans._work_dir(spark, "test-update")
    src = f"{wd}/in"
    schema = ("t string, status string, source_name string, manifest_ord long, entry_ord long, event_ts timestamp, "
              "scanner string, error string")
    for day, status in ((1, "error"), (2, "visited")):
        _write_day(spark, src, day, [(1, status, "s"), (1, "timeout", f"only{day}")])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = scov.run_available(spark, scov.latest_status(stream), f"{wd}/out", f"{wd}/ck", "update", ("source_name",))
    assert {r.source_name: r.status for r in out.collect()} == {"s": "visited", "only1": "timeout", "only2": "timeout"}
