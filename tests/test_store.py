"""Two-phase publishing (A12, A14), the latest digest by names (A8), files of manifests and reports."""

import glob
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from sift.operators import coverage as cv
from sift.plans import fixtures, pipeline
from sift.sources import jsonfix, store

from testpaths import SF_SMALL

DAY = "2026-03-17"


def folder(spark, name="archive"):
    return tempfile.mkdtemp(prefix="sift-", dir=spark.sparkContext.getCheckpointDir().replace("file:", "")) + f"/{name}"


def rendered(spark, desk_lines, day=DAY):
    """Lines in the renderer's form: desk, section_ord, part, weighted, input_ord, line_ord, line."""
    rows = [(d, 0, 0, None, None, k, line) for d, lines in desk_lines.items()
            for k, line in enumerate([f"# Research Digest — {day}", *lines])]
    return spark.createDataFrame(rows, "desk string, section_ord int, part int, weighted double, input_ord long, line_ord int, line string")


def listed(df):
    return sorted((r.desk, r.file_name) for r in df.collect())


def test_a_job_killed_before_its_claim_publishes_nothing(spark, monkeypatch):
    root = folder(spark)
    first = rendered(spark, {"a": ["https://x/1"], "b": ["https://x/2"]})
    real = store.claim

    def dies(*_):
        raise RuntimeError("killed")
    monkeypatch.setattr(store, "claim", dies)
    with pytest.raises(RuntimeError, match="killed"):
        store.publish(spark, first, root, ["desk"], DAY)
    assert os.listdir(f"{root}/lines") and os.listdir(f"{root}/names")        # both were written
    assert store.names(spark, root, ["desk"]) is None and store.latest_seen(spark, root, ["desk"]) is None
    monkeypatch.setattr(store, "claim", real)
    assert listed(store.publish(spark, first, root, ["desk"], DAY)) == [("a", f"{DAY}.md"), ("b", f"{DAY}.md")]
    lines = store.lines_of(spark, root, ["desk"], store.names(spark, root, ["desk"]))
    assert sorted(r.value for r in lines.where("desk = 'a'").collect()) == [f"# Research Digest — {DAY}", "https://x/1"]   # once


def test_a_job_that_loses_the_claim_takes_the_next_name(spark, monkeypatch):
    root = folder(spark)
    real, others = store.claim, []

    def late(spark_, root_, number, attempt):
        if not others:                     # another job publishes between this one's allocation and its claim
            others.append(True)
            listed(store.publish(spark, rendered(spark, {"a": ["other"]}), root, ["desk"], DAY))
        real(spark_, root_, number, attempt)
    monkeypatch.setattr(store, "claim", late)
    assert listed(store.publish(spark, rendered(spark, {"a": ["mine"], "b": ["mine"]}), root, ["desk"], DAY)) == [("a", f"{DAY}-2.md"), ("b", f"{DAY}.md")]
    known = store.names(spark, root, ["desk"])
    assert listed(known) == [("a", f"{DAY}-2.md"), ("a", f"{DAY}.md"), ("b", f"{DAY}.md")]
    assert len(store.commits(spark, root)) == 2


def test_a_claim_is_exclusive(spark):
    root = folder(spark)
    store.claim(spark, root, 0, "one")
    with pytest.raises(store.NumberTaken):
        store.claim(spark, root, 0, "two")
    assert store.commits(spark, root) == ["000000000000-one"]


def test_date_of_the_header_line(spark):
    root = folder(spark)
    store.publish(spark, rendered(spark, {"a": ["x"]}, "2026-01-02"), root, ["desk"], DAY)
    plain = rendered(spark, {"b": ["x"]}).where("line = 'x'")
    store.publish(spark, plain, root, ["desk"], DAY)
    store.publish(spark, rendered(spark, {"c": ["x"]}, "2026-01-02"), root, ["desk"], DAY, date="2025-12-31")
    assert listed(store.names(spark, root, ["desk"])) == [("a", "2026-01-02.md"), ("b", f"{DAY}.md"), ("c", "2025-12-31.md")]


def test_latest_reads_only_the_folders_of_the_latest(spark):
    root = folder(spark)
    for day, desks in (("2026-03-01", "ab"), ("2026-03-03", "a"), ("2026-03-02", "a")):
        store.publish(spark, rendered(spark, {d: [f"https://x/{day}/{d}"] for d in desks}, day), root, ["desk"], DAY)
    newest = store.latest(spark, root, ["desk"])
    assert listed(newest) == [("a", "2026-03-03.md"), ("b", "2026-03-01.md")]
    assert sorted(r.url for r in store.latest_seen(spark, root, ["desk"]).collect()) == ["https://x/2026-03-01/b", "https://x/2026-03-03/a"]
    lines = store.lines_of(spark, root, ["desk"], newest)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan text" in x)
    assert "PartitionFilters: [attempt" in scan
    single = folder(spark)
    for day in ("2026-03-01", "2026-03-02"):
        store.publish(spark, rendered(spark, {"a": [day]}, day).drop("desk"), single, [], DAY)
        if day == "2026-03-01":     # a file of the older digest that cannot be read
            old, = os.listdir(f"{single}/lines")
            open(f"{single}/lines/{old}/part-broken.txt.gz", "w").write("no gzip")
    lines = store.lines_of(spark, single, [], store.latest(spark, single, []))
    assert sorted(r.value for r in lines.collect()) == ["# Research Digest — 2026-03-02", "2026-03-02"]
    with pytest.raises(Exception):
        store.lines_of(spark, single, [], store.names(spark, single, [])).collect()


def test_order_and_line_breaks_survive(spark):
    root = folder(spark)
    rows = rendered(spark, {"a": [f"line {k}" for k in range(300)] + ["tail\r x"]}).repartition(5)
    store.publish(spark, rows, root, ["desk"], DAY)
    text = "".join(open(p).read() for p in sorted(glob.glob(f"{root}/lines/*/desk=a/*.txt")))
    assert text.split("\n")[1:301] == [f"line {k}" for k in range(300)]


def test_listing_of_plain_folders(spark):
    root = folder(spark, "plain")
    for d, names in {"en": [f"{DAY}.md", f"{DAY}-2.md", f"{DAY}-10.md", "2026-03-18.ko.md", "notes.md"], "ko": ["2026-01-01.md"]}.items():
        os.makedirs(f"{root}/{d}")
        for n in names:
            open(f"{root}/{d}/{n}", "w").write(n)
    from sift.sources.archive import latest_digest
    got = latest_digest(store.folder_listing(spark, root), ["folder"], "file_name", "path").collect()
    assert sorted((r.folder, r.latest_file, r.path.rsplit("/", 1)[1]) for r in got) == [("en", f"{DAY}-10.md", f"{DAY}-10.md"), ("ko", "2026-01-01.md", "2026-01-01.md")]


def test_null_keys_are_published_under_a_name(spark):
    root = folder(spark)
    items = fixtures.items(spark, SF_SMALL).withColumn("desk", F.when(F.col("doc_id") % 2 == 0, F.lit("even")))
    reports = [{r.desk: r for r in pipeline.run_pipeline(spark, items, root, DAY, keys=["desk"]).collect()} for _ in range(2)]
    assert set(reports[0]) == set(reports[1]) == {"even", pipeline.NO_KEY}
    assert all(reports[1][d].file_name == f"{DAY}-2.md" and reports[1][d].passed < reports[0][d].passed for d in reports[0])


def test_manifest_files_in_order_with_quarantine(spark):
    root = folder(spark, "manifests")
    os.makedirs(root)
    cover = lambda scanner, **s: {"coverage": {"scanner": scanner, "sources": {k: {"status": v} for k, v in s.items()}}}
    files = {"01.json": json.dumps(cover("s1", a="ok", b="error"), indent=2), "02.json": json.dumps([cover("s2", b="ok"), cover("s3", b="timeout", c="empty")]),
             "03.json": '{"coverage": {"scanner": "cut"', "04.json": json.dumps({"coverage": {"sources": {"a": {"status": "error", "error": "e"}}}}), "05.json": "[]", "06.json": " \n", "07.json": '{"x": 1}'}
    for name, text in files.items():
        open(f"{root}/{name}", "w").write(text)
    manifests, bad = cv.read_manifests(spark, root)
    got = {r.source_name: (r.scanner, r.status, r.error) for r in cv.merge_sources(cv.explode_manifests(manifests)).collect()}
    assert got == {"a": ("unknown", "error", "e"), "b": ("s3", "timeout", None), "c": ("s3", "empty", None)}
    assert sorted(os.path.basename(r.file_path) for r in bad.collect()) == ["03.json", "06.json"]


def test_report_round_trip(spark):
    path = folder(spark, "report")
    sources = spark.createDataFrame([("a", "s", "ok", None), ("b", "s", "error", "e"), ("c", "s", None, None)], "source_name string, scanner string, status string, error string")
    cv.write_report(sources, path)
    want, back = cv.report(sources), cv.load_report(spark, path)
    assert back.schema.simpleString() == want.schema.simpleString() and back.collect() == want.collect()
    assert sorted(tuple(r) for r in cv.load_missed(spark, path).collect()) == [("b", "s", "error", "e"), ("c", "s", None, None)]
    assert cv.load_report(spark, None) is None


def test_strict_counts_come_from_the_writing_job(spark):
    full = '{"title":"t","url":"u","source_tier":"1","source_name":"n"}'
    texts = spark.createDataFrame([(1, f"[{full},{{\"title\":\"x\"}},7]"), (2, "no json"), (3, f'{{"items":[{full}]}}')], "msg_id long, raw string")
    path = folder(spark, "strict")
    assert jsonfix.write_strict(jsonfix.recover(texts), path) == {"kept": 2, "dropped": 2}
    assert spark.read.json(path).count() == 2
