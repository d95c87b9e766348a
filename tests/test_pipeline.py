"""H4 end to end: publish, collision numbering, re-run drops what was rendered."""

import glob
import re
import tempfile

from sift.plans import fixtures, pipeline
from sift.sources import store

from testpaths import SF_SMALL


def text_of(spark, arch, keys, file_name):
    """The published lines of one file, in order."""
    row, = store.names(spark, arch, keys).where(f"file_name = '{file_name}'").collect()
    place = "/".join([f"{arch}/lines/attempt={row.attempt}", *[f"{k}={row[k]}" for k in keys]])
    return [line for f in sorted(glob.glob(f"{place}/*.txt")) for line in open(f).read().split("\n")[:-1]]


def test_publish_twice(spark):
    arch = tempfile.mkdtemp(prefix="sift-arch-", dir=spark.sparkContext.getCheckpointDir().replace("file:", "")) + "/archive"
    items = fixtures.items(spark, SF_SMALL)
    r1 = pipeline.run_pipeline(spark, items, arch, "2026-03-17", generated_at="2026-03-17 06:00").first()
    assert r1.file_name == "2026-03-17.md" and r1.passed > 0
    first = text_of(spark, arch, [], "2026-03-17.md")
    assert first[0] == "# Research Digest — 2026-03-17"
    r2 = pipeline.run_pipeline(spark, items, arch, "2026-03-17", generated_at="2026-03-17 06:00").first()
    assert r2.file_name == "2026-03-17-2.md"
    second = "\n".join(text_of(spark, arch, [], "2026-03-17-2.md"))
    rendered_first = set(re.findall(r"https?://[^\s)\]>\"]+", "\n".join(first)))
    rendered_second = set(re.findall(r"https?://[^\s)\]>\"]+", second))
    assert r2.passed < r1.passed
    assert not (rendered_first & rendered_second)


def test_publish_many_digests_in_one_job(spark):
    from pyspark.sql import functions as F
    arch = tempfile.mkdtemp(prefix="sift-arch-", dir=spark.sparkContext.getCheckpointDir().replace("file:", "")) + "/archive"
    items = fixtures.items(spark, SF_SMALL).withColumn("desk", F.col("author"))
    r1 = {r.desk: r for r in pipeline.run_pipeline(spark, items, arch, "2026-03-17", keys=["desk"]).collect()}
    assert len(r1) > 1 and all(r.file_name == "2026-03-17.md" for r in r1.values())
    r2 = {r.desk: r for r in pipeline.run_pipeline(spark, items, arch, "2026-03-17", keys=["desk"]).collect()}
    assert all(r.file_name == "2026-03-17-2.md" for r in r2.values())
    assert r2.keys() == r1.keys() and all(r2[d].passed <= r1[d].passed for d in r2)
    heads = spark.read.text(f"{arch}/lines").where(F.col("value").startswith("# Research Digest")).count()
    assert heads == len(r1) + len(r2)                 # one title line per published digest


def test_key_types_cap_and_empty_digests(spark):
    from pyspark.sql import functions as F
    arch = tempfile.mkdtemp(prefix="sift-arch-", dir=spark.sparkContext.getCheckpointDir().replace("file:", "")) + "/archive"
    items = fixtures.items(spark, SF_SMALL).withColumn("desk", F.col("doc_id") % 2 + 1)
    r1 = {r.desk: r for r in pipeline.run_pipeline(spark, items, arch, "2026-03-17", keys=["desk"], max_items=3).collect()}
    assert {d: r.passed for d, r in r1.items()} == {"1": 3, "2": 3}                    # the cap holds per digest
    news = items.withColumn("desk", F.lit("news")).limit(5).withColumn("scores", F.struct(*[F.lit(1).alias(c) for c in "RQNAS"]))
    r2 = {r.desk: r for r in pipeline.run_pipeline(spark, news, arch, "2026-03-18", keys=["desk"]).collect()}
    assert (r2["news"].passed, r2["news"].file_name) == (0, "2026-03-18.md")          # nothing passed: still a digest
    text = text_of(spark, arch, ["desk"], "2026-03-18.md")
    assert text[0] == "# Research Digest — 2026-03-18" and "Items scanned: 5 | Passed: 0 | Must-reads: 0" in text
