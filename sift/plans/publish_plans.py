"""Publishing queries: two keyed digests through the store (H4, A8, A12, A14), manifests from files (E1),
the coverage report through its file (E3, H2) and the strict sink (A11)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sift.operators import coverage as cv
from sift.operators import rules
from sift.plans import coverage_plans, curation, fixtures, json_plans, pipeline
from sift.session import ensure_checkpoint_dir
from sift.sources import feeds
from sift.sources import jsonfix as jf
from sift.sources import registry as rg
from sift.sources import store
from sift.sources.tables import read_table

DESK_CAP = 30
KEYS = ["desk"]


def _folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def q_published_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4: a digest per desk (source) is published; the same items are curated again against it and published
    on the same day.  Lines of all published digests, and the report of each job."""
    root = _folder(spark, "archive")
    items = fixtures.items(spark, sf_dir).withColumn("desk", F.col("author"))
    reports = [pipeline.run_pipeline(spark, items, root, curation.DIGEST_DATE, keys=KEYS, max_items=DESK_CAP,
                                     generated_at=curation.GENERATED_AT) for _ in range(2)]
    lines = store.lines_of(spark, root, KEYS, store.names(spark, root, KEYS)).select(
        "desk", "file_name", F.lit("line").alias("kind"), F.col("value").alias("line"))
    for report in reports:
        lines = lines.unionByName(report.select("desk", "file_name", F.lit("report").alias("kind"), F.concat_ws(
            " ", F.lit("passed"), F.col("passed").cast("string"), F.lit("must-reads"), F.col("must_reads").cast("string")).alias("line")))
    return lines


def q_latest_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 + A9: URLs of each desk's latest digest in a store where half of the desks published twice."""
    root = _folder(spark, "archive")
    items = fixtures.items(spark, sf_dir).withColumn("desk", F.col("author"))
    odd = F.regexp_extract("desk", "[0-9]+", 0).try_cast("int") % 2 == 1
    for part in (items, items.where(odd)):
        pipeline.run_pipeline(spark, part, root, curation.DIGEST_DATE, keys=KEYS, max_items=DESK_CAP,
                              generated_at=curation.GENERATED_AT)
    return store.latest_seen(spark, root, KEYS).join(store.latest(spark, root, KEYS).select(*KEYS, "file_name"), KEYS)


def _manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    path = _folder(spark, "manifests")
    fixtures.write_manifests(spark, sf_dir, path)
    return cv.read_manifests(spark, path)


def q_manifest_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 from landed JSON files: last status per source, in file order."""
    manifests, _ = _manifests(spark, sf_dir)
    merged = cv.merge_sources(cv.explode_manifests(manifests))
    number = F.regexp_extract(F.col("first_manifest.file_path"), "number=([0-9]+)", 1).cast("bigint")
    return merged.select("source_name", "scanner", "status", "error", number.alias("first_number"), F.col("first_entry").cast("bigint").alias("first_entry"))


def q_manifest_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest files that are no JSON."""
    _, bad = _manifests(spark, sf_dir)
    return bad.select(F.regexp_extract("file_path", "number=([0-9]+)", 1).cast("bigint").alias("number"))


def _report(spark: SparkSession, sf_dir: str) -> str:
    path = _folder(spark, "coverage")
    cv.write_report(coverage_plans.merged(spark, sf_dir), path)
    return path


def q_coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3 + A14: the written report read back, a row per status."""
    report = cv.load_report(spark, _report(spark, sf_dir))
    return report.select("total_sources", "sources_visited", "coverage_pct", F.explode("by_status").alias("status", "n_sources"))


def q_coverage_missed_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4 + A14: the missed sources read back from the report's folder."""
    return cv.load_missed(spark, _report(spark, sf_dir))


def q_digest_from_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2: the capped digest with the footer of the report that was read back."""
    coverage = cv.load_report(spark, _report(spark, sf_dir))
    return curation.digest(spark, sf_dir, curation.DIGEST_CAP, coverage=coverage, sweep_num=3)


def q_json_strict_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11 + A14: complete items written as JSON lines and read back, with the job's counts of kept and dropped items."""
    path = _folder(spark, "strict")
    counts = jf.write_strict(json_plans.recovered(spark, sf_dir), path)
    back = spark.read.schema("msg_id bigint, item_pos int, item map<string,string>").json(path)
    return back.select("msg_id", "item_pos", F.col("item")["title"].alias("title"), F.col("item")["url"].alias("url"),
                       F.lit(counts["kept"]).cast("bigint").alias("n_kept"), F.lit(counts["dropped"]).cast("bigint").alias("n_dropped"))


def q_registry_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 + D4: the JSON document and the prose copy read from their files and reconciled by tier and site."""
    path = _folder(spark, "registry")
    fixtures.write_registry_copies(spark, sf_dir, path)
    named = lambda df: df.withColumn("site_url", rg.site_key(F.col("site_url")))
    return rg.reconcile(named(rg.read_registry_json(spark, f"{path}/json")), named(rg.read_registry_prose(spark, f"{path}/prose")), ("tier", "site_url"))


def q_boosted_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3 applied: a document's story is the user of the same number (modulo the users); its score is raised and judged again."""
    users = read_table(spark, sf_dir, "events", "user_id", "event_type")
    boosts = rules.cross_source_boost(users, "user_id", "event_type", "view", "click")
    last = users.agg(F.max("user_id")).scalar()
    items = curation.scored_items(spark, sf_dir).withColumn("user_id", F.col("doc_id") % (last + 1))
    return rules.boosted(items, boosts, "user_id").select("doc_id", "user_id", "unboosted", "weighted", "verdict")


def q_large_feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: items of one large feed file per source, read by split."""
    path = _folder(spark, "feeds")
    fixtures.write_source_feeds(spark, sf_dir, path)
    items, _ = feeds.read_large(spark, path)
    return items.select(F.regexp_extract("file_path", "source=([^/]+)", 1).alias("source"), F.col("item_pos").cast("bigint").alias("item_pos"),
                        "format", "title", "url", "author", "date", "summary")
