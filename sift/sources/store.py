"""The published archive as a store: two-phase publishing (A12, A14) and the latest digest by metadata.

Layout under the archive's folder::

    lines/attempt=<id>/[key=<value>/...]   rendered text, written before anything is claimed
    names/commit=<number>-<id>/            keys, digest_date, digest_seq, file_name, attempt (Parquet)
    commits/<number>                       one small file with <id>: the commit record

Publishing writes the lines under an attempt of its own, allocates the next
free name of each digest from what is committed, writes those names, and then
claims the next commit number.  Only the claim publishes: a job that dies
before it leaves folders that no reader looks at, and a second run of the same
job is a new attempt.  A claim that another job took first is allocated anew
after that job's names, so no two digests get one name; the lines carry no
name and stay as they are.

The claim must be exclusive.  On a store with an atomic rename that refuses to
replace a file (HDFS) the record is renamed into place; on a local folder it is
hard-linked into place.  Readers list one file for each publishing job.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sift.sources import archive as ar
from sift.sources.tables import path_exists


class NumberTaken(Exception):
    """Another job has claimed the commit number."""


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def commits(spark: SparkSession, root: str) -> list[str]:
    """The committed attempts as ``<number>-<id>``, in commit order; one for each publishing job."""
    path = f"{root}/commits"
    if not path_exists(spark, path):
        return []
    rows = (spark.read.option("pathGlobFilter", "[0-9]*").text(path)
                 .select(F.col("_metadata.file_name").alias("number"), "value").collect())
    return sorted(f"{r.number}-{r.value}" for r in rows)


def claim(spark: SparkSession, root: str, number: int, attempt: str) -> None:
    """Write the commit record ``number``, or raise ``NumberTaken``: the one step that publishes."""
    folder, fs = _hadoop(spark, f"{root}/commits")
    fs.mkdirs(folder)
    draft, _ = _hadoop(spark, f"{root}/commits/.{attempt}-{uuid.uuid4().hex}")
    record, _ = _hadoop(spark, f"{root}/commits/{number:012d}")
    out = fs.create(draft, False)
    out.write(bytearray(attempt.encode()))
    out.close()
    if fs.getUri().getScheme() == "file":
        try:
            os.link(draft.toUri().getPath(), record.toUri().getPath())
        except FileExistsError as taken:
            raise NumberTaken(number) from taken
        finally:
            fs.delete(draft, False)
    elif fs.exists(record) or not fs.rename(draft, record):
        fs.delete(draft, False)
        raise NumberTaken(number)


def _columns(keys: list[str]) -> list[str]:
    return [f"`{k}` string" for k in keys]


def names(spark: SparkSession, root: str, keys: list[str], published: list[str] | None = None) -> DataFrame | None:
    """Names of all published digests: keys, digest_date, digest_seq, file_name, attempt; None if there is none.

    Only folders of committed attempts are read.  Keys are text, given by
    schema and never guessed from folder names.
    """
    published = commits(spark, root) if published is None else published
    if not published:
        return None
    schema = ", ".join([*_columns(keys), "digest_date string, digest_seq long, file_name string, attempt string, commit string"])
    return spark.read.schema(schema).parquet(f"{root}/names").where(F.col("commit").isin(published)).drop("commit")


def lines_of(spark: SparkSession, root: str, keys: list[str], digests: DataFrame) -> DataFrame:
    """The text lines of the given rows of ``names``, with those rows' columns.

    The attempts to read are as many as jobs published the digests, and go into
    the scan as a partition filter, so the folders of others are not opened.
    """
    attempts = [r.attempt for r in digests.select("attempt").distinct().collect()]
    schema = ", ".join(["value string, attempt string", *_columns(keys)])
    lines = spark.read.schema(schema).option("lineSep", "\n").text(f"{root}/lines").where(F.col("attempt").isin(attempts))
    return lines.join(digests, ["attempt", *keys])


def latest(spark: SparkSession, root: str, keys: list[str]) -> DataFrame | None:
    """The newest digest of each key, from the names alone; None if nothing is published."""
    known = names(spark, root, keys)
    if known is None:
        return None
    return ar.latest_digest(known, keys, "file_name", "attempt").withColumnRenamed("latest_file", "file_name")


def latest_seen(spark: SparkSession, root: str, keys: list[str]) -> DataFrame | None:
    """URLs of the latest published digest of each key: A8, then A9 over that digest's lines only."""
    newest = latest(spark, root, keys)
    return None if newest is None else ar.unique_urls(lines_of(spark, root, keys, newest), keys, "value").select(*keys, "url")


def digest_dates(lines: DataFrame, keys: list[str], fallback: str, order: list[str | Column]) -> DataFrame:
    """A12 date rule for each digest: the date of its first header line, else ``fallback``."""
    dated = F.when(F.col("line").rlike(ar.HEADER_DATE), ar.header_date(F.col("line"), fallback))
    first = F.min(F.when(dated.isNotNull(), F.struct(*order, dated.alias("d"))))
    return lines.groupBy(*keys).agg(F.coalesce(first["d"], F.lit(fallback)).alias("digest_date"))


def publish(spark: SparkSession, lines: DataFrame, root: str, keys: list[str], fallback_date: str,
            date: str | None = None) -> DataFrame:
    """Publish rendered digests, one for each key; returns their rows of ``names``.

    The date is the given one, else that of the digest's header line, else
    ``fallback_date``.  Rows are range-sorted by the digest order first, so each
    digest's lines come out in order while many tasks write.
    """
    attempt = uuid.uuid4().hex
    order = [*keys, "section_ord", "part", F.col("weighted").desc_nulls_first(), "input_ord", "line_ord"]
    text = lines.orderBy(*order).select(*keys, "line").write
    (text.partitionBy(*keys) if keys else text).text(f"{root}/lines/attempt={attempt}")
    position = ["section_ord", "part", "input_ord", "line_ord"]
    wanted = digest_dates(lines, keys, fallback_date, position)
    if date is not None:
        wanted = wanted.withColumn("digest_date", F.lit(date))
    while True:
        published = commits(spark, root)
        known = names(spark, root, keys, published)
        if known is None:
            known = wanted.select(*keys, F.lit("").alias("file_name")).where(F.lit(False))
        commit = f"{len(published):012d}-{attempt}"
        path = f"{root}/names/commit={commit}"
        (ar.next_sequence(known, wanted, keys).withColumn("attempt", F.lit(attempt))
           .select(*keys, "digest_date", "digest_seq", "file_name", "attempt").write.mode("overwrite").parquet(path))
        try:
            claim(spark, root, len(published), attempt)
        except NumberTaken:
            continue
        return names(spark, root, keys, [commit])


def folder_listing(spark: SparkSession, path: str) -> DataFrame:
    """A8 over plain folders of digest files: ``folder, file_name, path``, from the listing; no content is read."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(path)
                  .select("path"))
    return files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"),
                        F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "path")
