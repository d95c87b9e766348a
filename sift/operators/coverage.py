"""Scanner coverage: merge manifests, count by status, totals, misses.

Input is the exploded manifest form, one row per (manifest, source) entry:
``manifest_ord, entry_ord, scanner, source_name, status, error``.
``explode_manifests`` turns parsed manifest structs into that form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sift.sources.jsonfix import is_json

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
STATUS_OK = "ok"
STATUS_EMPTY = "empty"
STATUS_NO_RESPONSE = "no_response"      # what a missing status counts as
UNKNOWN_SCANNER = "unknown"
DEFAULT_TOTAL_SOURCES = 94              # fallback total when no source reported
VISITED = (STATUS_OK, STATUS_EMPTY)
# ---------------------------------------------------------------------------

MANIFEST_SCHEMA = ("struct<coverage:struct<scanner:string,"
                   "sources:map<string,struct<status:string,error:string>>>>")


def read_manifests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Landed manifest files, one JSON document each (a manifest or an array of
    them) → (manifests, quarantine).

    Manifests are ordered by file, then by their place in it; ``manifest_ord``
    is a struct of both, so files are read in parallel and nothing numbers them
    globally.  A file that is no JSON goes to the quarantine with its text; one
    that holds no manifest at all yields none.  Spark passes over files of no bytes.
    """
    files = (spark.read.format("binaryFile").load(path)
                  .select(F.col("path").alias("file_path"), F.btrim(F.col("content").cast("string"), F.lit(" \t\r\n")).alias("text")))
    listed = F.when(F.col("text").startswith("["), F.col("text")).otherwise(F.concat(F.lit("["), F.col("text"), F.lit("]")))
    parsed = files.withColumn("manifests", F.when(is_json(F.col("text")), F.from_json(listed, f"array<{MANIFEST_SCHEMA}>", {"mode": "PERMISSIVE"})))
    good = (parsed.select("file_path", F.posexplode("manifests").alias("place", "manifest"))
                  .select(F.struct("file_path", "place").alias("manifest_ord"), "manifest"))
    return good, parsed.where(F.col("manifests").isNull()).select("file_path", "text")


def explode_manifests(manifests: DataFrame, ord_col: str = "manifest_ord",
                      manifest_col: str = "manifest") -> DataFrame:
    """Parsed manifests → entry rows; manifests without coverage are skipped."""
    m = F.col(manifest_col)
    return (manifests.where(m["coverage"].isNotNull())
                     .select(F.col(ord_col).alias("manifest_ord"),
                             F.coalesce(m["coverage"]["scanner"], F.lit(UNKNOWN_SCANNER)).alias("scanner"),
                             F.posexplode(m["coverage"]["sources"]).alias("entry_ord", "source_name", "info"))
                     .select("manifest_ord", "entry_ord", "scanner", "source_name",
                             F.col("info.status").alias("status"), F.col("info.error").alias("error")))


def merge_sources(entries: DataFrame) -> DataFrame:
    """One row per source; the last entry wins, the first position is kept.

    ``max_by`` / ``min`` are partial aggregates: a source reported by many
    manifests is combined map-side before the shuffle.
    """
    pos = F.struct("manifest_ord", "entry_ord")
    return (entries.groupBy("source_name")
                   .agg(F.max_by(F.struct("scanner", "status", "error"), pos).alias("last"),
                        F.min(pos).alias("first_pos"))
                   .select("source_name", "last.scanner", "last.status", "last.error",
                           F.col("first_pos.manifest_ord").alias("first_manifest"),
                           F.col("first_pos.entry_ord").alias("first_entry")))


def by_status(sources: DataFrame) -> DataFrame:
    """Sources per status; a missing status counts as no_response."""
    return (sources.groupBy(F.coalesce(F.col("status"), F.lit(STATUS_NO_RESPONSE)).alias("status"))
                   .agg(F.count(F.lit(1)).alias("n_sources")))


def totals(sources: DataFrame, default_total: int = DEFAULT_TOTAL_SOURCES) -> DataFrame:
    """Total, visited (ok + empty) and percentage to 1 place, half-even.

    With no source at all the total falls back to ``default_total``.
    """
    agg = sources.agg(F.count(F.lit(1)).alias("n"),
                      F.count_if(F.col("status").isin(*VISITED)).alias("sources_visited"))
    total = F.when(F.col("n") > 0, F.col("n")).otherwise(F.lit(default_total)).cast("bigint")
    return agg.select(
        total.alias("total_sources"), "sources_visited",
        F.when(total > 0, F.bround(F.col("sources_visited") / total * 100, 1))
         .otherwise(F.lit(0.0)).alias("coverage_pct"))


def missed(sources: DataFrame) -> DataFrame:
    """Status other than ok/empty, a missing status included (kept null)."""
    return sources.where(~F.coalesce(F.col("status").isin(*VISITED), F.lit(False)))


def report(sources: DataFrame, default_total: int = DEFAULT_TOTAL_SOURCES) -> DataFrame:
    """One-row report for the digest footer: totals + ``by_status`` map.

    The map has one entry per status value (a handful), so it is bounded;
    the missed sources stay rows (``missed``) instead of one array.
    """
    counts = by_status(sources).agg(
        F.map_from_entries(F.collect_list(F.struct("status", "n_sources"))).alias("by_status"))
    t = totals(sources, default_total)
    return t.select("*", counts.select("by_status").scalar().alias("by_status"))


REPORT_SCHEMA = "total_sources bigint, sources_visited bigint, coverage_pct double, by_status map<string,bigint>"


def write_report(sources: DataFrame, path: str, default_total: int = DEFAULT_TOTAL_SOURCES) -> None:
    """The report as one JSON object under ``path/report`` and the missed sources, one JSON object each, under ``path/missed``."""
    report(sources, default_total).write.mode("overwrite").json(f"{path}/report")
    missed(sources).select(F.col("source_name").alias("name"), "scanner", "status", "error").write.mode("overwrite").json(f"{path}/missed")


def load_report(spark: SparkSession, path: str | None) -> DataFrame | None:
    """The report read back with its types, for the digest's footer; None without a path."""
    return None if not path else spark.read.schema(REPORT_SCHEMA).json(f"{path}/report")


def load_missed(spark: SparkSession, path: str) -> DataFrame:
    """The missed sources read back."""
    return spark.read.schema("name string, scanner string, status string, error string").json(f"{path}/missed")
