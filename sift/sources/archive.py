"""Digest archive: name parsing, latest digest of a listing (A8), URL extraction
(A9), next free name (A12) and the JSON sink (A14).

Names have the form ``YYYY-MM-DD[-N].md``; ``sources.store`` publishes under them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sift.functions.urls import extract_urls

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
DIGEST_NAME = r"^(\d{4}-\d{2}-\d{2})(?:-(\d+))?\.md$"        # archive file names
HEADER_DATE = r"(?m)^# Research Digest\s*[—–-]\s*(\d{4}-\d{2}-\d{2})"
FIRST_COLLISION_SEQ = 2                                        # base, then -2, -3, ...
# ---------------------------------------------------------------------------


def parse_digest_name(name: Column) -> Column:
    """struct(digest_date, n_digits, digits, digest_seq) or null when the name does
    not match (so ``.ko.md`` editions and other files are skipped).

    Digits without leading zeros, ordered by their number and then as text,
    order like the numbers, however long; ``digest_seq`` is null beyond a bigint.
    """
    ok = name.rlike(DIGEST_NAME)
    digits = F.regexp_replace(F.regexp_extract(name, DIGEST_NAME, 2), "^0+", "")
    return F.when(ok, F.struct(
        F.regexp_extract(name, DIGEST_NAME, 1).alias("digest_date"), F.length(digits).alias("n_digits"), digits.alias("digits"),
        F.when(digits == "", F.lit(0).cast("bigint")).otherwise(digits.try_cast("bigint")).alias("digest_seq")))


def latest_digest(files: DataFrame, keys: list[str], name_col: str = "file_name", *carry: str) -> DataFrame:
    """Per folder, the file with the greatest (date, suffix), and its columns ``carry``; no suffix = 0."""
    parsed = files.withColumn("_p", parse_digest_name(F.col(name_col))).where(F.col("_p").isNotNull())
    file = F.struct(F.col(name_col).alias("latest_file"), *carry)
    return (parsed.groupBy(*keys).agg(F.max_by(file, F.struct("_p", name_col)).alias("_f"), F.max("_p").alias("_m"))
                  .select(*keys, "_f.latest_file", "_m.digest_date", "_m.digest_seq", *[f"_f.{c}" for c in carry]))


def unique_urls(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """URLs of each text, unique, with the position of the first sighting."""
    return (docs.select(*keys, F.posexplode(extract_urls(F.col(text_col))).alias("pos", "url"))
                .groupBy(*keys, "url").agg(F.min("pos").alias("first_pos")))


def header_date(text: Column, fallback_date: str) -> Column:
    """A12 date rule: the header line's date, else the given fallback (today)."""
    d = F.regexp_extract(text, HEADER_DATE, 1)
    return F.when(d != "", d).otherwise(F.lit(fallback_date))


def next_sequence(existing: DataFrame, wanted: DataFrame, keys: list[str],
                  name_col: str = "file_name") -> DataFrame:
    """First free name per (keys, digest_date): the base name, else -2, -3, ...

    ``existing``: keys + file names; ``wanted``: keys + ``digest_date``.
    Taken slots are 1 for the base name and N ≥ 2 for ``-N``.  Candidates
    1..taken+1 are generated per wanted digest and anti-joined with the
    taken slots; the smallest survivor wins.
    """
    name = F.col(name_col)
    suffix = F.regexp_extract(name, DIGEST_NAME, 2)
    slot = (F.when(suffix == "", F.lit(1))
             .when(suffix.try_cast("bigint") >= FIRST_COLLISION_SEQ, suffix.try_cast("bigint")))
    taken = (existing.where(name.rlike(DIGEST_NAME))
                     .select(*keys, F.regexp_extract(name, DIGEST_NAME, 1).alias("digest_date"),
                             slot.alias("slot"))
                     .where(F.col("slot").isNotNull())
                     .distinct())
    n_taken = taken.groupBy(*keys, "digest_date").agg(F.count(F.lit(1)).alias("n_taken"))
    cands = (wanted.join(n_taken, [*keys, "digest_date"], "left")
                   .select(*keys, "digest_date",
                           F.explode(F.sequence(F.lit(1).cast("bigint"), F.coalesce(F.col("n_taken"), F.lit(0)) + 1))
                            .alias("slot"))
                   .where((F.col("slot") == 1) | (F.col("slot") >= FIRST_COLLISION_SEQ)))
    free = cands.join(taken, [*keys, "digest_date", "slot"], "left_anti")
    best = free.groupBy(*keys, "digest_date").agg(F.min("slot").alias("slot"))
    return best.select(
        *keys, "digest_date",
        F.when(F.col("slot") == 1, F.lit(0)).otherwise(F.col("slot")).alias("digest_seq"),
        F.concat(F.col("digest_date"),
                 F.when(F.col("slot") == 1, F.lit("")).otherwise(F.concat(F.lit("-"), F.col("slot").cast("string"))),
                 F.lit(".md")).alias("file_name"))


def to_json_lines(df: DataFrame) -> DataFrame:
    """One JSON object per row (``to_json(struct(*))``)."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
