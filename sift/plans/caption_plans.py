"""Caption and transcript queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sift.functions.text import strip_tags
from sift.operators import captions as cp
from sift.plans import fixtures
from sift.sources.tables import read_table

DURATION_PER_UNIT = 37.0


def q_caption_lines_kept(spark, sf_dir):
    """F1 + B11: caption lines that survive note/cue/blank filtering, tags removed."""
    return cp.clean_lines(fixtures.caption_lines(spark, sf_dir))


def q_caption_transcripts(spark, sf_dir):
    """caption text per video, first occurrences joined by spaces."""
    return cp.transcripts(fixtures.caption_lines(spark, sf_dir))


def q_preferred_caption_file(spark, sf_dir):
    """F3."""
    return cp.preferred_file(fixtures.caption_files(spark, sf_dir)).select(
        "media_id", "file_name", F.col("pattern_rank").cast("int").alias("pattern_rank"))


def q_audio_segments(spark, sf_dir):
    """parts of at most 600 s for every line item (duration = quantity × 37 s)."""
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    media = li.select("l_orderkey", "l_linenumber", (F.col("l_quantity") * DURATION_PER_UNIT).alias("duration"))
    return cp.segments(media).select("l_orderkey", "l_linenumber", F.col("part_idx").cast("int").alias("part_idx"),
                                     "start_s", "end_s")


def _parts(spark, sf_dir):
    cv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    return cv.select(F.col("conv_id").alias("media_id"), F.col("turn").alias("part_idx"), "text")


def q_assembled_transcripts(spark, sf_dir):
    """F8: recognised parts (turns) joined in order with blank lines."""
    return cp.assemble_parts(_parts(spark, sf_dir))


def q_transcript_choice(spark, sf_dir):
    """captions when non-empty, else the assembled parts."""
    caps = cp.transcripts(fixtures.caption_lines(spark, sf_dir, gaps=True))
    cv = read_table(spark, sf_dir, "conversations", "conv_id", "turn").where(F.col("turn") == 0)
    cid = F.col("media_id").cast("string")
    meta_c = F.struct(F.concat(F.lit("Talk "), cid).alias("title"),
                      F.concat(F.lit("https://video.example/w/"), cid).alias("url"),
                      F.concat(F.lit("host "), cid).alias("author"), F.lit("20240101").alias("date"),
                      F.lit(None).cast("double").alias("duration"))
    meta_p = F.struct(F.concat(F.lit("Audio "), cid).alias("title"),
                      F.concat(F.lit("https://video.example/a/"), cid).alias("url"),
                      F.lit(None).cast("string").alias("author"), F.lit(None).cast("string").alias("date"),
                      F.lit(None).cast("double").alias("duration"))
    # caption fetch succeeds (metadata present) unless conv_id mod 11 = 0
    fetched = cv.select(F.col("conv_id").alias("media_id")).where(F.col("media_id") % 11 != 0)
    c_side = fetched.join(caps, "media_id", "left").select("media_id", meta_c.alias("meta"), "transcript")
    p_side = cp.assemble_parts(_parts(spark, sf_dir)).select("media_id", meta_p.alias("meta"), "transcript")
    out = cp.choose_transcript(c_side, p_side)
    return out.select("media_id", "title", "url", "author", "transcript", "method", "source_tier")


def q_caption_outcomes(spark, sf_dir):
    """transcript or error text per video."""
    cv = read_table(spark, sf_dir, "conversations", "conv_id", "turn").where(F.col("turn") == 0)
    media = cv.select(F.col("conv_id").alias("media_id"))
    errors = media.where(F.col("media_id") % 11 == 0).select("media_id", F.lit("HTTP Error 429").alias("error"))
    return cp.caption_outcomes(media, cp.transcripts(fixtures.caption_lines(spark, sf_dir, gaps=True)), errors)


def q_media_metadata(spark, sf_dir):
    """Unified metadata of two export shapes."""
    return cp.unify_media(fixtures.media_exports(spark, sf_dir)).select(
        "media_id", "title", "url", "author", "date", "views", "description")


def q_strip_tags(spark, sf_dir):
    """Markup removed from every page."""
    p = read_table(spark, sf_dir, "pages", "page_id", "html")
    return p.select("page_id", strip_tags(F.col("html")).alias("text"))
