"""Caption files and transcripts.

Caption lines arrive as rows ``media_id, line_no, line``.  The only ordered
state (inside a NOTE block or not) comes from a parallel scan over blocks of
lines, so a medium of any length is many tasks' work.  First-occurrence dedup
is a map-side ``min`` aggregate rather than a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sift.functions.text import cut_description, first_nonempty, strip_tags, trimmed

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
HEADER_PREFIX = "WEBVTT"
NOTE_PREFIX = "NOTE"
CUE_ARROW = "-->"
# caption file patterns by priority (shell glob spelling)
CAPTION_PATTERNS = ("*.en.vtt", "*.en-orig.vtt", "*.vtt", "*.en.srt", "*.srt")
NO_CAPTIONS_ERROR = "No English captions available"
METHOD_CAPTIONS = "captions"
METHOD_SPEECH = "openrouter"          # method label of recognised parts
TRANSCRIPT_TIER = "7"
SEGMENT_SECONDS = 600
PART_SEPARATOR = "\n\n"
# ---------------------------------------------------------------------------


#: A block is 2 to this power of line numbers, then of blocks, and so on.
BLOCK_SHIFTS = (12, 16, 16, 16)


def _is_digits(c: Column) -> Column:
    return c.rlike(r"^\p{Nd}+$")


def last_mark_before(marks: DataFrame, shifts: tuple[int, ...] = BLOCK_SHIFTS) -> DataFrame:
    """(media_id, i, mark) → (media_id, i, state): the last non-null mark of a smaller ``i`` of the medium.

    A parallel scan.  A row is the function "set the state to my mark", or the
    identity if it has none; the function of a block of rows is that of its last
    mark.  The blocks' functions are scanned by the same rule, and handed down.
    No window holds more than ``2 ** shift`` rows, whatever a medium holds.
    """
    before = Window.partitionBy("media_id", "_block").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    # after all shifts of a 64-bit number a medium has a few blocks left, which one window takes
    blocked = marks.withColumn("_block", F.shiftright("i", shifts[0]) if shifts else F.lit(0).cast("bigint"))
    within = blocked.withColumn("state", F.last("mark", ignorenulls=True).over(before))
    if not shifts:
        return within.drop("_block")
    blocks = blocked.groupBy("media_id", "_block").agg(F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("i"))).alias("mark"))
    above = (last_mark_before(blocks.withColumnRenamed("_block", "i"), shifts[1:])
             .select("media_id", F.col("i").alias("_block"), F.col("state").alias("_above")))
    return (within.join(above, ["media_id", "_block"])
                  .withColumn("state", F.coalesce("state", "_above")).drop("_block", "_above"))


def clean_lines(lines: DataFrame, shifts: tuple[int, ...] = BLOCK_SHIFTS) -> DataFrame:
    """F1 + B11: kept caption lines with their tag-free text ``clean``.

    Drops header and NOTE lines, lines inside a NOTE block (which a blank
    line closes), cue timings, blanks and cue numbers.
    """
    line = trimmed(F.col("line"))
    mark = (F.when(line.startswith(HEADER_PREFIX), F.lit(None))
             .when(line.startswith(NOTE_PREFIX), F.lit("note"))
             .when(line == "", F.lit("blank")))
    staged = last_mark_before(lines.select("media_id", F.col("line_no").alias("i"), line.alias("_l"), mark.alias("mark")), shifts)
    l = F.col("_l")
    keep = (~l.startswith(HEADER_PREFIX) & ~l.startswith(NOTE_PREFIX)
            & ~F.coalesce(F.col("state") == "note", F.lit(False))
            & ~l.contains(CUE_ARROW) & (l != "") & ~_is_digits(l))
    return (staged.where(keep)
                  .select("media_id", F.col("i").alias("line_no"), strip_tags(l).alias("clean"))
                  .where(F.col("clean") != ""))


def first_occurrences(cleaned: DataFrame) -> DataFrame:
    """the first line of each distinct text per medium."""
    return cleaned.groupBy("media_id", "clean").agg(F.min("line_no").alias("line_no"))


def transcripts(lines: DataFrame) -> DataFrame:
    """caption text per medium, first occurrences joined by spaces."""
    firsts = first_occurrences(clean_lines(lines))
    return (firsts.groupBy("media_id")
                  .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "clean"))),
                                                lambda x: x["clean"]), " ").alias("transcript")))


def preferred_file(files: DataFrame, name_col: str = "file_name") -> DataFrame:
    """per medium the file of the best pattern; the name breaks ties."""
    name = F.col(name_col)
    visible = ~name.startswith(".")          # glob's '*' skips dot files
    prio = None
    for i, pat in enumerate(CAPTION_PATTERNS):
        cond = visible & name.endswith(pat[1:])
        prio = F.when(cond, F.lit(i + 1)) if prio is None else prio.when(cond, F.lit(i + 1))
    return (files.withColumn("_prio", prio).where(F.col("_prio").isNotNull())
                 .groupBy("media_id")
                 .agg(F.min_by(name, F.struct("_prio", name)).alias("file_name"),
                      F.min("_prio").alias("pattern_rank")))


def segments(media: DataFrame, duration_col: str = "duration",
             seconds: int = SEGMENT_SECONDS) -> DataFrame:
    """≤ ``seconds`` → one part; else fixed parts, the last one shorter."""
    d = F.col(duration_col)
    n = F.when(d <= seconds, F.lit(1)).otherwise(F.ceil(d / seconds)).cast("int")
    return (media.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("part_idx"))
                 .withColumn("start_s", (F.col("part_idx") * seconds).cast("double"))
                 .withColumn("end_s", F.when(d <= seconds, d)
                                       .otherwise(F.least((F.col("part_idx") + 1) * seconds, d)).cast("double")))


def assemble_parts(parts: DataFrame, key: str = "media_id") -> DataFrame:
    """F8: recognised parts in order, a blank line between them."""
    return (parts.groupBy(key)
                 .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_idx", "text"))),
                                               lambda x: x["text"]), PART_SEPARATOR).alias("transcript")))


def unify_media(exports: DataFrame) -> DataFrame:
    """One metadata shape out of search and caption-tool exports."""
    return exports.select(
        "media_id", "title",
        first_nonempty(F.col("url"), F.col("webpage_url")).alias("url"),
        first_nonempty(F.col("uploader"), F.col("channel")).alias("author"),
        F.col("upload_date").alias("date"), "duration", F.col("view_count").alias("views"),
        cut_description(F.col("description")).alias("description"))


def choose_transcript(captions: DataFrame, parts: DataFrame) -> DataFrame:
    """non-empty captions win, else the assembled parts.

    ``captions``: media_id, meta struct, transcript (may be null/empty);
    ``parts``: media_id, meta struct, transcript.  Metadata is taken whole
    from the captions side when it has any, else from the parts side.
    """
    c = captions.select("media_id", F.col("meta").alias("c_meta"), F.col("transcript").alias("c_text"))
    p = parts.select("media_id", F.col("meta").alias("p_meta"), F.col("transcript").alias("p_text"))
    j = c.join(p, "media_id", "full_outer")
    use_captions = F.coalesce(F.length("c_text") > 0, F.lit(False))
    meta = F.coalesce(F.col("c_meta"), F.col("p_meta"))
    return j.select(
        "media_id", meta["title"].alias("title"), meta["url"].alias("url"),
        meta["author"].alias("author"), meta["date"].alias("date"), meta["duration"].alias("duration"),
        F.when(use_captions, F.col("c_text")).otherwise(F.col("p_text")).alias("transcript"),
        F.when(use_captions, F.lit(METHOD_CAPTIONS))
         .when(F.col("p_text").isNotNull(), F.lit(METHOD_SPEECH)).alias("method"),
        F.lit(TRANSCRIPT_TIER).alias("source_tier"))


def caption_outcomes(media: DataFrame, texts: DataFrame, fetch_errors: DataFrame) -> DataFrame:
    """transcript or error per medium (tool error beats 'no captions')."""
    j = (media.select("media_id").join(texts, "media_id", "left")
              .join(fetch_errors.select("media_id", F.col("error").alias("fetch_error")), "media_id", "left"))
    failed = F.col("fetch_error").isNotNull()
    has_text = F.coalesce(F.length("transcript") > 0, F.lit(False))
    return j.select(
        "media_id",
        F.when(failed, F.lit(None)).otherwise(F.col("transcript")).alias("transcript"),
        F.lit(METHOD_CAPTIONS).alias("method"),
        F.when(failed, F.col("fetch_error")).when(~has_text, F.lit(NO_CAPTIONS_ERROR)).alias("error"))
