"""Digest statistics, category roll-up and rendering.

A digest is produced as *line rows* carrying their own sort key
``(section_ord, part, weighted desc, input_ord, line_ord)``; nothing is
numbered with a global window, so a digest of any size is rendered by a
range-partitioned sort and written by many tasks.  Fixed lines (headings,
placeholders, footer) come from one aggregate row per digest, exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sift.functions.scoring import VERDICT_MUST_READ
from sift.functions.text import DEFAULT_AUTHOR, DEFAULT_TITLE

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
CATEGORIES = (
    "AI Labs & Models",
    "Developer Tools & IDEs",
    "Engineering & Infrastructure",
    "Research Papers",
    "MLOps & ML Systems",
    "Agents & Frameworks",
    "Video & Audio",
    "Market & Funding",
)
UNCATEGORIZED = "Uncategorized"
TITLE_LINE = "# Research Digest — {date}"
MUST_READ_HEADING = "## MUST READ (score >= 4.5)"
NO_MUST_READ = "No items scored above 4.5."
NO_CATEGORY_ITEMS = "No items passed the quality threshold."
STATE_HEADING = "## State of the World"
STATE_PLACEHOLDER = "[To be synthesized by LLM]"
ACTIONS_HEADING = "## Top 3 Action Items"
ACTIONS_PLACEHOLDER = "[To be generated by LLM]"
RULE_LINE = "---"
MISSED_STATUSES = ("timeout", "error", "no_response")   # footer order
# ---------------------------------------------------------------------------

SEC_HEADER, SEC_MUST, SEC_STATE, SEC_ACTIONS, SEC_FOOTER = 0, 1, 10, 11, 12
# category sections are 2..9 in CATEGORIES order


def section_ord() -> Column:
    """H1: MUST READ items only in the top section, others by category;
    a category outside the list (or none) gets null and is not rendered."""
    cat = F.coalesce(F.col("category"), F.lit(UNCATEGORIZED))
    by_cat = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), cat)
    return (F.when(F.col("verdict") == VERDICT_MUST_READ, F.lit(SEC_MUST))
            .when(by_cat > 0, (by_cat + 1).cast("int")))


def _weighted_text(c: Column) -> Column:
    # a missing score prints as the integer 0
    return F.coalesce(c.cast("string"), F.lit("0"))


def item_block(prefix_scores: str = "scores") -> Column:
    """The five lines of one item as an array<string>."""
    s = F.col(prefix_scores)
    score_str = F.concat(
        F.lit("R:"), F.coalesce(s["R"].cast("string"), F.lit("0")),
        F.lit(" Q:"), F.coalesce(s["Q"].cast("string"), F.lit("0")),
        F.lit(" N:"), F.coalesce(s["N"].cast("string"), F.lit("0")),
        F.lit(" A:"), F.coalesce(s["A"].cast("string"), F.lit("0")),
        F.lit(" S:"), F.coalesce(s["S"].cast("string"), F.lit("0")))
    summary = F.coalesce(F.nullif(F.col("tldr"), F.lit("")), F.col("summary"), F.lit(""))
    return F.array(
        F.concat(F.lit("- **"), F.coalesce(F.col("title"), F.lit(DEFAULT_TITLE)),
                 F.lit("** ("), _weighted_text(F.col("weighted")), F.lit(")")),
        F.concat(F.lit("  "), F.coalesce(F.col("author"), F.lit(DEFAULT_AUTHOR)),
                 F.lit(" | "), F.coalesce(F.col("date"), F.lit(""))),
        F.concat(F.lit("  "), F.coalesce(F.col("url"), F.lit(""))),
        F.concat(F.lit("  "), summary),
        F.concat(F.lit("  Scores: "), score_str),
    )


def digest_stats(items: DataFrame, keys: list[str]) -> DataFrame:
    """E5 + E6: passed, must-reads and items per section, one row per digest.

    Map-side partial aggregation keeps this cheap even when one digest key
    holds most of the items.
    """
    sec = F.col("_sec")
    aggs = [F.count(F.lit(1)).alias("passed"),
            F.count_if(F.col("verdict") == VERDICT_MUST_READ).alias("must_reads")]
    aggs += [F.count_if(sec == k).alias(f"n_sec{k}") for k in range(SEC_MUST, SEC_MUST + 9)]
    return items.withColumn("_sec", section_ord()).groupBy(*keys).agg(*aggs)


def category_rollup(items: DataFrame) -> DataFrame:
    """Item count per listed category in the fixed order, empty ones kept
    (MUST READ items are counted in their own section, as rendered)."""
    stats = digest_stats(items, [])
    rows = [F.struct(F.lit(i + 1).alias("category_ord"), F.lit(c).alias("category"),
                     F.col(f"n_sec{i + 2}").alias("n_items"))
            for i, c in enumerate(CATEGORIES)]
    return stats.select(F.inline(F.array(*rows)))


def footer_lines(stats: DataFrame, scanned: Column, coverage: DataFrame | None,
                 sweep_num: int | None, generated_at: str) -> Column:
    """H2: footer as an array of lines (the coverage line is optional)."""
    first = F.concat(F.lit("Items scanned: "), scanned.cast("string"),
                     F.lit(" | Passed: "), F.col("passed").cast("string"),
                     F.lit(" | Must-reads: "), F.col("must_reads").cast("string"))
    tag = f" (sweep #{sweep_num})" if sweep_num else ""
    lines = [F.lit(RULE_LINE), first]
    if coverage is not None:
        missed_parts = F.filter(F.array(*[
            F.when(F.coalesce(F.col(f"cov_{st}"), F.lit(0)) != 0,
                   F.concat(F.col(f"cov_{st}").cast("string"), F.lit(" " + st.replace("_", " "))))
            for st in MISSED_STATUSES]), lambda x: x.isNotNull())
        missed_str = F.when(F.size(missed_parts) > 0,
                            F.concat(F.lit(" ("), F.array_join(missed_parts, ", "), F.lit(")"))
                            ).otherwise(F.lit(""))
        pct_text = F.bround(F.col("cov_pct"), 0).cast("bigint").cast("string")
        lines.append(F.concat(
            F.lit("Sources: "), F.col("cov_visited").cast("string"), F.lit("/"),
            F.col("cov_total").cast("string"), F.lit(" visited ("), pct_text, F.lit("%) | "),
            (F.col("cov_total") - F.col("cov_visited")).cast("string"), F.lit(" missed"), missed_str))
    lines.append(F.lit(f"Generated: {generated_at} UTC{tag}"))
    lines.append(F.lit(""))
    return F.array(*lines)


def _fixed(sec: int, part: int, line_ord: int, text: Column) -> Column:
    return F.struct(F.lit(sec).alias("section_ord"), F.lit(part).alias("part"),
                    F.lit(line_ord).alias("line_ord"), text.alias("line"))


def render(items: DataFrame, date_str: str, *, keys: list[str] | None = None,
           scanned: DataFrame | int | None = None, state_of_world: str = "",
           action_items: str = "", sweep_num: int | None = None,
           coverage: DataFrame | None = None, generated_at: str = "1970-01-01 00:00") -> DataFrame:
    """H3: digest lines of scored, filtered items.

    Returns ``keys..., section_ord, part, weighted, input_ord, line_ord, line``;
    sort by those columns (``weighted`` descending) to get the text.
    ``scanned`` is a number, or a DataFrame ``keys..., scanned``.
    ``coverage`` is a one-row coverage report (see ``coverage.report``).
    """
    keys = list(keys or [])
    secd = items.withColumn("section_ord", section_ord())
    body = (secd.where(F.col("section_ord").isNotNull())
                .select(*keys, "section_ord", F.lit(1).alias("part"), "weighted", "input_ord",
                        F.posexplode(F.concat(item_block(), F.array(F.lit("")))).alias("line_ord", "line")))

    stats = digest_stats(items, keys)
    if isinstance(scanned, DataFrame):
        if keys:   # every scanned key has a digest, also one with no item left
            counts = [c for c in stats.columns if c not in keys]
            stats = scanned.join(stats, keys, "left").select(
                *keys, "scanned", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
            scanned_col = F.coalesce(F.col("scanned"), F.lit(0))
        else:   # one number: scalar subquery, no join
            scanned_col = F.coalesce(scanned.select("scanned").scalar(), F.lit(0))
    else:
        scanned_col = F.lit(int(scanned or 0))
    if coverage is not None:
        # one-row report: each figure is a scalar subquery, not a join
        stats = stats.select(
            "*",
            coverage.select("total_sources").scalar().alias("cov_total"),
            coverage.select("sources_visited").scalar().alias("cov_visited"),
            coverage.select("coverage_pct").scalar().alias("cov_pct"),
            *[coverage.select(F.coalesce(F.col("by_status")[st], F.lit(0))).scalar().alias(f"cov_{st}")
              for st in MISSED_STATUSES])

    fixed = [
        _fixed(SEC_HEADER, 0, 0, F.lit(TITLE_LINE.format(date=date_str))),
        _fixed(SEC_HEADER, 0, 1, F.lit("")),
        _fixed(SEC_MUST, 0, 0, F.lit(MUST_READ_HEADING)),
        _fixed(SEC_MUST, 0, 1, F.lit("")),
        F.when(F.col(f"n_sec{SEC_MUST}") == 0, _fixed(SEC_MUST, 2, 0, F.lit(NO_MUST_READ))),
        F.when(F.col(f"n_sec{SEC_MUST}") == 0, _fixed(SEC_MUST, 2, 1, F.lit(""))),
    ]
    for i, cat in enumerate(CATEGORIES):
        sec = i + 2
        fixed += [
            _fixed(sec, 0, 0, F.lit(f"## {cat}")),
            _fixed(sec, 0, 1, F.lit("")),
            F.when(F.col(f"n_sec{sec}") == 0, _fixed(sec, 2, 0, F.lit(NO_CATEGORY_ITEMS))),
            F.when(F.col(f"n_sec{sec}") == 0, _fixed(sec, 2, 1, F.lit(""))),
        ]
    fixed += [
        _fixed(SEC_STATE, 0, 0, F.lit(STATE_HEADING)),
        _fixed(SEC_STATE, 0, 1, F.lit("")),
        _fixed(SEC_STATE, 0, 2, F.lit(state_of_world or STATE_PLACEHOLDER)),
        _fixed(SEC_STATE, 0, 3, F.lit("")),
        _fixed(SEC_ACTIONS, 0, 0, F.lit(ACTIONS_HEADING)),
        _fixed(SEC_ACTIONS, 0, 1, F.lit("")),
        _fixed(SEC_ACTIONS, 0, 2, F.lit(action_items or ACTIONS_PLACEHOLDER)),
        _fixed(SEC_ACTIONS, 0, 3, F.lit("")),
    ]
    stats = stats.withColumn("_scanned", scanned_col)
    footer = footer_lines(stats, F.col("_scanned"), coverage, sweep_num, generated_at)
    footer_rows = F.transform(footer, lambda line, i: F.struct(
        F.lit(SEC_FOOTER).alias("section_ord"), F.lit(0).alias("part"),
        i.alias("line_ord"), line.alias("line")))
    all_fixed = F.concat(F.filter(F.array(*fixed), lambda x: x.isNotNull()), footer_rows)
    fixed_rows = (stats.select(*keys, F.inline(all_fixed))
                       .select(*keys, "section_ord", "part", F.lit(None).cast("double").alias("weighted"),
                               F.lit(None).cast("bigint").alias("input_ord"), "line_ord", "line"))
    return body.unionByName(fixed_rows)


def ordered_lines(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The text order (range-partitioned sort, no single task)."""
    keys = list(keys or [])
    return lines.orderBy(*keys, "section_ord", "part", F.col("weighted").desc_nulls_first(),
                         "input_ord", "line_ord")
