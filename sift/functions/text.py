"""Small text column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
SUMMARY_LIMIT = 500          # longer summaries become 497 chars + "..."
SUMMARY_KEEP = 497
ELLIPSIS = "..."
DESCRIPTION_LIMIT = 500      # media descriptions are cut hard at 500
# Defaults of the five-line item block:
DEFAULT_TITLE = "Untitled"
DEFAULT_AUTHOR = "Unknown"
# ---------------------------------------------------------------------------


def truncate_summary(c: Column) -> Column:
    """> 500 chars → first 497 + '...'."""
    return (F.when(F.length(c) > SUMMARY_LIMIT,
                   F.concat(F.substring(c, 1, SUMMARY_KEEP), F.lit(ELLIPSIS)))
            .otherwise(c))


def cut_description(c: Column) -> Column:
    """B6 (media form): hard cut at 500 chars, null → ''."""
    return F.substring(F.coalesce(c, F.lit("")), 1, DESCRIPTION_LIMIT)


def first_nonempty(*cols: Column) -> Column:
    """First value that is neither null nor ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def strip_tags(c: Column) -> Column:
    """Remove <...> markup."""
    return F.regexp_replace(c, "<[^>]+>", "")


def trimmed(c: Column) -> Column:
    """Trim like Python's str.strip() on ASCII whitespace."""
    return F.regexp_replace(c, r"^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$", "")
