"""Date parsing (B2), timeframe cutoffs (B3) and the recency rules.

The clock is always an argument: plans stay deterministic, so Catalyst can
fold and push the cutoff into scans and joins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sift.functions.let import let

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
# Accepted: mail dates (weekday optional; day, month name, year with 2 or 4
# digits, in that order or month first, or with hyphens; or the C library's
# order with the year last; zone as name or offset), then ISO-like forms: date
# and time with T and a zone, with or without a fraction; date and time with a
# blank; date alone.  Values without a zone, and with an unknown one, are UTC.
ZONE_HOURS = {"ut": 0, "utc": 0, "gmt": 0, "z": 0, "est": -5, "edt": -4, "cst": -6, "cdt": -5,
              "mst": -7, "mdt": -6, "pst": -8, "pdt": -7, "ast": -4, "adt": -3}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september",
          "october", "november", "december")
CENTURY_PIVOT = 68           # two-digit years up to this are 20xx
# Timeframe units in hours; a month is 30 days, a year 365 days; anything
# unreadable means 7 days.
UNIT_HOURS = {"hour": 1, "day": 24, "week": 24 * 7, "month": 24 * 30, "year": 24 * 365}
DEFAULT_TIMEFRAME_HOURS = 24 * 7
# ---------------------------------------------------------------------------

# The ISO-like forms in DateTimeFormatter spelling (fractions take 1-6 digits).
_ISO = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ssxx", "yyyy-MM-dd'T'HH:mm:ss'Z'",
        "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxx",
        "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


_CLOCK = r"(\d{1,2}:\d{1,2}(?::\d{1,2})?)"
_NAME = r"([A-Za-z]{3,9})"
_YEAR = r"(\d{2}|\d{4})"
_ZONE = r"(?:\s+(\S+).*)?"
# What is left of a mail date without its weekday, and the same as ``|day|month|year|clock|zone``.
# With hyphens the zone must stand and nothing may follow it.
_MAIL_FORMS = (
    (rf"^(\d{{1,2}})\s+{_NAME}\s+{_YEAR}\s+{_CLOCK}{_ZONE}$", "|$1|$2|$3|$4|$5"),
    (rf"^(\d{{1,2}})-{_NAME}-{_YEAR}\s+{_CLOCK}\s+(\S+)$", "|$1|$2|$3|$4|$5"),
    (rf"^{_NAME}\s+(\d{{1,2}})\s+{_YEAR}\s+{_CLOCK}{_ZONE}$", "|$2|$1|$3|$4|$5"),
    (rf"^{_NAME}\s+(\d{{1,2}})\s+{_CLOCK}\s+(\d{{4}})$", "|$2|$1|$4|$3|"),
)
_OFFSET = r"^([+-])(\d{2})(\d{2})$"


def _mail_date(text: Column) -> Column:
    """A mail date as a timestamp or null; the names are mapped here because zone
    names read as regions would follow the season.  Each form only rewrites the
    text to one order of parts, so the parts are taken and converted once."""
    rest = F.regexp_replace(text, r"^[A-Za-z]+\.?,\s*|^(?i:mon|tue|wed|thu|fri|sat|sun)[a-z]*\s+", "")
    for form, parts in _MAIL_FORMS:
        rest = F.regexp_replace(rest, form, parts)
    months = F.create_map(*[x for i, m in enumerate(MONTHS, 1) for name in dict.fromkeys((m, m[:3])) for x in (F.lit(name), F.lit(i))])
    hours = F.create_map(*[x for z, h in ZONE_HOURS.items() for x in (F.lit(z), F.lit(h))])

    def stamp(p: Column) -> Column:
        day, month, year, clock, zone = (F.get(p, i) for i in range(1, 6))
        century = F.when(F.length(year) > 2, F.lit("")).when(year.try_cast("int") <= CENTURY_PIVOT, F.lit("20")).otherwise(F.lit("19"))
        seconds = F.when(F.length(clock) - F.length(F.replace(clock, F.lit(":"))) == 1, F.lit(":0")).otherwise(F.lit(""))
        minutes = F.coalesce(
            F.when(zone.rlike(_OFFSET), F.concat(F.substring(zone, 1, 1), F.lit("1")).try_cast("int")
                   * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int"))),
            hours[F.lower(zone)] * 60, F.lit(0))
        return F.struct(F.concat(century, year, F.lit("-"), months[F.lower(month)].cast("string"), F.lit("-"), day,
                                 F.lit(" "), clock, seconds).alias("local"), minutes.alias("minutes"))

    def instant(s: Column) -> Column:
        local = F.unix_micros(F.try_to_timestamp(s["local"], F.lit("yyyy-M-d H:m:s")))
        return F.timestamp_micros(local - s["minutes"].cast("long") * 60_000_000)

    return F.when(rest.startswith("|"), let(let(F.split(rest, r"\|", 6), stamp), instant))


def parse_date(c: Column) -> Column:
    """B2: text → timestamp (UTC) or null; never fails the job.

    There is no fallback to a plain cast, which would accept ``2026``.  Each
    ISO-like pattern is tried only when a cheap shape test says it could match:
    a failed parse costs an exception, so this only skips attempts bound to fail.
    """
    s = F.regexp_replace(c, r"^\s+|\s+$", "")
    iso_t = s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}T")
    frac = s.contains(".")
    guards = {
        "yyyy-MM-dd'T'HH:mm:ssXXX": iso_t & ~frac, "yyyy-MM-dd'T'HH:mm:ssxx": iso_t & ~frac,
        "yyyy-MM-dd'T'HH:mm:ss'Z'": iso_t & ~frac, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX": iso_t & frac,
        "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxx": iso_t & frac, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'": iso_t & frac,
        "yyyy-MM-dd HH:mm:ss": s.rlike(r"^\d{4}-\d{1,2}-\d{1,2} "),
        "yyyy-MM-dd": s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"),
    }
    tries = [F.when(s.rlike(r"[A-Za-z]{3}.*\d:\d"), _mail_date(s))]
    tries += [F.when(guards[p], F.try_to_timestamp(s, F.lit(p))) for p in _ISO]
    return F.when(F.length(s) > 0, F.coalesce(*tries))


def timeframe_hours(tf: Column) -> Column:
    """Timeframe text → number of hours back ('7d', '24h', 'N unit[s]')."""
    t = F.lower(F.regexp_replace(tf, r"^\s+|\s+$", ""))
    short = F.regexp_extract(t, r"^(\d+)([dh])$", 1)
    short_u = F.regexp_extract(t, r"^(\d+)([dh])$", 2)
    two = F.regexp_extract(t, r"^([+-]?\d+)\s+(\S+)$", 1)
    unit = F.regexp_replace(F.regexp_extract(t, r"^([+-]?\d+)\s+(\S+)$", 2), "s+$", "")
    unit_h = F.element_at(F.create_map(*[x for k, v in UNIT_HOURS.items()
                                        for x in (F.lit(k), F.lit(v).cast("bigint"))]), unit)
    hours = (F.when(short != "", F.try_multiply(short.try_cast("bigint"),
                                                F.when(short_u == "d", F.lit(24)).otherwise(F.lit(1))))
              .when((two != "") & unit_h.isNotNull(), F.try_multiply(two.try_cast("bigint"), unit_h)))
    return F.coalesce(hours, F.lit(DEFAULT_TIMEFRAME_HOURS)).cast("bigint")


def cutoff(tf: Column, now: Column) -> Column:
    """``now`` minus the timeframe, as a timestamp."""
    micros = F.try_subtract(F.unix_micros(now), F.try_multiply(timeframe_hours(tf), F.lit(3_600_000_000)))
    return F.timestamp_micros(F.coalesce(micros, F.unix_micros(now) - F.lit(DEFAULT_TIMEFRAME_HOURS * 3_600_000_000)))


def is_recent(published_at: Column, cut: Column) -> Column:
    """Only a parsed date older than the cutoff drops an item."""
    return published_at.isNull() | (published_at >= cut)
