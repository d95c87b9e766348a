"""B2 date parsing and B3 timeframe cutoffs (C2 recency)."""

from datetime import datetime, timezone
from email.utils import parsedate_to_datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sift.functions.dates import cutoff, is_recent, parse_date

DATES = [
    ("Mon, 16 Mar 2026 10:00:00 GMT", datetime(2026, 3, 16, 10)),
    ("Mon, 16 Mar 2026 10:00:00 +0900", datetime(2026, 3, 16, 1)),
    ("Mon, 16 Mar 2026 10:00:00 -0000", datetime(2026, 3, 16, 10)),
    ("2026-03-16T10:00:00Z", datetime(2026, 3, 16, 10)),
    ("2026-03-16T10:00:00+09:00", datetime(2026, 3, 16, 1)),
    ("2026-03-16T10:00:00.123Z", datetime(2026, 3, 16, 10, 0, 0, 123000)),
    ("2026-03-16 10:00:00", datetime(2026, 3, 16, 10)),
    ("2026-03-16", datetime(2026, 3, 16)),
    ("2026", None), ("20260316", None), ("junk", None), ("", None), (None, None),
]


def test_parse_date(spark):
    df = spark.createDataFrame([(s,) for s, _ in DATES], "s string")
    got = [r[0] for r in df.select(parse_date(F.col("s"))).collect()]
    assert got == [e for _, e in DATES]


NOW = "2026-03-17 00:00:00"
FRAMES = [
    ("7d", datetime(2026, 3, 10)), ("24h", datetime(2026, 3, 16)), ("48 hours", datetime(2026, 3, 15)),
    ("14 days", datetime(2026, 3, 3)), ("2 weeks", datetime(2026, 3, 3)), ("1 month", datetime(2026, 2, 15)),
    (" 2 Years ", datetime(2024, 3, 17)), ("junk", datetime(2026, 3, 10)), ("abc days", datetime(2026, 3, 10)),
    ("-2 days", datetime(2026, 3, 19)),
]


@pytest.mark.parametrize("tf,expected", FRAMES)
def test_cutoff(spark, tf, expected):
    df = spark.createDataFrame([(tf,)], "tf string")
    assert df.select(cutoff(F.col("tf"), F.lit(NOW).cast("timestamp"))).first()[0] == expected


def test_recency_keeps_undated(spark):
    df = spark.createDataFrame([("2026-03-01",), ("2026-03-16",), ("whenever",)], "d string")
    c = F.lit("2026-03-10 00:00:00").cast("timestamp")
    kept = [r.d for r in df.where(is_recent(parse_date(F.col("d")), c)).collect()]
    assert kept == ["2026-03-16", "whenever"]


@st.composite
def mail_dates(draw):
    when = datetime(draw(st.integers(1970, 2060)), draw(st.integers(1, 12)), draw(st.integers(1, 28)),
                    draw(st.integers(0, 23)), draw(st.integers(0, 59)), draw(st.integers(0, 59)))
    weekday = draw(st.sampled_from(["", "%a, ", "%A, ", "%a "]))
    day = draw(st.sampled_from(["%d %b %Y", "%d %B %Y", "%d %b %y", "%d-%b-%Y", "%d-%b-%y", "%b %d %Y"]))
    clock = draw(st.sampled_from(["%H:%M:%S", "%H:%M"]))
    zone = draw(st.sampled_from([" GMT", " UT", " EST", " EDT", " PDT", " PST", " MST", " CDT", " +0900", " -0330", " -0000", " XYZ", ""]))
    if draw(st.booleans()) and draw(st.booleans()):
        return when.strftime("%a %b %d %H:%M:%S %Y")
    return when.strftime(weekday + day + " " + clock) + zone


def _standard(text):
    try:
        when = parsedate_to_datetime(text)
    except ValueError:
        return None
    return when if when.tzinfo is None else when.astimezone(timezone.utc).replace(tzinfo=None)


@settings(max_examples=6, deadline=None)
@given(st.lists(mail_dates(), min_size=60, max_size=120))
def test_mail_dates_agree_with_the_standard_library(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r[0] for r in df.select(F.date_format(parse_date(F.col("s")), "yyyy-MM-dd HH:mm:ss")).collect()]
    assert got == [w and w.strftime("%Y-%m-%d %H:%M:%S") for w in map(_standard, texts)]
