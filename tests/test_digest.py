"""Rendered digest equals a plain-Python model."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sift.operators import coverage as cv
from sift.operators import digest as dg

CATS = list(dg.CATEGORIES)


def model(items, date, scanned, sweep=None, cov=None, now="2026-03-17 06:00"):
    """Plain-Python digest text (slow model used only here)."""
    def block(it):
        s = it.get("scores") or {}
        sc = " ".join(f"{k}:{s.get(k) if s.get(k) is not None else 0}" for k in "RQNAS")
        w = it.get("weighted")
        return "\n".join([f"- **{it.get('title') or 'Untitled'}** ({w if w is not None else 0})",
                          f"  {it.get('author') or 'Unknown'} | {it.get('date') or ''}",
                          f"  {it.get('url') or ''}", f"  {it.get('tldr') or it.get('summary') or ''}",
                          f"  Scores: {sc}"])
    order = sorted(range(len(items)), key=lambda i: (-(items[i].get("weighted") or 0), i))
    out = [f"# Research Digest — {date}", "", "## MUST READ (score >= 4.5)", ""]
    must = [items[i] for i in order if items[i].get("verdict") == "MUST READ"]
    out += sum([[block(i), ""] for i in must], []) or ["No items scored above 4.5.", ""]
    for cat in CATS:
        out += [f"## {cat}", ""]
        sec = [items[i] for i in order if items[i].get("verdict") != "MUST READ"
               and (items[i].get("category") or "Uncategorized") == cat]
        out += sum([[block(i), ""] for i in sec], []) or ["No items passed the quality threshold.", ""]
    out += ["## State of the World", "", "[To be synthesized by LLM]", "",
            "## Top 3 Action Items", "", "[To be generated by LLM]", "", "---"]
    foot = f"Items scanned: {scanned} | Passed: {len(items)} | Must-reads: {len(must)}"
    if cov:
        parts = [f"{cov['by_status'][s]} {s.replace('_', ' ')}" for s in ("timeout", "error", "no_response")
                 if cov["by_status"].get(s)]
        miss = f" ({', '.join(parts)})" if parts else ""
        foot += (f"\nSources: {cov['visited']}/{cov['total']} visited ({cov['pct']:.0f}%) | "
                 f"{cov['total'] - cov['visited']} missed{miss}")
    out += [foot, f"Generated: {now} UTC" + (f" (sweep #{sweep})" if sweep else ""), ""]
    return "\n".join(out)


SCHEMA = T.StructType([
    T.StructField("input_ord", T.LongType()), T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("author", T.StringType()),
    T.StructField("date", T.StringType()), T.StructField("summary", T.StringType()),
    T.StructField("tldr", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("scores", T.StructType([T.StructField(k, T.IntegerType()) for k in "RQNAS"])),
    T.StructField("weighted", T.DoubleType()), T.StructField("verdict", T.StringType())])

ITEMS = [
    dict(title="A", url="https://a.test/1", author="x", date="2026-03-16", summary="s1", tldr=None,
         category="Research Papers", scores=dict(R=5, Q=5, N=5, A=5, S=5), weighted=5.0, verdict="MUST READ"),
    dict(title=None, url="https://a.test/2", author=None, date=None, summary="s2", tldr="t2",
         category="Research Papers", scores=dict(R=4, Q=3, N=4, A=3, S=3), weighted=3.5, verdict="PASS"),
    dict(title="C", url="https://a.test/3", author="z", date="d", summary="s3", tldr="",
         category="Research Papers", scores=dict(R=5, Q=4, N=4, A=5, S=4), weighted=4.42, verdict="PASS"),
    dict(title="D", url="https://a.test/4", author="z", date="d", summary="s4", tldr=None,
         category="Elsewhere", scores=dict(R=4, Q=4, N=4, A=4, S=4), weighted=4.0, verdict="PASS"),
    dict(title="E", url="https://a.test/5", author="z", date="d", summary="s5", tldr=None,
         category=None, scores=dict(R=4, Q=4, N=4, A=4, S=4), weighted=4.0, verdict="PASS"),
    dict(title="F", url="https://a.test/6", author="z", date="d", summary="s6", tldr=None,
         category="Video & Audio", scores=dict(R=4, Q=3, N=4, A=3, S=3), weighted=3.5, verdict="PASS"),
]


def _df(spark, items):
    rows = [dict(it, input_ord=i) for i, it in enumerate(items)]
    return spark.createDataFrame(rows, SCHEMA)


def _text(lines):
    return "\n".join(r.line for r in dg.ordered_lines(lines).collect())


def test_render_matches_model(spark):
    got = _text(dg.render(_df(spark, ITEMS), "2026-03-17", scanned=42, generated_at="2026-03-17 06:00"))
    assert got == model(ITEMS, "2026-03-17", 42)


def test_render_empty(spark):
    got = _text(dg.render(_df(spark, []), "2026-03-17", scanned=0, generated_at="2026-03-17 06:00"))
    assert got == model([], "2026-03-17", 0)


def test_render_with_coverage_and_sweep(spark):
    entries = spark.createDataFrame(
        [(0, 0, "s1", "a", "ok", None), (0, 1, "s1", "b", "timeout", None), (1, 0, "s2", "c", "error", "x"),
         (1, 1, "s2", "d", None, None), (1, 2, "s2", "e", "empty", None), (2, 0, "s3", "f", "ok", None),
         (2, 1, "s3", "g", "ok", None), (2, 2, "s3", "h", "ok", None)],
        "manifest_ord long, entry_ord long, scanner string, source_name string, status string, error string")
    rep = cv.report(cv.merge_sources(entries))
    got = _text(dg.render(_df(spark, ITEMS), "2026-03-17", scanned=7, coverage=rep, sweep_num=3,
                          generated_at="2026-03-17 06:00"))
    cov = dict(total=8, visited=5, pct=62.5, by_status={"timeout": 1, "error": 1, "no_response": 1})
    assert got == model(ITEMS, "2026-03-17", 7, sweep=3, cov=cov)
    assert "visited (62%)" in got          # half-even, as Python's format


def test_category_rollup_keeps_empty(spark):
    rows = dg.category_rollup(_df(spark, ITEMS)).collect()
    counts = {r.category: r.n_items for r in rows}
    assert [r.category for r in sorted(rows, key=lambda r: r.category_ord)] == CATS
    assert counts["Research Papers"] == 2 and counts["Video & Audio"] == 1 and counts["AI Labs & Models"] == 0


def test_stats(spark):
    st = dg.digest_stats(_df(spark, ITEMS), []).first()
    assert (st.passed, st.must_reads) == (6, 1)
