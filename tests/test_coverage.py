"""E1-E4 on the hand-made manifest cases."""

from sift.operators import coverage as cv

ROWS = [
    # manifest 0 (scanner a)
    (0, 0, "a", "s1", "ok", None), (0, 1, "a", "s2", "error", "boom"), (0, 2, "a", "s3", "empty", None),
    # manifest 1 (scanner b): s2 again -> last wins; s4 without status
    (1, 0, "b", "s2", "ok", None), (1, 1, "b", "s4", None, None), (1, 2, "b", "s5", "timeout", "slow"),
]
SCHEMA = "manifest_ord long, entry_ord long, scanner string, source_name string, status string, error string"


def test_merge_last_wins(spark):
    m = {r.source_name: r for r in cv.merge_sources(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert m["s2"].status == "ok" and m["s2"].scanner == "b"
    assert (m["s2"].first_manifest, m["s2"].first_entry) == (0, 1)     # first position kept


def test_counts_totals_missed(spark):
    merged = cv.merge_sources(spark.createDataFrame(ROWS, SCHEMA))
    by = {r.status: r.n_sources for r in cv.by_status(merged).collect()}
    assert by == {"ok": 2, "empty": 1, "no_response": 1, "timeout": 1}
    t = cv.totals(merged).first()
    assert (t.total_sources, t.sources_visited, t.coverage_pct) == (5, 3, 60.0)
    missed = sorted((r.source_name, r.status) for r in cv.missed(merged).collect())
    assert missed == [("s4", None), ("s5", "timeout")]


def test_manifest_without_coverage_is_skipped(spark):
    m = spark.createDataFrame(
        [(0, {"coverage": {"scanner": None, "sources": {"x": {"status": "ok", "error": None}}}}),
         (1, {"coverage": None})], f"manifest_ord long, manifest {cv.MANIFEST_SCHEMA}")
    rows = cv.explode_manifests(m).collect()
    assert [(r.scanner, r.source_name) for r in rows] == [("unknown", "x")]


def test_empty_input_uses_default_total(spark):
    empty = cv.merge_sources(spark.createDataFrame([], SCHEMA))
    t = cv.totals(empty).first()
    assert (t.total_sources, t.sources_visited, t.coverage_pct) == (94, 0, 0.0)
    t0 = cv.totals(empty, default_total=0).first()
    assert (t0.total_sources, t0.coverage_pct) == (0, 0.0)


def test_pct_half_even(spark):
    rows = [(0, i, "a", f"s{i}", "ok" if i < 49 else "error", None) for i in range(400)]
    t = cv.totals(cv.merge_sources(spark.createDataFrame(rows, SCHEMA))).first()
    assert t.coverage_pct == round(49 / 400 * 100, 1) == 12.2
