"""Same results with 1, 4 and 64 shuffle partitions and shuffled input."""

import pytest

from sift.plans import catalog, coverage_plans, curation

from testpaths import SF_SMALL

QUERIES = {
    "coverage_sources": coverage_plans.q_coverage_sources,
    "top_items": curation.q_top_items,
    "digest_lines": curation.q_digest_lines,
    "batches": catalog.QUERIES["batches"],
    "story_groups": catalog.QUERIES["story_groups"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_result_any_partitioning(spark, name):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in ("1", "4", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(sorted(map(tuple, QUERIES[name](spark, SF_SMALL).collect()), key=repr))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1] == results[2]
