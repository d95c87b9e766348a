"""Plan shape: pushdown, no Python outside the JSON repair, no single-task stages."""

from sift.plans import catalog, curation, intake_plans, json_plans

from testpaths import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_prunes_columns(spark):
    plan = _plan(curation.q_seen_anti_join(spark, SF_SMALL))
    assert "ReadSchema: struct<doc_id:bigint>" in plan            # text not needed for this output
    assert "html:string" not in plan                             # pages.html never read
    assert "StringStartsWith(url,https://)" in plan               # seen filter pushed into parquet


def test_filter_pushed_to_scan(spark):
    plan = _plan(intake_plans.q_registry_tiers(spark, SF_SMALL))
    assert "PushedFilters" in plan


def test_python_only_in_json_repair(spark):
    for name, fn in catalog.QUERIES.items():
        if name.startswith("stream_") or name in ("batches", "story_groups", "best_per_story", "json_strict_sink"):
            continue                                 # these run jobs while being built
        plan = _plan(fn(spark, SF_SMALL))
        has_python = "ArrowEvalPython" in plan or "BatchEvalPython" in plan
        assert has_python == (name.startswith("json_") or name == "envelope_settings"), name


def test_single_partition_only_after_partial_aggregates(spark):
    """A single-partition exchange may only carry one partial aggregate row
    per task (global counts); rows of data never meet in one task."""
    for name in ("flagship", "digest_with_coverage", "scan_funnel", "caption_transcripts", "feed_items",
                 "seen_anti_join", "json_recovery"):
        lines = _plan(catalog.QUERIES[name](spark, SF_SMALL)).split("\n")
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                nxt = lines[i + 1]
                assert "partial_" in nxt or "Aggregate(keys=[]" in nxt, (name, nxt)


def test_json_recovery_scans_once(spark):
    plan = _plan(json_plans.recovered(spark, SF_SMALL))
    assert plan.count("FileScan") == 1 and plan.count("ArrowEvalPython") == 1


def test_registry_join_broadcast_at_runtime(spark):
    """No hint in the code: AQE measures the registry side and broadcasts it."""
    df = intake_plans.q_source_enrichment(spark, SF_SMALL)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in final
    assert "BroadcastHashJoin" in final
