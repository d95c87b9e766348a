"""Registry of the queries the driver runs, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sift.plans import archive_plans as arc
from sift.plans import caption_plans as capq
from sift.plans import coverage_plans as cov
from sift.plans import curation
from sift.plans import intake_plans as intake
from sift.plans import json_plans as jsonq
from sift.plans import publish_plans as pub
from sift.plans import rule_plans as ruleq
from sift.plans import story_plans as storyq
from sift.plans import stream_plans as streamq
from sift.plans import oracle_archive, oracle_captions, oracle_coverage, oracle_curation, oracle_intake, oracle_json
from sift.plans import oracle_publish, oracle_rules, oracle_stories, oracle_streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "score_items": curation.q_score_items,
    "canonical_urls": curation.q_canonical_urls,
    "seen_anti_join": curation.q_seen_anti_join,
    "top_items": curation.q_top_items,
    "digest_lines": curation.q_digest_lines,
    "flagship": curation.q_flagship,
    "digest_stats": curation.q_digest_stats,
    "category_rollup": curation.q_category_rollup,
    "coverage_sources": cov.q_coverage_sources,
    "coverage_by_status": cov.q_coverage_by_status,
    "coverage_totals": cov.q_coverage_totals,
    "coverage_missed": cov.q_coverage_missed,
    "digest_with_coverage": cov.q_digest_with_coverage,
    "latest_digest": arc.q_latest_digest,
    "extract_urls": arc.q_extract_urls,
    "next_digest_name": arc.q_next_digest_name,
    "parse_dates": intake.q_parse_dates,
    "timeframe_cutoffs": intake.q_timeframe_cutoffs,
    "registry_tiers": intake.q_registry_tiers,
    "registry_listing": intake.q_registry_listing,
    "sources_per_tier": intake.q_sources_per_tier,
    "registry_reconcile": intake.q_registry_reconcile,
    "source_enrichment": intake.q_source_enrichment,
    "feed_items": intake.q_feed_items,
    "feed_quarantine": intake.q_feed_quarantine,
    "feed_health": intake.q_feed_health,
    "feed_health_counts": intake.q_feed_health_counts,
    "summary_truncation": intake.q_summary_truncation,
    "json_recovery": jsonq.q_json_recovery,
    "json_strict_items": jsonq.q_json_strict_items,
    "json_recovery_stats": jsonq.q_json_recovery_stats,
    "envelope_settings": jsonq.q_envelope_settings,
    "caption_lines_kept": capq.q_caption_lines_kept,
    "caption_transcripts": capq.q_caption_transcripts,
    "preferred_caption_file": capq.q_preferred_caption_file,
    "audio_segments": capq.q_audio_segments,
    "assembled_transcripts": capq.q_assembled_transcripts,
    "transcript_choice": capq.q_transcript_choice,
    "caption_outcomes": capq.q_caption_outcomes,
    "media_metadata": capq.q_media_metadata,
    "strip_tags": capq.q_strip_tags,
    "url_specificity": ruleq.q_url_specificity,
    "max_age": ruleq.q_max_age,
    "style_flags": ruleq.q_style_flags,
    "cross_source_boost": ruleq.q_cross_source_boost,
    "scan_funnel": ruleq.q_scan_funnel,
    "batches": ruleq.q_batches,
    "story_groups": storyq.q_story_groups,
    "best_per_story": storyq.q_best_per_story,
    "published_digests": pub.q_published_digests,
    "latest_published": pub.q_latest_published,
    "manifest_sources": pub.q_manifest_sources,
    "manifest_quarantine": pub.q_manifest_quarantine,
    "coverage_report": pub.q_coverage_report,
    "coverage_missed_file": pub.q_coverage_missed_file,
    "digest_from_report": pub.q_digest_from_report,
    "json_strict_sink": pub.q_json_strict_sink,
    "large_feed_items": pub.q_large_feed_items,
    "registry_prose": pub.q_registry_prose,
    "boosted_verdicts": pub.q_boosted_verdicts,
    "stream_intake": streamq.q_stream_intake,
    "stream_window_counts": streamq.q_stream_window_counts,
    "stream_latest_status": streamq.q_stream_latest_status,
}

ORACLE: dict[str, str] = {**oracle_curation.ORACLE, **oracle_coverage.ORACLE, **oracle_archive.ORACLE,
                         **oracle_intake.ORACLE, **oracle_json.ORACLE, **oracle_publish.ORACLE,
                         **oracle_captions.ORACLE, **oracle_rules.ORACLE,
                         **oracle_stories.ORACLE, **oracle_streams.ORACLE}
