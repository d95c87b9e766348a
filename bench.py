"""Headline benchmark: runs the main curation jobs at one scale factor.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is executed in full with a no-op sink (every row computed, none
collected) and timed once, after one small warm-up query on the smallest
scale factor (a full warm-up pass of every query was measured to slow the
timed runs down rather than speed them up).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sift.plans import catalog  # noqa: E402
from sift.session import build_session  # noqa: E402

HEADLINE = (
    "flagship",              # H4: score → seen anti join → render (uncapped)
    "seen_anti_join",        # D1 + C1
    "digest_with_coverage",  # H2/H3 with the coverage report, capped
    "feed_items",            # A3-A6: XML snapshots → items
    "json_recovery",         # A10: malformed JSON, Python only for failures
    "caption_transcripts",   # F1 + F2
    "story_groups",          # F6: MinHash bands + components
    "scan_funnel",           # E8 + C4
    "coverage_sources",      # E1
    "stream_intake",         # S1, availableNow
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(2 * cpus, 8), app_name="sift-bench")
    warm = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    if os.path.isdir(warm):
        catalog.QUERIES["score_items"](spark, warm).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                      "cpus": cpus, "warmup_sf": 0.001 if os.path.isdir(warm) else None}))
    spark.stop()


if __name__ == "__main__":
    main()
