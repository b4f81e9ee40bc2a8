"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  folder of the parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_MEMORY  driver memory (default 16g)
"""

from __future__ import annotations

import json
import os
import sys
import time

from wirefold import build_session
from wirefold.workload import load

HEADLINE = (
    "feed_page", "feed_total", "feed_facets", "feed_activity_tz", "buckets", "headline_tokens",
    "story_keys", "headline_pairs_similarity", "story_dedupe", "feed_after_dedupe", "other_outlets",
    "company_dedupe", "deal_dedupe", "round_known_range_semi", "rounds_by_stage", "stage_counts",
    "firm_alias_join", "firm_activity", "upcoming_past_split", "organiser_counts", "source_health",
    "source_due", "spend_snapshot", "spend_by_feature", "page_links", "page_text", "page_posts",
    "prompt_batches", "apply_answers", "bm25_search", "chunk_repair", "upsert_events",
    "stream_once_keys", "stream_refresh",
)


def main() -> int:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("wirefold-bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus),
                          **{"spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")})
    spark.sparkContext.setLogLevel("ERROR")
    known = load()
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{folder}/orders.parquet").selectExpr("count(*)").collect()   # JVM warm-up
    seconds = {}
    for name in names:
        start = time.perf_counter()
        known[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline query seconds, total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
