"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from cuewise.plans import catalog
from cuewise.session import build_session

HEADLINES = (
    "ranked_topk", "chat_reaction_scores", "chat_window_counts", "duplicate_groups", "speech_context", "score_candidates",
    "recompute_features", "logical_sense", "lexical_tags", "stats_tags", "stats_score_comparison", "bench_gate",
    "event_response_scores", "energy_percentiles", "pause_ranges", "keyword_topk", "latest_per_key", "revision_history",
    "review_upsert", "serialize_segments", "pack_candidates", "chat_ingest",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    wanted = tuple(sys.argv[1:]) or HEADLINES
    spark = build_session(cpus, "bench")
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads before timing
    times = {}
    for name in wanted:
        begin = time.perf_counter()
        # every row is produced and nothing is kept
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
