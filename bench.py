"""Times the headline queries and prints one JSON line.

Each query is planned and run once to warm up, then timed over planning and
full execution of every output row. Settings: BENCH_SF_DIR, BENCH_CPUS.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tidemark.session import build_session
from workload.queries import QUERIES

HEADLINE = (
    "codings", "latest_by_coding", "history_window",
    "stats_none", "stats_all_subjects", "stats_day", "stats_hour_ny", "stats_thresholds", "stats_episode",
    "next_sample_intervals", "episodes", "runs_in_range",
    "table_day_mean_multi", "table_month_all_aggs", "table_none", "table_duration_in_range", "table_longest_run", "table_episode",
    "table_confidence", "relationship_day", "relationship_hour_lag_ny", "relationship_threshold", "relationship_episode_lag",
    "current_problems", "current_medications", "supersede_newest", "notification_dispatch",
    "search_terms", "search_phrase_prefix_not", "verify_claims", "dedup_content", "ingest_heart_rate", "sleep_epochs",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in names:
        query, _ = QUERIES[name]
        runs = []
        for _ in range(3):
            started = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
