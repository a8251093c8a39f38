"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data (default /root/testdata/sf0.1), ``BENCH_CPUS`` the local
threads, ``BENCH_RUNS`` the timed runs per query (the median counts, after one warm-up).
Every result is computed in full and thrown away by a no-op write.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from fernweave import queries
from fernweave.session import build_session

HEADLINE = (
    "silver_flagship virtual_view silver_union bronze_run unified_dataset denormalised_table column_transformations "
    "related_tables unified_key_full_join link_join conditional_join compare_versions composite_enrichment "
    "inline_comparisons grid_text_dates predicate_tree offset_page numbered_page first_rows_per_group newest_history "
    "aligned_union keep_last_per_key best_unordered_pairs group_totals category_table completeness duplicate_total "
    "column_profile number_statistics merged_records hourly_rate snapshot_diff upsert_by_key change_feed "
    "discover_by_overlap discover_by_name graph_nodes mapping_coverage key_constraints template_strict normalized_spaces "
    "accents_removed extract_flag page_links streaming_upsert rate_windows"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g")}
    spark = build_session("fernweave-bench", f"local[{cpus}]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    known, times = queries.all_queries(), {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            known[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 4)
        print(f"{name} {times[name]}", file=sys.stderr)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1], "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
