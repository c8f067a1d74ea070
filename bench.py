"""Timed headline queries; prints one JSON line.

``BENCH_SF_DIR`` (tables), ``BENCH_CPUS`` (cores), ``BENCH_RUNS`` (timed runs per query).
Each query runs once to warm up; the median of the timed runs
counts (slow queries: one run).  A run builds the
query anew and writes its whole result to the ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "v8_top_codes",
    "v3_parse_multivalue",
    "c5_clean_zip",
    "c8_standardize_text",
    "c17_categorize",
    "c18_clean_category_text",
    "p1_describe_lineitem",
    "p11_crosstab_margins",
    "p17_duplicates_by_key",
    "p18_conflict_rows",
    "d2_discover_fds",
    "d3_discover_keys",
    "d9_discover_afds",
    "d12_repair_by_fd",
    "d16_discover_inds",
    "d18_substring_inds",
    "a4_association_rules",
    "t1_token_counts",
    "t4_snap_to",
    "t8_char_tfidf",
    "t10_close_matches",
    "t2_detect_typos",
    "w1_clean",
)


#: Seconds of the warm-up beyond which a query is timed once.
SLOW = 20


def main() -> None:
    import checks
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = sys.argv[1:]
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tablewright-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in only or HEADLINE:
        laps = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            checks.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            laps.append(time.perf_counter() - start)
            spark.catalog.clearCache()
            if len(laps) > 1 and laps[0] > SLOW:
                break
        times[name] = round(statistics.median(laps[1:]), 3)
        print(f"{name}: {times[name]} s (first {laps[0]:.2f})", file=sys.stderr, flush=True)
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else None,
                "cpus": int(cpus),
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
