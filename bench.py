"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is executed to completion with the ``noop`` sink (no collect to the
driver); the first run of a small query warms the JVM and is not timed.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "competence_profile",      # flagship R4: validate → means → Kruskal–Wallis → stars
    "kruskal_wallis",          # lineitem, 3 measures
    "avg_rank",                # histogram ranks
    "exact_median",
    "box_summary",
    "describe_many",
    "grouped_stats",
    "quantile_normal",
    "spearman_matrix",
    "null_profile",
    "range_issues",
    "dedupe_exact",
    "dedupe_key_keep_first",
    "freq_share",
    "top_n_per_group",
    "crosstab_row_pct",
    "change_classes_rollup",
    "lump_rare",
    "mca_burt_counts",
    "ari",
    "silhouette",
    "eps_neighbors",
    "ingest_flow",
    "features_flow",
    "report_flow",
    "features_b_flow",
    "report_full",
    "silhouette_all",
    "composite_score",
    "kmeans_sweep",
    "ward_micro",
    "dbscan_labels",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("BENCH_CPUS", cpus)
    from tessera.plans.catalog import all_queries
    from tessera.session import get_session

    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    qs = all_queries()
    # warm-up (not timed): JVM code paths and the Python workers used by Arrow tasks
    qs["null_profile"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.range(0, 1000, numPartitions=int(cpus)).mapInPandas(lambda it: it, "id long") \
        .write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
