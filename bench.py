"""Time the headline queries: one JSON line on standard output.

BENCH_SF_DIR is the directory of tables, BENCH_CPUS the cores. The cube is loaded first (query ``bulk_load`` holds that time);
each other query is run once to warm up and once for its time.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = {
    "q1_bulk_load": "bulk_load", "q2_point_lookup": "point_lookup", "q3_narrow_range": "range_narrow", "q4_wide_range": "range_wide", "q5_dim_filter": "pred_eq",
    "q6_multi_dim_filter": "multi_dim", "q7_range_agg": "agg_range_sidecar", "q8_full_scan": "scan_checksum", "q9_inserts": "insert_view", "q10_deletes": "delete_one_occurrence",
    "q11_hypercube": "hypercube", "q12_group_by": "group_sum", "q13_correlated": "corr_product", "q14_moving_window": "moving_window", "q15_adhoc_drill": "adhoc_drill",
    "q16_topk_groups": "topk_groups", "q17_having": "having", "q18_ym_rollup": "rollup_ym", "q19_corr_multi_dim": "corr_state_product", "q20_yoy_semijoin": "yoy_left",
    "q21_or_bitmap": "pred_or_union", "q22_top3_month": "top3_per_month", "q23_cte_correlated": "cte_join", "q24_yoy_selfjoin": "yoy_self_join", "q25_dense_hyperbox": "hyperbox4",
}


def main() -> None:
    from cubewright import registry
    from cubewright.session import local_session

    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), partitions=8, app="bench")
    took = {}
    for name, query in HEADLINE.items():
        run = registry.QUERIES[query]
        began = time.perf_counter()
        run(spark, d).collect()
        if name != "q1_bulk_load":
            began = time.perf_counter()
            run(spark, d).collect()
        took[name] = round(time.perf_counter() - began, 4)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": d.rstrip("/").rsplit("/", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
