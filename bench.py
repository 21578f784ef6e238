"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores, BENCH_QUERIES (optional,
comma separated, or "all") the queries.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from featureforge.catalog import load  # noqa: E402
from featureforge.session import local_session  # noqa: E402

HEADLINE = [
    "entry_corpus_profile", "s2_read_metrics", "s5_read_json_reports", "s6_stream_ingest",
    "x1_last_match", "x3_parse_key_lenient", "x8_pattern_counts", "x10_nesting_depth", "x12_line_predicates",
    "x13_classify_reports", "x14_path_length", "x15_map_rollup", "j1_enrich", "j2_enrich_unique", "j4_join_via",
    "d2_first_per_key", "d3_duplicate_report", "d4_duplicate_rows", "a1_missing_report", "a2_constant_report",
    "a3_outlier_report", "a4_describe", "a6_group_summary", "a8_corr_matrix", "a13_histogram", "a14_box_stats",
    "t1_best_rows", "f1_one_hot", "f4_add_ratios", "f8_fold_standardize", "f9_fold_robust_scale",
    "f11_select_k_best", "v1_split_holdout", "v2_assign_kfold", "v6_fold_summary", "m1_fit_ols", "m2_ridge_by_group",
    "m7_fit_rff", "m9_run_grid", "m9_full_grid",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = os.environ.get("BENCH_QUERIES", "")
    spark = local_session("bench")
    registered = load().QUERIES
    names = list(registered) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    for warm in ("entry_corpus_profile", "m2_fit_ridge"):  # start the JVM code paths and the Python workers
        registered[warm](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(folder).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
