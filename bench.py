"""Time the headline queries: BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS set the data, cores and repeats.

Prints one JSON line.  Every query runs once to warm up; the median of the following runs
counts.  Results are written to Spark's noop sink, so all rows are computed.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from axonframe.plans import QUERIES  # noqa: E402
from axonframe.session import build_session  # noqa: E402

HEADLINE = [
    "topk_records", "hash_sample", "quantile_sample", "moments", "higher_moments", "normalize_0_10", "unit_scale",
    "token_mean_activation", "run_diff_percentiles", "split_valid", "merge_exact_moments",
    "seq_scores", "pooled_scores", "both_scores", "best_explanation", "linear_calibration", "linear_applied",
    "percentile_applied", "dot_top_positive", "token_weights",
    "corpus_windows", "corpus_windows_stride", "corpus_windows_capped", "corpus_slice", "shard_ranges", "blank_filter",
    "label_rollup", "role_violations_long", "numbered_list_split",
    "explain_prompts", "simulate_prompts", "single_token_prompts", "completion_parse", "response_align",
    "neuron_json_records", "puzzle_json", "events_running_stats", "events_per_minute",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        spent = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - started)
        times[name] = round(statistics.median(spent[1:]), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(scale.group(1)) if scale else None,
    }))


if __name__ == "__main__":
    main()
