"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default sf0.1), ``BENCH_CPUS`` (default all), ``BENCH_RUNS`` (default 1 after
one warm-up run). Every query is run to the end into a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import statistics
import time

HEADLINE = (
    "corpus_splits", "dedupe_exact", "duplicate_report", "normalize_text", "strip_leaked_labels", "html_to_text",
    "fold_text", "tokenize", "term_signals", "majority_domain", "label_counts", "quality_report", "split_overlap",
    "balanced_selection", "cap_synthetic", "repair_support", "stratified_split", "generate_balanced", "corpus_build",
    "token_freq", "build_vocab", "encode", "metrics_by_source", "confusion",
    "bias_calibration", "decode_logits", "average_views", "reply_status", "calibrate_labels", "history_window",
    "prompt_messages", "assemble_responses", "stream_assemble", "supersede", "early_stop",
)


def main() -> None:
    from lectern.plans.session import local_session
    from lectern.workloads import all_queries

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cpus)
    registered = all_queries()
    times: dict[str, float] = {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            registered[name](spark, sf).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
