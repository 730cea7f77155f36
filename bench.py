"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default sf0.1) and ``BENCH_CPUS`` (default 8) set data and cores,
``BENCH_QUERIES`` a list of names in place of the headline ones. The model queries come last
and are ended after ``BENCH_LIMIT`` seconds each (default 240); those that don't finish are
listed under ``unfinished`` and are no part of the total.
"""

from __future__ import annotations

import json
import os
import sys
import threading
import time

HEADLINE = [
    "traces_long", "traces_pivot", "outer_merge_nullsafe", "task_vocab_zero_fill",
    "dedup_first_defined", "null_count_filter", "mark_normalise", "standardise",
    "step_lag_windows", "horizon_target", "residual_halo_window", "min_width_beta",
    "risk_label_rate", "quantile_label", "exact_group_quantile", "stratified_split",
    "mondrian_sets_fallback", "metrics_grouping_sets", "nearest_centroid_reassign",
    "hamming_knn", "hamming_knn_wide", "weighted_residual_quantile", "kmeans_min_size",
    "pca_step_embedding",
]
MODELS = ["horizon_classifier", "score_and_project", "sequential_interval_two", "gate_train"]


def timed(spark, run, limit: float | None) -> float | None:
    """Seconds that ``run`` takes; None if it is ended at the limit."""
    failed: list[BaseException] = []

    def work() -> None:
        try:
            run()
        except BaseException as e:  # noqa: BLE001  raised again below
            failed.append(e)

    start = time.perf_counter()
    thread = threading.Thread(target=work, daemon=True)
    thread.start()
    thread.join(limit)
    late = thread.is_alive()
    while thread.is_alive():  # fits that wait their turn start anew jobs
        spark.sparkContext.cancelAllJobs()
        thread.join(1)
    if late:
        return None
    if failed:
        raise failed[0]
    return round(time.perf_counter() - start, 3)


def main() -> None:
    from cohortlens.plans.catalogue import QUERIES
    from cohortlens.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    limit = float(os.environ.get("BENCH_LIMIT", "240"))
    picked = os.environ.get("BENCH_QUERIES")
    names = picked.split(",") if picked else HEADLINE + MODELS
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["distinct_hist"](spark, sf_dir).collect()  # start-up is not a query
    times, unfinished = {}, {}
    try:
        for name in names:
            def run(query=QUERIES[name]):
                query(spark, sf_dir).write.format("noop").mode("overwrite").save()

            took = timed(spark, run, limit if name in MODELS else None)
            if took is None:
                unfinished[name] = limit
            else:
                times[name] = took
            print(name, took, file=sys.stderr, flush=True)
    except KeyboardInterrupt:  # the time of the whole run is up: what there is counts
        unfinished |= dict.fromkeys((n for n in names if n not in times and n not in unfinished), 0)
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "unfinished": unfinished, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }), flush=True)
    os._exit(0)


if __name__ == "__main__":
    main()
