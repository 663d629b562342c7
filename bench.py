"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is written to the ``noop`` sink (full execution, no output I/O):
one warm-up run, then the median of $BENCH_RUNS runs. Prints ONE JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}

The given files have one row group each, which Spark cannot split; a large
table has many. So the tables are first copied, untimed, into several files
per core in a scratch folder, and the queries read that copy.

Streaming and model queries run once each; training (the five learners on the
requests of sf0.01, i.e. 10,000 rows, the reference's default corpus size) runs
first, unless BENCH_TRAIN=0. Their times are listed but not part of the total.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "featurize_all",            # 144 features over every request
    "featurize_documents",      # 144 features over every document (long texts)
    "attack_patterns",          # 44 rules + matched ids
    "url_worst_param",          # parameters scored and reduced inside the row
    "screen_verdicts",          # full screening, all routes
    "screen_status_counts",     # flagship
    "triage_status",
    "export_csv_rows",
    "stats_last_n_days",
    "daily_statistics",
    "recent_logs",
    "feedback_join",
    "feedback_corpus",
    "model_metrics",
    "seed_summary",
    "scaler_stats",
    "stratified_split",
    "augment_corpus",
    "screen_duplicates",        # repeated and NULL keys, three rows per request
    "log_roundtrip",            # screen, append by day, read back pruned
]

#: Run once, from the given files; not part of the total.
ONCE = ["stream_screen", "stream_daily", "screen_with_model"]
TRAIN_ORDER = ["LogisticRegression", "RandomForest", "SVM_rff", "GradientBoosting", "XGBoost_gbt"]
SPLIT_TABLES = ["events", "documents", "pages", "conversations"]


def split_copy(spark, sf_dir: str, files: int) -> str:
    """A copy of the tables in ``files`` files each."""
    out = tempfile.mkdtemp(prefix="bench-", dir="/tmp")
    for t in SPLIT_TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").repartition(files).write.parquet(f"{out}/{t}.parquet")
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    train = os.environ.get("BENCH_TRAIN", "1") == "1"
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from sievekit.plans.catalog import QUERIES
    from sievekit.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2)
    extra = {}
    if train and not only:
        from sievekit.plans import ml
        from sievekit.sources import tables as T
        train_dir = re.sub(r"sf[0-9.]+/?$", "sf0.01", sf_dir.rstrip("/"))
        corpus = T.requests(spark, train_dir).select("request_id", "query", "label")
        for name in sorted(ml.LEARNERS, key=TRAIN_ORDER.index):
            t0 = time.perf_counter()
            ml.train_evaluate(spark, corpus, "request_id", learners=[name])
            extra[f"train_{name}"] = round(time.perf_counter() - t0, 3)
            print(f"# train_{name}: {extra[f'train_{name}']}s", file=sys.stderr, flush=True)
        extra["train_5_learners_10k"] = round(sum(extra.values()), 3)
    timings: dict[str, float] = {}
    copy = split_copy(spark, sf_dir, 2 * int(cpus))
    for name in only or HEADLINE:
        fn = QUERIES[name]
        samples = []
        for i in range(runs + 1):
            t0 = time.perf_counter()
            fn(spark, copy).write.format("noop").mode("overwrite").save()
            if i > 0:  # first run is the warm-up
                samples.append(time.perf_counter() - t0)
        timings[name] = round(statistics.median(samples), 3)
        print(f"# {name}: {timings[name]}s", file=sys.stderr, flush=True)

    for name in [] if only else ONCE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        extra[name] = round(time.perf_counter() - t0, 3)

    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total_median_sec",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": {**timings, **extra},
        "sf": float(sf.group(1)) if sf else sf_dir,
        "cpus": int(cpus),
        "runs": runs,
        "driver_memory": spark.conf.get("spark.driver.memory", "default"),
    }))


if __name__ == "__main__":
    main()
