"""Headline queries, timed.  Prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all), BENCH_RUNS (default 3),
BENCH_QUERIES (comma list; default the headline list), BENCH_SHARED (folder for stage files; default a new one).  Each query is warmed up once, then the median is taken.  What the pipeline
writes between its programs (converted tables, samples, vocabulary, sequences) is built once and timed on its own as ``stage_*``.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

HEADLINE = [
    "agg_cycles_by_class", "agg_cycles_joint", "win_sessionize", "join_asof_lookback", "win_first_event", "first_echo_event",
    "join_exists_range", "agg_last_observation", "cohort_pan_cancer_ctrcd", "cohort_uniform_365", "cohort_main_v2", "cohort_1yr_master",
    "agg_label_breakdown", "agg_group_quartiles", "seq_events", "seq_vocab", "seq_window", "seq_visit_delims", "split_patients",
    "feat_bow", "feat_clinical", "eval_auroc", "eval_auprc", "eval_threshold_sweep", "eval_seed_summary", "attr_population",
    "attr_feature_by_cycle",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from pyspark.sql import SparkSession

    from chronocohort.plans.queries import REGISTRY, runnable
    from chronocohort.plans.workspace import workspace
    from chronocohort.sources.schemas import BY_NAME

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.checkpoint.dir", os.environ.get("BENCH_SHARED") or tempfile.mkdtemp(prefix="bench-shared-"))
             .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    ws = workspace(spark, folder)
    start = time.time()
    for table in BY_NAME:
        ws.clinical(table)
    times["stage_tables"] = round(time.time() - start, 3)
    for stage in ("cohort_table", "samples", "timeline", "vocab", "past", "sequences"):
        start = time.time()
        getattr(ws, stage)
        times[f"stage_{stage}"] = round(time.time() - start, 3)
    for name in names:
        query = runnable(REGISTRY[name])
        run(query(spark, folder))
        taken = []
        for _ in range(runs):
            start = time.time()
            run(query(spark, folder))
            taken.append(time.time() - start)
        times[name] = round(statistics.median(taken), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), "runs": runs}))


if __name__ == "__main__":
    main()
