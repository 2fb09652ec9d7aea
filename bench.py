"""Headline timings at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The whole suite first runs once, untimed, on $BENCH_WARMUP_DIR (default sf0.001)
in the same session, so the measured run reflects steady-state execution rather
than JVM class loading and JIT compilation; the warm-up's duration is reported
as ``warmup_sec``; ``spark_jobs`` counts the Spark jobs (AQE stages included)
each step ran. Each timed step forces its full plan with a no-op write:
  build_base          merge, high-NULL drop, dedupe, dtype repair, exact time split,
                      write partitioned by split
  fit_params          every fitted table and scalar on the train split
  enriched_features   apply all 28 features to every split
  v1_matrix           fill + label-encode matrix
  v2_matrix           categorical matrix + validation table
  validate_output     one-pass check table
  eval_report         AUC, AP, sweep, best threshold, confusion counts
  roc_points          ROC curve via bucketed running totals
  eda_key_profile     key cardinality profile (one stacked aggregation)
  stream_features     R1: the same features through Structured Streaming, two streams with keyed
                      dedupe and a stream-stream join over several files (their delivery is not timed)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


JOBS: dict[str, int] = {}


def suite(spark, sf_dir: str) -> tuple[dict, object, int]:
    from riskfold.operators import encode as E
    from riskfold.operators import metrics as M
    from riskfold.operators import validate as V
    from riskfold.plans import catalog
    from riskfold.plans.catalog_prep import RAW
    from riskfold.plans.fixture import fixture
    from riskfold.plans.prep_jobs import prepare_categorical, prepare_indexed
    from riskfold.streaming import apply_stream as stream

    fx = fixture(spark, sf_dir)   # the same state the registered queries use
    times: dict[str, float] = {}
    tracker = spark.sparkContext.statusTracker()

    def n_jobs() -> int:
        return len(tracker.getJobIdsForGroup())

    def run(name, make):
        t0, j0 = time.time(), n_jobs()
        make().write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        JOBS[name] = n_jobs() - j0

    run("build_base", lambda: fx.base)
    t0, j0 = time.time(), n_jobs()
    params = fx.params
    times["fit_params"] = round(time.time() - t0, 3)
    JOBS["fit_params"] = n_jobs() - j0
    run("enriched_features", lambda: fx.enriched)
    run("v1_matrix", lambda: prepare_indexed(fx.base)[0])
    final = E.select_final(fx.enriched, [], RAW)
    run("v2_matrix", lambda: prepare_categorical(final, "all")[2])
    run("validate_output", lambda: V.validate_output(final))
    scores = fx.scores
    run("eval_report", lambda: M.eval_report(scores))
    run("roc_points", lambda: M.roc_points(scores))
    reg = catalog.spark_queries()
    run("eda_key_profile", lambda: reg["eda_key_profile"](spark, sf_dir))
    arrived = stream.deliver(spark, sf_dir)        # the files are there before the clock starts
    run("stream_features", lambda: stream.feature_sink(
        stream.merged_stream(*stream.delivered_streams(spark, *arrived)), fx.base_plan, params).read(spark))
    return times, params, fx.base.count()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from riskfold.session import local_session

    spark = local_session(cpus, "riskfold-bench", memory="16g")
    t0 = time.time()
    if warm_dir and os.path.isdir(warm_dir):
        suite(spark, warm_dir)
    warmup = round(time.time() - t0, 3)
    times, params, n_rows = suite(spark, sf_dir)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_headline_seconds", "value": total, "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
                      "rows": n_rows, "cpus": cpus, "warmup_sec": warmup,
                      "warmup_dir": os.path.basename(warm_dir.rstrip("/")),
                      "spark_jobs": dict(JOBS),
                      "fitted": params.summary()}))
    spark.stop()


if __name__ == "__main__":
    main()
