"""Job functions: O3 feature pipeline, O6/O8 training + evaluation, O9
end-to-end runs with a stage-timing table. Paths are arguments; every
intermediate is Parquet/JSON written by Spark."""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import (ALL_ENGINEERED_FEATURES, OPTIONAL_INPUTS, REQUIRED_INPUTS, TARGET,
                      FeatureConfig)
from ..operators import encode as E
from ..operators import metrics as M
from ..operators import ml
from ..operators import target_encode as TE
from ..operators import validate as V
from ..session import materialize
from ..sources import io
from . import features_job as fj
from .prep_jobs import prepare_categorical, prepare_indexed


class StageTimer:
    """Stage timings of a job run (O9); ``table`` returns them as a DataFrame."""

    def __init__(self, spark: SparkSession):
        self.spark, self.rows = spark, []

    def run(self, name: str, fn, *a, **kw):
        t0 = time.time()
        try:
            out = fn(*a, **kw)
        except Exception:
            self.rows.append((name, round(time.time() - t0, 3), "failed"))
            raise
        self.rows.append((name, round(time.time() - t0, 3), "ok"))
        return out

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, "stage string, seconds double, status string")


def run_feature_pipeline(spark: SparkSession, base_path: str, out_path: str, params_path: str,
                         cfg: FeatureConfig = FeatureConfig(), top_features_path: str | None = None,
                         target: str = TARGET) -> dict:
    """O3: load splits -> check inputs -> fit on train, apply to all ->
    select final columns -> write them once, validate what was written and only
    then publish it with its manifest -> save parameters."""
    base = io.read_splits(spark, base_path)
    absent = V.require_columns(base, REQUIRED_INPUTS + [target], OPTIONAL_INPUTS)
    params = fj.fit(base, cfg)
    enriched = fj.apply(base, params)
    fj.verify_features_added(enriched)
    top = io.load_top_features(spark, top_features_path) if top_features_path else []
    raw = [c for c in base.columns if c not in (target, "split")]
    final = E.select_final(enriched, top, raw, ALL_ENGINEERED_FEATURES, target)
    exempt = [f for f, src in (("device_txn_count", "DeviceInfo"), ("addr_is_unique", "addr1"),
                               ("card_device_is_high", "DeviceInfo"),
                               ("uid_fraud_rate", "addr1")) if src in absent]
    manifest = io.publish_splits(final, out_path, lambda rows: V.validate_output(rows, exempt_all_null=exempt),
                                 target=target)
    summary = {r["param_table"]: r["n_entries"] for r in io.save_params(params, params_path)
               .collect()}
    return {"manifest": manifest, "params": summary, "absent_optional": absent}


def run_v2(spark: SparkSession, enriched_path: str, out_dir: str, mode: str = "all",
           trials: int = 50, search_iter: int = 500, final_iter: int = 5000,
           timer: StageTimer | None = None, top_features_path: str | None = None,
           patience: int = 100, wide_values: int = TE.WIDE_VALUES, parallelism: int = 4) -> DataFrame:
    """O5 + O6 + O7: categorical matrix, seeded search on val AUC, final fit
    stopped by the val AUC, val scoring, report, importances, model. Text columns
    of more than ``wide_values`` training values enter search and training as
    out-of-fold target rates, saved beside the model for later rows. Mode "top50"
    takes its raw columns from the document at ``top_features_path`` (V1 writes
    one); each mode has its own matrix folder. Returns the report row."""
    t = timer or StageTimer(spark)
    top = None
    if mode == "top50":
        top = io.load_top_features(spark, top_features_path) if top_features_path else None
        if not top:
            raise FileNotFoundError(f"mode 'top50' needs a top-feature document, none at {top_features_path}")
    enriched = io.read_published(spark, enriched_path)
    mat, cats, _ = t.run("prep", prepare_categorical, enriched, mode, top)
    names = [c for c in mat.columns if c not in (TARGET, "split")]
    matrix_path = os.path.join(out_dir, f"matrix_{mode}")
    t.run("save_matrix", io.publish_splits, mat, matrix_path,
          lambda rows: V.validate_ready(rows, cats, E.numeric_columns(rows, (TARGET,)), TARGET), mode)
    mat = io.read_published(spark, matrix_path).select("split", *names, TARGET)
    io.save_cat_features(spark, cats, os.path.join(out_dir, "cat_features"), mode=mode)
    key = ["TransactionID"] if "TransactionID" in names else names
    mat, narrow, encoding = t.run("encode", TE.encode_wide, mat, cats, key, TARGET, wide_values)
    if encoding:
        io.save_target_encoding(encoding, os.path.join(out_dir, "target_encoding"))
        mat = materialize(mat, "encoded-matrix")
    numeric = E.numeric_columns(mat, (TARGET,))
    labelled = mat.where(F.col("split").isin("train", "val"))
    best, trial_df = t.run("search", ml.random_search, labelled, numeric, narrow, trials,
                           42, search_iter, parallelism=parallelism)
    trial_df.write.mode("overwrite").parquet(os.path.join(out_dir, "trials"))
    best = {k: v for k, v in best.items() if k != "max_iter"}
    trained = t.run("train", ml.train_staged, labelled, numeric, narrow, patience=patience, metric="auc_roc",
                    max_iter=final_iter, **best)
    io.write_json_doc(spark, os.path.join(out_dir, "best_params"), dict(best, iterations=trained.iterations))
    io.write_report(trained.curve, os.path.join(out_dir, "curve"))
    model = trained.model
    io.save_model(model, os.path.join(out_dir, "model"))
    model = io.load_model(os.path.join(out_dir, "model"))   # evaluate the saved model
    scores = ml.score(model, mat.where(F.col("split") == "val"))
    report = t.run("evaluate", M.eval_report, scores)
    io.write_report(report, os.path.join(out_dir, "eval_report"))
    io.write_report(M.threshold_sweep(scores), os.path.join(out_dir, "threshold_sweep"))
    io.write_report(ml.importance_table(model, 40), os.path.join(out_dir, "importance_top40"))
    return report


def run_v1(spark: SparkSession, base_path: str, out_dir: str, max_iter: int = 1000,
           rank_top: int = 50, timer: StageTimer | None = None, patience: int = 50) -> DataFrame:
    """O4 + O8: indexed matrix, weighted GBT stopped by the val AP, test scoring,
    AUC/AP/PR curve, permutation ranking of all features: the full table, and the
    names of the best ``rank_top`` as ``top_features.json`` for V2's mode "top50"."""
    t = timer or StageTimer(spark)
    base = io.read_splits(spark, base_path)
    mat, codes = t.run("prep", prepare_indexed, base, keep_id=True)
    feats = [c for c in E.split_xy(mat)[0] if c != "TransactionID"]
    trained = t.run("train", ml.train_staged, mat, feats, patience=patience, max_iter=max_iter)
    model = trained.model
    io.write_report(trained.curve, os.path.join(out_dir, "curve"))
    io.save_model(model, os.path.join(out_dir, "model"))
    test = mat.where(F.col("split") == "test")
    scores = ml.score(model, test)
    metrics = t.run("evaluate", lambda: M.auc_roc(scores).first()[0])
    ap = M.average_precision(scores).first()[0]
    io.write_report(M.pr_points(scores), os.path.join(out_dir, "pr_curve"))
    tested = trained.matrix.where(F.col("split") == "test")
    ranking = t.run("rank", ml.permutation_importance, model, tested, feats)
    ranking.write.mode("overwrite").option("header", True).csv(os.path.join(out_dir, "ranking"))
    top = [r["feature"] for r in ranking.limit(rank_top).collect()]
    io.write_json_doc(spark, os.path.join(out_dir, "top_features.json"), {"top_features": top})
    return spark.createDataFrame([(metrics, ap)], "auc_roc double, average_precision double")


def run_end_to_end(spark: SparkSession, version: str, **kw) -> DataFrame:
    """One run with stage timings; stops at the first failing stage."""
    timer = StageTimer(spark)
    if version == "v1":
        run_v1(spark, timer=timer, **kw)
    elif version == "v2":
        run_v2(spark, timer=timer, **kw)
    else:
        raise ValueError(f"version must be 'v1' or 'v2', got {version!r}")
    return timer.table()
