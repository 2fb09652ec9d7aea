"""Composed jobs on the sf0.001 fixture (small iteration counts)."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from riskfold.config import FIXTURE_FEATURES
from riskfold.plans import jobs
from riskfold.plans.fixture import Fixture
from riskfold.sources import io

SMOKE = "/root/testdata/sf0.001"


def test_feature_pipeline_and_v2(spark):
    fx = Fixture(spark, SMOKE)
    d = tempfile.mkdtemp(prefix="riskfold-jobs-")
    base_path = os.path.join(d, "base")
    fx.base.write.partitionBy("split").parquet(base_path)
    out = jobs.run_feature_pipeline(spark, base_path, os.path.join(d, "enriched"),
                                    os.path.join(d, "params"), FIXTURE_FEATURES)
    assert out["manifest"]["splits"]["test"]["cols"] == out["manifest"]["splits"]["train"]["cols"] - 1
    assert out["params"]["card"] > 0
    enriched = io.read_published(spark, os.path.join(d, "enriched"))
    assert enriched.where(F.col("split") == "test").where(F.col("isFraud").isNotNull()).count() == 0
    p = io.load_params(spark, os.path.join(d, "params"), FIXTURE_FEATURES)
    assert p.median_amt == fx.params.median_amt
    timings = jobs.run_end_to_end(spark, "v2", enriched_path=os.path.join(d, "enriched"),
                                  out_dir=os.path.join(d, "v2"), trials=1, search_iter=3,
                                  final_iter=6, patience=2)
    stages = [r["stage"] for r in timings.collect()]
    assert stages[:2] == ["prep", "save_matrix"] and "evaluate" in stages
    rep = spark.read.json(os.path.join(d, "v2", "eval_report")).first()
    assert rep["val_rows"] == enriched.where(F.col("split") == "val").count()
    assert io.load_cat_features(spark, os.path.join(d, "v2", "cat_features")) == \
        ["DeviceInfo", "P_emaildomain", "id_16"]
    best = io.read_json_doc(spark, os.path.join(d, "v2", "best_params"))
    model = io.load_model(os.path.join(d, "v2", "model"))
    assert best["iterations"] == len(model.stages[-1].treeWeights) and {"depth", "step"} <= set(best)
    # mode top50: the list comes from a document, a missing one is an error, the folder is its own
    with pytest.raises(FileNotFoundError):
        jobs.run_v2(spark, os.path.join(d, "enriched"), os.path.join(d, "v2"), mode="top50",
                    top_features_path=os.path.join(d, "none.json"))
    top = os.path.join(d, "top.json")
    io.write_json_doc(spark, top, {"top_features": ["card1", "k", "amt_log"]})
    jobs.run_v2(spark, os.path.join(d, "enriched"), os.path.join(d, "v2"), mode="top50", trials=1, search_iter=2,
                final_iter=4, patience=2, top_features_path=top)
    columns = io.live_version(spark, os.path.join(d, "v2", "matrix_top50"))["columns"]
    assert {"card1", "k", "amt_is_high"} <= set(columns) and "TransactionID" not in columns
    assert "TransactionID" in io.live_version(spark, os.path.join(d, "v2", "matrix_all"))["columns"]


def test_v1(spark):
    fx = Fixture(spark, SMOKE)
    d = tempfile.mkdtemp(prefix="riskfold-jobs-")
    base_path = os.path.join(d, "base")
    fx.base.write.partitionBy("split").parquet(base_path)
    timings = jobs.run_end_to_end(spark, "v1", base_path=base_path, out_dir=os.path.join(d, "v1"),
                                  max_iter=8, rank_top=2, patience=3)
    assert [r["status"] for r in timings.collect()] == ["ok"] * 4
    ranking = spark.read.option("header", True).csv(os.path.join(d, "v1", "ranking"))
    features = [c for c in fx.base.columns if c not in ("TransactionID", "isFraud", "split")]
    assert sorted(r["feature"] for r in ranking.collect()) == sorted(features)      # all of them
    assert len(io.load_top_features(spark, os.path.join(d, "v1", "top_features.json"))) == 2
    curve = spark.read.json(os.path.join(d, "v1", "curve"))
    assert curve.count() >= 4                                                      # more than one tree was tried


def test_queries_train_and_rank_whole(spark, monkeypatch):
    """No column, feature, iteration or trial is left out of the registered queries."""
    from riskfold.operators import encode as E
    from riskfold.operators import ml
    from riskfold.plans import catalog_ml as C

    calls = {}

    def train(df, numeric, cats=(), **kw):
        calls.update(df=df, feats=[*numeric, *cats], kw=kw)
        return ml.Trained(None, None, df, 1)
    monkeypatch.setattr(C, "_MODELS", {})
    monkeypatch.setattr(ml, "train_staged", train)
    monkeypatch.setattr(ml, "permutation_importance", lambda model, df, feats, **kw: feats)
    monkeypatch.setattr(ml, "random_search", lambda df, numeric, cats, **kw: (None, (sorted([*numeric, *cats]), kw)))
    ranked = C._ranking(spark, SMOKE)
    assert sorted(ranked) == sorted(set(calls["df"].columns) - {"TransactionID", "isFraud", "split"})
    assert not E.string_columns(calls["df"].select(*ranked)) and "P_emaildomain" in ranked
    assert calls["kw"] == {"max_iter": 1000, "patience": 50}
    searched, kw = C._search(spark, SMOKE)
    assert kw == {} and "P_emaildomain" in searched
    C._v2_model(spark, SMOKE)
    assert searched == sorted(calls["feats"])                                      # the trained columns
    assert calls["kw"] == {"max_iter": 5000, "patience": 100, "metric": "auc_roc"}
