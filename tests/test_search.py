"""The search's trials run to patience; rankings of packed scores."""

import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from riskfold.operators import metrics as M
from riskfold.operators import ml, prefix


def _rows(spark, n=500):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=n), rng.normal(size=n)
    y = (rng.random(n) < 1 / (1 + np.exp(-2 * a - b))).astype(int)
    return spark.createDataFrame([(i, float(a[i]), float(b[i]), int(y[i]), "train" if i % 3 else "val")
                                  for i in range(n)], "TransactionID long, a double, b double, isFraud int, split string")


def test_trials_run_to_patience(spark, monkeypatch):
    """F8: every trial's curve ends at the bound or ``patience`` iterations after its
    best, on the AUC, and the trial's score is the curve's best."""
    curves, inner = [], ml.fit_to_patience
    monkeypatch.setattr(ml, "fit_to_patience", lambda *a, **kw: curves.append(inner(*a, **kw)) or curves[-1])
    best, trials = ml.random_search(_rows(spark), ["a", "b"], trials=3, max_iter=20, patience=4, parallelism=1)
    aucs = [r["val_auc"] for r in trials.orderBy("trial").collect()]
    assert len(curves) == 3 and best["max_iter"] == 20
    for (model, k, curve, value), auc in zip(curves, aucs):
        points = [(r["iteration"], r["auc_roc"]) for r in curve.orderBy("iteration").collect()]
        assert [i for i, _ in points] == list(range(1, len(points) + 1)) and len(points) == len(model.treeWeights)
        assert len(points) == 20 or len(points) - k >= 4
        assert auc == value == points[k - 1][1] == max(v for _, v in points[:k + 4])


def test_search_keeps_learning_with_small_steps(spark):
    """F8: a step of 1e-3 hardly moves the loss; Spark's own stop ended it after a tree."""
    rows = ml.assemble(_rows(spark), ["a", "b"])[1]
    train, val = rows.where("split = 'train'"), rows.where("split = 'val'")
    p = dict(depth=3, step=1e-3, subsample=0.8, min_info_gain=0.0, max_bins=32)
    model, best, curve, value = ml.fit_to_patience(train, val, 6, "auc_roc", 40, **p)
    assert len(model.treeWeights) >= 12 and best > 1 and value > curve.where("iteration = 1").first()["auc_roc"]


def test_search_without_val_rows(spark):
    best, trials = ml.random_search(_rows(spark, 90).where("split = 'train'"), ["a", "b"], trials=2, max_iter=3, patience=1)
    assert [r["val_auc"] for r in trials.collect()] == [None, None]


@pytest.mark.parametrize("block, ranges", [(4_000_000, 1), (600, 1), (600, 5)])
def test_packed_ranking_is_grouped_ranking(spark, monkeypatch, block, ranges):
    monkeypatch.setattr(M, "BLOCK_VALUES", block)
    rng = np.random.default_rng(9)
    rows = [(int(v), [float(x) for x in np.round(rng.random(3) * (0.5 + v), 2)]) for v in rng.integers(0, 2, 700)]
    rows += [(None, [0.5, 0.5, 0.5]), (1, None), (0, [float("nan"), 0.1, float("nan")]), (1, [-0.0, 0.0, 0.3])]
    df = spark.createDataFrame(rows, "y int, p array<double>").repartition(3)
    got = {r["g"]: r for r in M.packed_ranking(df, "g", [4, 5, 9], ranges, df.sample(0.3, seed=2)).collect()}
    flat = df.selectExpr("y", "explode(map_from_arrays(array(4, 5, 9), p)) AS (g, p)")
    want = {r["g"]: r for r in M.grouped_ranking(flat, "g").collect()}
    assert set(got) == set(want) == {4, 5, 9}
    for g, r in want.items():
        assert got[g]["auc_roc"] == r["auc_roc"] and got[g]["average_precision"] == pytest.approx(r["average_precision"], rel=1e-12)


def test_curve_over_several_ranges(spark, monkeypatch):
    """The sample cuts ranges only: the same curve from one range and from many."""
    df, curves = _rows(spark), []
    for rows in (1_000_000, 30):
        monkeypatch.setattr(prefix, "RANGE_ROWS", rows)
        got = ml.train_staged(df, ["a", "b"], patience=3, max_iter=6, depth=3)
        curves.append([(r["iteration"], r["auc_roc"], round(r["average_precision"], 12)) for r in got.curve.orderBy("iteration").collect()])
    assert curves[0] == curves[1] and len(curves[0]) == 6


def test_ranking_functions_need_no_package_on_workers(tmp_path):
    """a worker without this repository on its path can load and run them."""
    sent = cloudpickle.dumps((M._range_terms(), M._score_blocks([1], np.empty((1, 0)))))
    code = "import sys; from pyspark import cloudpickle; print(len(cloudpickle.loads(sys.stdin.buffer.read())))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code], input=sent, capture_output=True, cwd=tmp_path, env=env)
    assert got.stdout.strip() == b"2", got.stderr
