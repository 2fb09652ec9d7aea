"""Stopping with patience, staged margins, grouped ranking metrics, permutations."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskfold.operators import metrics as M
from riskfold.operators import ml, prefix


def brute_ranking(y, p):
    y, p = np.asarray(y), np.asarray(p, float)
    pos, neg = p[y == 1], p[y == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    ap, before = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        recall = (pos >= t).sum() / len(pos)
        ap += (recall - before) * (pos >= t).sum() / (p >= t).sum()
        before = recall
    return auc, ap


def test_stop_iteration():
    assert ml.stop_iteration([(1, .5), (2, .6), (3, .6), (4, .55)], 2) == (2, True)
    assert ml.stop_iteration([(1, .5), (2, .6), (3, .59), (4, .7)], 2) == (4, False)
    assert ml.stop_iteration([(1, None), (2, None)], 5) == (2, False)


@pytest.mark.parametrize("rows_a_range", [1_000_000, 40])
def test_grouped_ranking_against_brute_force(spark, monkeypatch, rows_a_range):
    monkeypatch.setattr(prefix, "RANGE_ROWS", rows_a_range)      # one group over many ranges
    rng = np.random.default_rng(4)
    rows = [(k, int(y), float(p)) for k in (1, 2, 7) for y, p in
            zip(rng.integers(0, 2, 400), np.round(rng.random(400) * (0.2 + k), 2))]
    extra = [(1, None, 0.5), (1, 1, None), (2, 0, float("nan")), (9, 1, 0.5), (None, 1, 0.1)]
    got = {r["g"]: r for r in M.grouped_ranking(spark.createDataFrame(rows + extra, "g int, y int, p double"), "g").collect()}
    for k in (1, 2, 7):
        mine = [r for r in rows if r[0] == k]
        auc, ap = brute_ranking([r[1] for r in mine], [r[2] for r in mine])
        assert got[k]["auc_roc"] == pytest.approx(auc) and got[k]["average_precision"] == pytest.approx(ap)
    assert set(got) == {1, 2, 7, 9} and got[9]["auc_roc"] is None


@pytest.fixture(scope="module")
def trained(spark):
    rng = np.random.default_rng(2)
    n = 900
    a, b, c = rng.normal(size=n), rng.integers(0, 4, n), rng.choice(["x", "y", "z"], n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(a + (b == 2) - (c == "x"))))).astype(int)
    rows = [(i, float(a[i]), int(b[i]), str(c[i]), int(y[i]), "train" if i < 500 else "val" if i < 750 else "test")
            for i in range(n)]
    df = spark.createDataFrame(rows, "TransactionID long, a double, b int, c string, isFraud int, split string")
    return ml.train_staged(df, ["a", "b"], ["c"], patience=4, metric="auc_roc", max_iter=24, depth=3)


def test_trained_model_has_the_best_number_of_trees(trained):
    curve = [(r["iteration"], r["auc_roc"]) for r in trained.curve.orderBy("iteration").collect()]
    best, _ = ml.stop_iteration(curve, 4)
    assert 1 < best == trained.iterations == len(trained.model.stages[-1].treeWeights)
    assert curve[best - 1][1] == max(v for _, v in curve[:best])


def test_staged_margins_are_the_model(trained):
    gbt = trained.model.stages[-1]
    val = trained.matrix.where(F.col("split") == "val")
    last = {r["id"]: r["margin"] for r in ml.staged_margins(gbt, val, ["id"], every=100).collect()}
    want = {r["id"]: r["m"] for r in gbt.transform(val).select("id", vector_to_array("rawPrediction")[1].alias("m")).collect()}
    assert last == pytest.approx(want)


def test_shorter_fit_is_a_prefix(trained):
    """A fit of n trees holds the fit of fewer: the refit to the best number rests on it."""
    train = trained.matrix.where(F.col("split") == "train")
    long, short = (ml.gbt(n, label="y", stop_on_loss=False, depth=3, max_bins=32).fit(train) for n in (6, 3))
    assert [t.toDebugString.split("\n", 1)[1] for t in long.trees[:3]] == [t.toDebugString.split("\n", 1)[1] for t in short.trees]


def test_permutation_is_one_and_repeats(spark, trained):
    test = trained.matrix.where(F.col("split") == "test")
    rows = test.select("id", "features")
    one = sorted(map(tuple, ml.permuted_values(rows).collect()))
    assert one == sorted(map(tuple, ml.permuted_values(rows.repartition(5)).collect()))
    values = {(r["id"], k): v for r in rows.collect() for k, v in enumerate(r["features"].toArray())}
    assert len(one) == len(values) == 450
    for k in range(3):
        assert sorted(v for _, f, v in one if f == k) == sorted(v for (_, f), v in values.items() if f == k)
    assert sum(values[i, f] != v for i, f, v in one) > 150
    ranked = ml.permutation_importance(trained.model, test, ["a", "b", "c"]).collect()
    assert {r["feature"] for r in ranked} == {"a", "b", "c"} and ranked[0]["feature"] == "a" and ranked[0]["auc_drop"] > 0


def test_model_is_cut_from_the_last_fit(spark, monkeypatch):
    """No fit after the stop is found, and no point of the curve twice."""
    rng = np.random.default_rng(5)
    rows = [(i, float(x), int(rng.random() < 1 / (1 + np.exp(-x))), "train" if i % 3 else "val")
            for i, x in enumerate(rng.normal(size=600))]
    df = spark.createDataFrame(rows, "TransactionID long, a double, isFraud int, split string")
    fits, after = [], []
    gbt, staged = ml.gbt, ml.staged_margins
    monkeypatch.setattr(ml, "gbt", lambda n, **kw: fits.append(n) or gbt(n, **kw))
    monkeypatch.setattr(ml, "staged_margins", lambda *a, **kw: after.append(kw.get("after", 0)) or staged(*a, **kw))
    monkeypatch.setattr(ml, "stop_iteration", lambda curve, patience: (3, len(curve) >= 4))
    got = ml.train_staged(df, ["a"], patience=1, max_iter=8, depth=2)
    assert fits == [2, 4] and after == [0, 2] and got.iterations == 3
    assert [r["iteration"] for r in got.curve.orderBy("iteration").collect()] == [1, 2, 3, 4]
    model = got.model.stages[-1]
    train = got.matrix.where("split = 'train'")
    again = gbt(3, label="y", stop_on_loss=False, depth=2).fit(train)
    assert model.treeWeights == again.treeWeights and model.numFeatures == again.numFeatures
    assert model.featureImportances == again.featureImportances
    by = lambda m: {r["id"]: r["probability"] for r in m.transform(got.matrix).select("id", "probability").collect()}
    assert by(model) == by(again)
