"""Out-of-fold target rates against brute force; wide columns in search and training."""

import hashlib
import os
import tempfile

import numpy as np
import pytest

from riskfold.operators import ml
from riskfold.operators import target_encode as TE
from riskfold.sources import io

SCHEMA = "TransactionID long, split string, a string, b long, isFraud int"


def brute(rows, col, folds=TE.FOLDS, m=TE.SMOOTHING):
    fold = {r[0]: int(hashlib.md5(str(r[0]).encode()).hexdigest()[:8], 16) % folds for r in rows}
    fitted = [r for r in rows if r[1] == "train" and r[4] is not None]
    out = {}
    for r in rows:
        use = [x for x in fitted if r[1] != "train" or fold[x[0]] != fold[r[0]]]
        prior = sum(x[4] for x in use) / len(use)
        same = [x for x in use if x[col] == r[col]]
        out[r[0]] = (sum(x[4] for x in same) + m * prior) / (len(same) + m)
    return out


def made(n=600, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(i, str(rng.choice(["train", "train", "val", "test"])), str(rng.choice(["x", "x", "x", "y", "z"])),
             int(rng.integers(0, 40)), int(rng.random() < 0.3)) for i in range(n)]
    rows = [(*r[:2], None if i % 17 == 0 else r[2], None if i % 23 == 0 else r[3], None if i % 29 == 0 else r[4])
            for i, r in enumerate(rows)]
    return rows + [(n, "val", "never seen", -1, 1), (n + 1, "train", "once", 99, 1)]


@pytest.mark.parametrize("limit", [TE.BROADCAST_BYTES, -1])
def test_rates_against_brute_force(spark, limit):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA)
    enc = TE.fit_target_encoding(df, ["a", "b"], ["TransactionID"])
    path = os.path.join(tempfile.mkdtemp(prefix="run-"), "enc")
    io.save_target_encoding(enc, path)
    got = {r["TransactionID"]: r for r in
           io.load_target_encoding(spark, path).apply(df, broadcast_limit=limit).collect()}
    assert len(got) == len(rows)
    for name, col in (("a", 2), ("b", 3)):
        want = brute(rows, col)
        assert all(got[i][name + TE.SUFFIX] == pytest.approx(want[i]) for i in want)


def test_a_label_never_reaches_its_own_fold(spark):
    rows = [r for r in made() if r[1] == "train"]
    flipped = [(*r[:4], 1 - r[4]) if r[0] == rows[3][0] else r for r in rows]
    rates = []
    for data in (rows, flipped):
        df = spark.createDataFrame(data, SCHEMA)
        rates.append({r[0]: r[1] for r in TE.fit_target_encoding(df, ["a"], ["TransactionID"]).apply(df)
                      .select("TransactionID", "a" + TE.SUFFIX).collect()})
    assert rates[0][rows[3][0]] == rates[1][rows[3][0]] and rates[0] != rates[1]


def test_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "train", "x", 1, None), (2, "val", "x", 1, None)], SCHEMA)
    out = TE.fit_target_encoding(df, ["a"], ["TransactionID"]).apply(df)
    assert [r["a" + TE.SUFFIX] for r in out.collect()] == [None, None]
    none = df.limit(0)
    assert TE.fit_target_encoding(none, ["a"], ["TransactionID"]).apply(none).count() == 0


def test_search_and_training_with_a_wide_column(spark):
    rng = np.random.default_rng(8)
    n = 6000
    risk = rng.random(3000)                                   # 3,000 values, more than any bin count in the search
    v, c, x = rng.integers(0, 3000, n), rng.choice(["p", "q", "r"], n), rng.normal(size=n)
    y = (rng.random(n) < 0.1 + 0.6 * (risk[v] > 0.7) * (c != "p")).astype(int)
    df = spark.createDataFrame([(i, "train" if i < 4500 else "val", f"v{v[i]}", str(c[i]), float(x[i]), int(y[i]))
                                for i in range(n)], "TransactionID long, split string, wide string, few string, x double, isFraud int")
    mat, cats, enc = TE.encode_wide(df, ["wide", "few"], ["TransactionID"])
    assert cats == ["few"] and enc.columns == ["wide"] and "wide" not in mat.columns
    numeric = ["x", "wide" + TE.SUFFIX]
    best, trials = ml.random_search(mat, numeric, cats, trials=3, max_iter=4, parallelism=3)
    again, trials2 = ml.random_search(mat, numeric, cats, trials=3, max_iter=4, parallelism=1)
    assert trials.collect() == trials2.collect() and best == again
    assert trials.count() == 3 and trials.where("val_auc > 0.5").count() == 3
    best = {k: v for k, v in best.items() if k != "max_iter"}
    trained = ml.train_staged(mat, numeric, cats, patience=3, max_iter=8, **best)
    assert trained.model.stages[-1].getMaxBins() <= 257
    assert trained.model.stages[-1].featureImportances[1] > trained.model.stages[-1].featureImportances[0]
