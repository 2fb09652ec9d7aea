"""Distributed building blocks against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskfold.operators import base as ops
from riskfold.operators import metrics as M
from riskfold.operators.prefix import running_totals_with_sums
from riskfold.operators.selection import exact_quantiles, order_statistics


def test_order_statistics_with_hot_value(spark):
    rnd = random.Random(1)
    vals = [rnd.uniform(-1e6, 1e6) for _ in range(3000)] + [7.0] * 1500 + [None] * 50
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    s = sorted(v for v in vals if v is not None)
    ranks = [0, 1, 1000, 2000, 2500, 3500, len(s) - 1]
    got = order_statistics(df, "x", ranks, buckets=8, final_rows=64)
    assert [v for v, _ in got] == [s[r] for r in ranks]
    for (v, below), r in zip(got, ranks):
        assert below == sum(1 for x in s if x < v)
    q = exact_quantiles(df, "x", [0.0, 0.1, 0.5, 0.9, 1.0])
    assert q == pytest.approx(list(np.quantile(np.array(s), [0.0, 0.1, 0.5, 0.9, 1.0])))


def test_time_split_ties_and_order(spark):
    rows = [(i, 100 + (i // 3)) for i in range(1000)]   # three ids per timestamp
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "TransactionID long, TransactionDT long")
    out = ops.time_split(df).collect()
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    expect = {}
    for pos, (i, _) in enumerate(ordered):
        expect[i] = "train" if pos < 700 else "val" if pos < 850 else "test"
    assert {r["TransactionID"]: r["split"] for r in out} == expect
    with pytest.raises(ValueError):
        ops.cut_ranks(10, (0.5, 0.2, 0.2))


def test_high_null_and_dtypes(spark):
    df = spark.createDataFrame(
        [(1, None, "1", "a"), (2, None, "2", "b"), (3, None, "x", "3"), (4, 1.0, "4", "4"),
         (5, None, "5", "5")], "id long, mostly_null double, nums string, mixed string")
    assert ops.high_null_columns(df, 0.79) == ["mostly_null"]
    assert ops.high_null_columns(df, 0.80) == []                   # strictly greater
    assert ops.numeric_like_columns(df, 0.70) == ["nums"]
    fixed = ops.fix_dtypes(df, 0.70)
    assert dict(fixed.dtypes)["nums"] == "double"
    assert [r["nums"] for r in fixed.orderBy("id").collect()] == [1.0, 2.0, None, 4.0, 5.0]


def test_running_totals_match_cumsum(spark):
    rnd = random.Random(3)
    rows = [(float(i), rnd.randint(0, 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "s double, n long")
    out = {r["s"]: r["cum_n"] for r in running_totals_with_sums(df, "s", ["n"], ranges=7)[0].collect()}
    acc = 0
    for s, n in sorted(rows, reverse=True):
        acc += n
        assert out[s] == acc


def _brute_auc(y, p):
    pos = [pi for yi, pi in zip(y, p) if yi == 1]
    neg = [pi for yi, pi in zip(y, p) if yi == 0]
    tot = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg)
    return tot / (len(pos) * len(neg))


def _brute_ap(y, p):
    order = sorted(set(p), reverse=True)
    P = sum(y)
    ap, prev_r = 0.0, 0.0
    for t in order:
        tp = sum(1 for yi, pi in zip(y, p) if pi >= t and yi == 1)
        n = sum(1 for pi in p if pi >= t)
        r = tp / P
        ap += (r - prev_r) * (tp / n)
        prev_r = r
    return ap


def test_ranking_metrics_brute_force(spark):
    rnd = random.Random(4)
    y = [1 if rnd.random() < 0.2 else 0 for _ in range(400)]
    p = [round(min(1.0, rnd.random() * 0.6 + 0.3 * yi), 2) for yi in y]
    sc = spark.createDataFrame(list(zip(range(400), y, p)), "id long, y int, p double")
    assert M.auc_roc(sc).first()[0] == pytest.approx(_brute_auc(y, p))
    assert M.average_precision(sc).first()[0] == pytest.approx(_brute_ap(y, p))
    pts = M.pr_points(sc).collect()
    assert any(r["threshold"] is None and r["precision"] == 1.0 for r in pts)


def test_threshold_metrics_consistency(spark):
    # reference report at 0.85: TP 1321, FP 1158, TN 84381, FN 1721
    rows = ([(1, 0.9)] * 1321 + [(0, 0.9)] * 1158 + [(0, 0.1)] * 84381 + [(1, 0.1)] * 1721)
    sc = spark.createDataFrame([(i, y, p) for i, (y, p) in enumerate(rows)],
                               "id long, y int, p double")
    r = M.prf_at_threshold(sc, 0.85).first()
    assert round(r["precision"], 5) == 0.53288
    assert round(r["recall"], 5) == 0.43425
    assert round(r["f1"], 5) == 0.47854
    cm = M.confusion_matrix(sc, 0.85).first()
    assert (cm["tp"], cm["fp"], cm["tn"], cm["fn"]) == (1321, 1158, 84381, 1721)


def test_one_class_labels(spark):
    sc = spark.createDataFrame([(1, 0, 0.2), (2, 0, 0.4)], "id long, y int, p double")
    assert M.auc_roc(sc).first()[0] is None
    r = M.prf_at_threshold(sc, 0.3).first()
    assert (r["precision"], r["recall"], r["f1"]) == (0.0, 0.0, 0.0)


def test_dense_codes_large_group_path(spark):
    from riskfold.operators.encode import dense_codes
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choice("abcXYZé_0") for _ in range(rnd.randint(1, 6)))
                    for _ in range(3000)})
    rows = [("big", w) for w in words] + [("small", w) for w in words[:50]]
    vocab = spark.createDataFrame(rows, "column string, value string")
    got = dense_codes(vocab, "column", "value", range_values=400).collect()
    expect_big = {w: i for i, w in enumerate(sorted(words, key=lambda x: x.encode()))}
    expect_small = {w: i for i, w in enumerate(sorted(words[:50], key=lambda x: x.encode()))}
    for r in got:
        exp = expect_big if r["column"] == "big" else expect_small
        assert r["code"] == exp[r["value"]]


def test_time_split_hot_timestamp(spark):
    # 15,000 rows; ids 5000..11999 share one timestamp, and the train cut (row
    # 10,499) falls inside that block.
    n = 15000
    df = spark.range(n).select(
        F.col("id").alias("TransactionID"),
        F.when(F.col("id") < 5000, F.lit(0))
        .when(F.col("id") < 12000, F.lit(1))          # 7,000 tied rows
        .otherwise(F.col("id")).cast("long").alias("TransactionDT"))
    out = {r["TransactionID"]: r["split"] for r in ops.time_split(df).collect()}
    # ordered by (t, id) the row order equals the id order here
    r1, r2 = int(n * 0.70), int(n * 0.85)
    expect = {i: "train" if i < r1 else "val" if i < r2 else "test" for i in range(n)}
    assert out == expect


def test_metrics_leave_out_rows_without_label_or_score(spark):
    from riskfold.operators import metrics as M
    nan = float("nan")
    rows = [(1, 0.9), (None, 0.8), (0, 0.7), (None, 0.6), (1, 0.5), (1, None), (0, nan)]
    df = spark.createDataFrame(rows, "y int, p double")
    assert abs(M.average_precision(df).first()[0] - (1 + 2 / 3) / 2) < 1e-12
    assert M.auc_roc(df).first()[0] == 0.5
    assert tuple(M.confusion_matrix(df, 0.6).first()) == (1, 1, 0, 1)
    assert M.eval_report(df).first()["val_rows"] == 3


def test_ranking_metrics_with_many_shuffle_partitions(spark):
    from riskfold.operators import metrics as M
    df = spark.range(2000).select((F.col("id") % 3 == 0).cast("int").alias("y"),
                                  (F.hash("id") % 100 / 100.0).alias("p"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = M.auc_roc(df).first()[0]
    spark.conf.set("spark.sql.shuffle.partitions", "4000")
    try:
        assert abs(M.auc_roc(df).first()[0] - want) < 1e-12
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_quantiles_with_nan_and_infinities(spark):
    from riskfold.operators.selection import exact_quantiles
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(v,) for v in [1.0, 2.0, 3.0, nan, None]], "x double")
    assert exact_quantiles(df, "x", [0.5]) == [2.0]
    vals = [-inf, *[float(i) for i in range(9000)], 1.7e308, -1.7e308, inf]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    s = sorted(vals)
    ranks = [0, 1, 2, 4500, len(s) - 2, len(s) - 1]
    assert [v for v, _ in order_statistics(df, "x", ranks)] == [s[r] for r in ranks]


def test_fix_dtypes_keeps_text_with_number_suffixes(spark):
    df = spark.createDataFrame([(f"{i}d", f"{i}F", "NaN", f" {i}.5e1") for i in range(20)], "a string, b string, c string, d string")
    assert dict(ops.fix_dtypes(df).dtypes) == {"a": "string", "b": "string", "c": "string", "d": "double"}


def test_ordered_cuts_with_null_ties(spark):
    from riskfold.operators.selection import ordered_cuts
    df = spark.createDataFrame([(1, None), (1, 5), (1, 6), (2, 7)], "t long, i long")
    assert ordered_cuts(df, "t", "i", [0, 1, 2, 3]) == [(1, 5), (1, 6), (1, 6), (2, 7)]


def test_order_statistics_adjacent_doubles(spark):
    import math
    a = 1.0
    b = math.nextafter(a, 2.0)
    vals = [a] * 3000 + [b] * 3000 + [0.0, 5.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    s = sorted(vals)
    got = order_statistics(df, "x", [1, 2999, 3001, 6000, 6001], buckets=4, final_rows=16)
    assert [v for v, _ in got] == [s[r] for r in (1, 2999, 3001, 6000, 6001)]
