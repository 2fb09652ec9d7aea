"""Weighted order statistics of many groups, and what the exploratory queries build on them."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskfold.operators import profile as P
from riskfold.operators import weighted as W

PROBS = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]


def brute(x, w):
    v = np.repeat(np.asarray(x, float), w)
    v = v[~np.isnan(v)]
    if not len(v):
        return 0, None, None, [None] * len(PROBS)
    return len(v), v.mean(), (v.std(ddof=1) if len(v) > 1 else None), list(np.quantile(v, PROBS))


def rows_of(rng, kind, n):
    if kind == "hot":
        x = np.where(rng.random(n) < 0.4, 7.0, rng.normal(0, 1e3, n))
    elif kind == "tiny":
        x = 1e6 + rng.integers(0, 4, n) * 1e-3
    elif kind == "wide":
        x = rng.choice([-1e300, 1e-300, 0.0, 5e-324, 1e300, 3.0], n) * rng.random(n)
    elif kind == "ints":
        x = rng.integers(0, 30, n).astype(float)
    else:
        x = rng.exponential(50, n)
    x = x.astype(object)
    x[rng.random(n) < 0.05] = None
    x[rng.random(n) < 0.02] = math.nan
    return x


@pytest.mark.parametrize("final", [16_384, 50])
def test_groups_against_numpy(spark, monkeypatch, final):
    monkeypatch.setattr(W, "FINAL_ROWS", final)
    rng = np.random.default_rng(8)
    kinds = ["hot", "tiny", "wide", "ints", "exp"]
    table, want = [], []
    for g, kind in enumerate(kinds):
        x, w = rows_of(rng, kind, 3000), rng.integers(0, 5, 3000)
        table += [(g, None if v is None else float(v), int(k)) for v, k in zip(x, w)]
        want.append(brute([math.nan if v is None else v for v in x], w))
    table += [(5, None, 3), (6, 2.5, 1), (None, 1.0, 1), (9, 4.0, 2)]
    want += [(0, None, None, [None] * 6), (1, 2.5, None, [2.5] * 6), (0, None, None, [None] * 6)]
    df = spark.createDataFrame(table, "g int, x double, w long").repartition(5)
    got = W.weighted_stats(df, F.col("x"), F.col("w"), F.col("g"), 8, PROBS, {"rows": F.lit(1)})
    for g, (n, mean, std, qs) in enumerate(want):
        st = got[g]
        assert st.n == n and st.quantiles == pytest.approx(qs, rel=1e-12, abs=0) if n else st.quantiles == qs
        if n and kinds[g:g + 1] != ["wide"]:
            assert st.mean == pytest.approx(mean, rel=1e-9, abs=1e-9)
            assert (st.std is None) == (std is None) and (std is None or st.std == pytest.approx(std, rel=1e-6))
    assert [st.sums["rows"] for st in got] == [3000] * 5 + [1, 1, None]


def test_infinities_are_values(spark):
    x = [-math.inf, -math.inf, 1.0, 2.0, 3.0, math.inf, math.inf]
    (st,) = W.weighted_stats(spark.createDataFrame([(v,) for v in x], "x double"), F.col("x"), probs=[0.0, 0.5, 1.0])
    assert (st.n, st.quantiles, st.lo, st.hi) == (7, [-math.inf, 2.0, math.inf], -math.inf, math.inf)
    assert math.isnan(st.mean)


def test_too_many_groups(spark):
    with pytest.raises(ValueError):
        W.weighted_stats(spark.range(1), F.col("id"), n_groups=W.MAX_GROUPS + 1)


def test_describe_by_class_equals_pandas(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"card": rng.integers(0, 40, 800), "amt": rng.normal(50, 20, 800), "y": rng.integers(0, 2, 800)})
    pdf.loc[rng.random(800) < 0.1, "amt"] = None
    pdf["std"] = pdf.groupby("card")["amt"].transform("std")
    df = spark.createDataFrame(list(pdf[["card", "amt", "y"]].astype(object).where(pdf.notna(), None).itertuples(index=False, name=None)),
                               "card long, amt double, y int")
    keys = P.key_classes(df, "card", F.stddev_samp("amt"), "y")
    assert keys.count() <= 80                       # one row per card and class, not per row
    got = {r["y"]: r for r in P.describe(keys, "stat", by="y", groups=P.CLASSES, weight="n").collect()}
    assert set(got) == {0, 1}
    for y, want in pdf.groupby("y")["std"].describe().iterrows():
        assert [got[y][c] for c in ("count", "mean", "std", "min", "q25", "q50", "q75", "max")] == pytest.approx(list(want))


def test_key_degrees_equal_pandas(spark):
    rows = [("a", "p", 1), ("a", "q", 0), ("a", None, 1), ("b", None, 0), (None, "p", 1), ("a", "p", None)]
    got = P.key_degrees(spark.createDataFrame(rows, "k string, o string, y int"), "k", "o", "y").collect()
    assert sorted(tuple(r) for r in got) == [("a", 2, 4, 3, 2), ("b", 0, 1, 1, 0)]


def test_null_correlation_counts_patterns(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({c: np.where(rng.random(300) < p, None, 1) for c, p in zip("abc", (0.2, 0.5, 0.0))})
    pdf["d"] = pdf["a"]
    df = spark.createDataFrame(list(pdf.itertuples(index=False, name=None)), "a int, b int, c int, d int")
    assert P.null_patterns(df, list("abcd")).count() <= 4
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in P.null_indicator_corr(df, list("abcd")).collect()}
    want = pdf.isna().astype(float).corr()
    assert len(got) == 16
    for (a, b), r in got.items():
        assert (r is None and math.isnan(want.loc[a, b])) or r == pytest.approx(want.loc[a, b])


def test_no_row_level_join_in_key_queries(spark):
    """Only the deviation query joins a key's statistic back to the rows."""
    from riskfold.plans import catalog
    q = catalog.spark_queries()
    for key in ("eda_card_email_degree", "eda_addr_degree", "eda_uid_rate", "eda_device_count_bins"):
        plan = q[key](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan, key
