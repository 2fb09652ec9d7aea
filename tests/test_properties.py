"""Properties of fit/apply (SURVEY §5 (c))."""

import random

from pyspark.sql import functions as F

from riskfold.config import FeatureConfig
from riskfold.plans import features_job as fj

SCHEMA = ("TransactionID long, TransactionDT long, TransactionAmt double, card1 long, "
          "P_emaildomain string, addr1 double, DeviceInfo string, id_01 double, "
          "id_13 double, id_16 string, isFraud int, split string")


def _frame(spark, seed, n=400):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        split = "train" if i < n * 0.7 else "val" if i < n * 0.85 else "test"
        rows.append((i, 86400 + i * 37, rnd.choice([None, round(rnd.uniform(0.5, 400), 2)]),
                     rnd.choice([None, 1, 2, 3, 4, 5, 6]), rnd.choice([None, "a.com", "b.com"]),
                     rnd.choice([None, 10.0, 20.0, 30.0]), rnd.choice([None, "d1", "d2", "d3"]),
                     rnd.choice([None, 1.0]), rnd.choice([None, 2.0]), rnd.choice([None, "F"]),
                     int(rnd.random() < 0.3), split))
    return spark.createDataFrame(rows, SCHEMA)


def _params_rows(p):
    out = {}
    for name, lk in p.lookups.items():
        cols = sorted(c for c in lk.df.columns)
        out[name] = sorted((tuple(r[c] for c in cols) for r in lk.df.collect()),
                           key=lambda t: tuple((v is None, str(v)) for v in t))
    return out, p.median_amt, p.global_rate, p.edges


def test_params_ignore_val_and_test(spark):
    a = _frame(spark, 1)
    other = _frame(spark, 2).where(F.col("split") != "train")
    b = a.where(F.col("split") == "train").unionByName(other)
    assert _params_rows(fj.fit(a, FeatureConfig())) == _params_rows(fj.fit(b, FeatureConfig()))


def test_apply_keeps_rows_and_is_deterministic(spark):
    df = _frame(spark, 3)
    p = fj.fit(df, FeatureConfig())
    out = fj.apply(df, p)
    assert out.count() == df.count()
    assert set(out.select("TransactionID").rdd.flatMap(lambda r: r).collect()) == set(range(400))
    again = fj.apply(df, fj.fit(df, FeatureConfig()))
    key = sorted(out.columns)
    norm = lambda d: sorted((tuple(r[c] for c in key) for r in d.select(*key).collect()),
                            key=lambda t: tuple((v is None, str(v)) for v in t))
    assert norm(out) == norm(again)


def test_unseen_keys_take_defaults(spark):
    df = _frame(spark, 4)
    p = fj.fit(df, FeatureConfig())
    new = spark.createDataFrame([(10**6, 86400, 50.0, 777, "new.org", 99.0, "dnew", None, None,
                                  None, 0, "test")], SCHEMA)
    r = fj.apply(new, p).first()
    assert r["card1_txn_count"] == 1 and r["card1_mean_amt"] == p.median_amt
    assert r["card1_std_amt"] == 0.0 and r["card1_is_high_freq"] == 0
    assert r["email_fraud_rate"] == p.global_rate and r["email_txn_count"] == 1
    assert r["device_txn_count"] == 1 and r["addr_is_unique"] == 0
    assert r["card_device_is_high"] == 0
    assert r["card_email_pair_fraud_rate"] == p.global_rate == r["uid_fraud_rate"]
