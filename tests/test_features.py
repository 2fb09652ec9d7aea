"""Smoke frames of the reference (FIXTURES.md §2) with corrected expectations."""

import math

import pytest
from pyspark.sql import functions as F

from riskfold.config import FeatureConfig
from riskfold.functions import features as fx
from riskfold.plans import features_job as fj

AGG_TRAIN = [(101, 50.0, "gmail.com", 0), (101, 60.0, "gmail.com", 1),
             (101, 55.0, "mail.com", 1), (102, 200.0, "mail.com", 1),
             (103, 10.0, "gmail.com", 0), (103, 10.0, None, 0)]


def _rows(df, key="card1"):
    return {r[key]: r for r in df.collect()}


def test_card_and_email_fit_apply(spark):
    train = spark.createDataFrame(
        AGG_TRAIN, "card1 long, TransactionAmt double, P_emaildomain string, isFraud int")
    p = fj.fit(train, FeatureConfig())
    assert p.median_amt == pytest.approx(52.5)          # comment said 55, code gives 52.5
    assert p.global_rate == pytest.approx(0.5)
    card = _rows(p.lookups["card"].df)
    assert card[101]["card1_txn_count"] == 3
    assert card[101]["card1_mean_amt"] == pytest.approx(55.0)
    assert card[101]["card1_std_amt"] == pytest.approx(5.0)
    assert card[102]["card1_std_amt"] == 0.0             # single row: NaN -> 0
    email = _rows(p.lookups["email"].df, "P_emaildomain")
    assert email["gmail.com"]["email_fraud_rate"] == pytest.approx(1 / 3)
    assert email["gmail.com"]["email_txn_count"] == 3
    assert email["mail.com"]["email_fraud_rate"] == pytest.approx(1.0)

    val = spark.createDataFrame([(999, 30.0, "new-domain.com"), (101, 40.0, None),
                                 (102, 10.0, "gmail.com")],
                                "card1 long, TransactionAmt double, P_emaildomain string")
    out = _rows(fj.apply_email(fj.apply_card(val, p), p))
    assert out[999]["card1_txn_count"] == 1
    assert out[999]["card1_mean_amt"] == pytest.approx(52.5)
    assert out[999]["card1_std_amt"] == 0.0 and out[999]["card1_is_high_freq"] == 0
    assert out[999]["email_fraud_rate"] == pytest.approx(0.5)
    assert out[999]["email_txn_count"] == 1
    assert out[101]["email_fraud_rate"] == pytest.approx(0.5)   # NULL domain -> fallback
    assert val.count() == fj.apply_card(val, p).count()         # apply keeps rows


def test_seen_card_with_null_stat_is_not_defaulted(spark):
    train = spark.createDataFrame([(7, None, "a", 0), (8, 5.0, "a", 1)],
                                  "card1 long, TransactionAmt double, P_emaildomain string, "
                                  "isFraud int")
    p = fj.fit(train, FeatureConfig())
    out = _rows(fj.apply_card(train, p))
    assert out[7]["card1_mean_amt"] is None                      # hit with NULL mean
    assert out[7]["card1_txn_count"] == 0


GRAPH_TRAIN = [(101, "Windows/Chrome", 10.0, "gmail.com", 0),
               (101, "Windows/Chrome", 10.0, "gmail.com", 0),
               (102, "iOS/Safari", 20.0, "yahoo.com", 1),
               (103, None, 30.0, "mail.com", 1),
               (104, None, None, None, 1),
               (105, None, 40.0, "gmail.com", 0)]


def test_graph_features(spark):
    train = spark.createDataFrame(GRAPH_TRAIN, "card1 long, DeviceInfo string, addr1 double, "
                                               "P_emaildomain string, isFraud int")
    train = train.withColumn("TransactionAmt", F.lit(1.0))
    p = fj.fit(train, FeatureConfig())
    assert p.global_rate == pytest.approx(0.5)
    dev = _rows(p.lookups["device"].df, "DeviceInfo")
    assert dev["Windows/Chrome"]["device_txn_count"] == 2
    assert dev["iOS/Safari"]["device_txn_count"] == 1
    assert all(r["card_degree"] == 1 for r in p.lookups["addr"].df.collect())
    val = spark.createDataFrame([(101, "Windows/Chrome", 10.0, "gmail.com"),
                                 (999, "Linux/Firefox", 99.0, "unknown.com"),
                                 (102, None, 20.0, "yahoo.com"),
                                 (104, None, None, None)],
                                "card1 long, DeviceInfo string, addr1 double, P_emaildomain string")
    out = _rows(fj.apply_pairs(fj.apply_addr(fj.apply_device(fj.apply_card(
        val.withColumn("TransactionAmt", F.lit(1.0)), p), p), p), p))
    assert out[101]["device_txn_count"] == 2 and out[101]["card_device_is_high"] == 0
    assert out[101]["addr_is_unique"] == 1                       # comment said 0
    assert out[101]["card_email_pair_fraud_rate"] == 0.0         # 2 txns, rate 0
    assert out[999]["device_txn_count"] == 1 and out[999]["addr_is_unique"] == 0
    assert out[999]["card_email_pair_fraud_rate"] == pytest.approx(0.5)   # comment said .333
    assert out[102]["device_txn_count"] is None                   # NULL device -> NULL
    assert out[104]["addr_is_unique"] is None                     # NULL address -> NULL
    # NULL inside a pair key is a fitted value: (104, NULL) was seen with rate 1
    assert out[104]["card_email_pair_fraud_rate"] == 1.0
    assert out[104]["uid_fraud_rate"] == 1.0


def test_amount_features(spark):
    amts = [50.0, 49.95, 0.251, 15.0, 300.0, 31937.391, 0.575, 0.999, None]
    df = spark.createDataFrame([(a,) for a in amts], "TransactionAmt double")
    edges = fj.decile_edges(df, FeatureConfig())
    out = fx.amount_features(df, edges).collect()
    by = {r["TransactionAmt"]: r for r in out}
    assert by[50.0]["amt_cents_type"] == 0 and by[49.95]["amt_cents_type"] == 1
    assert by[0.251]["amt_cents"] == pytest.approx(0.25)
    assert by[15.0]["amt_is_very_low"] == 1 and by[300.0]["amt_is_high"] == 1
    assert by[31937.391]["amt_is_high"] == 1
    assert by[0.575]["amt_cents"] == pytest.approx(0.57)         # half-even like numpy
    assert by[0.999]["amt_cents"] == pytest.approx(1.0)
    assert by[None]["amt_cents_type"] == 2 and by[None]["amt_bucket"] is None
    assert by[None]["amt_is_high"] == 0
    import numpy as np
    vals = np.array([a for a in amts if a is not None])
    qs = sorted(set(np.quantile(vals, np.linspace(0, 1, 11))))
    inner = qs[1:-1]
    for a in vals:
        assert by[a]["amt_bucket"] == sum(1 for e in inner if a > e)


def test_constant_amount_gives_null_bucket(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "TransactionAmt double")
    edges = fj.decile_edges(df, FeatureConfig())
    assert all(r["amt_bucket"] is None for r in fx.amount_features(df, edges).collect())


def test_ratio_features(spark):
    rows = [(60.0, 55.0, 9.0), (800.0, 55.0, 5.0), (50.0, 0.0, 0.0), (500.0, 68.95, 0.0),
            (0.25, 2000.0, 800.0), (5.0, -1.0, -1.0), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "TransactionAmt double, card1_mean_amt double, "
                                     "card1_std_amt double")
    out = fx.ratio_features(df).collect()
    got = [(r["amt_to_card1_mean_ratio"], r["amt_to_card1_std_ratio"]) for r in out]
    assert got[0] == pytest.approx((60 / 56, 6.0))
    assert got[1] == pytest.approx((800 / 56, 800 / 6))
    assert got[2] == pytest.approx((50.0, 50.0))
    assert got[3] == pytest.approx((500 / 69.95, 500.0))
    assert got[4] == pytest.approx((0.25 / 2001, 0.25 / 801))
    assert got[5] == (500.0, 500.0)                               # x/0 = inf -> cap
    assert got[6] == (None, None)


def test_null_flags_and_time(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (1.0, None, 3.0), (None, None, None),
                                (None, 1.0, None), (1.0, None, 1.0), (None, None, None)],
                               "id_01 double, id_13 double, id_16 double")
    out = fx.null_flags(df).collect()
    assert [r["id_data_present"] for r in out] == [1, 1, 0, 0, 1, 0]
    assert [r["id_13_was_null"] for r in out] == [0, 1, 1, 0, 1, 1]
    assert [r["id_16_was_null"] for r in out] == [0, 0, 1, 1, 0, 1]
    t = spark.createDataFrame([(86400,), (28800,), (50400,), (72000,), (-1,)], "TransactionDT long")
    rows = fx.time_features(t).collect()
    assert (rows[0]["hour"], rows[0]["day_of_week"], rows[0]["time_of_day"]) == (0, 1, 0)
    assert rows[1]["hour"] == 8 and rows[1]["is_high_risk_hour"] == 1 and rows[1]["time_of_day"] == 1
    assert rows[2]["hour"] == 14 and rows[2]["time_of_day"] == 2
    assert rows[3]["hour"] == 20 and rows[3]["time_of_day"] == 3
    assert rows[4]["hour"] == 23 and rows[4]["days_since_start"] == -1   # floor semantics
    assert math.isclose(rows[0]["days_since_start"], 1)


def test_combination_path_equals_direct_joins(spark):
    from dataclasses import replace
    rows = [(101, "d1", 10.0, "gmail.com", 0, 5.0), (101, "d2", None, None, 1, 7.0),
            (None, "d1", 10.0, "gmail.com", 1, 3.0), (None, None, None, None, 0, 2.0),
            (102, None, 20.0, "yahoo.com", 1, 9.0), (103, "d3", 30.0, None, 0, None)]
    schema = ("card1 long, DeviceInfo string, addr1 double, P_emaildomain string, "
              "isFraud int, TransactionAmt double")
    train = spark.createDataFrame(rows, schema)
    p = fj.fit(train, FeatureConfig())
    probe = spark.createDataFrame(rows + [(999, "d9", 99.0, "x.com", 0, 1.0),
                                          (None, "d1", None, "gmail.com", 0, 4.0)], schema)
    direct = fj.apply(probe, p)
    forced = replace(p, broadcast_limit=0)
    assert fj.blocks_by_combination(probe, forced) == ["card", "email", "device", "addr", "pairs"]
    combo = fj.apply(probe, forced)

    def norm(df):
        cols = sorted(df.columns)
        out = [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]
        return sorted(out, key=lambda t: tuple((v is None, str(v)) for v in t))

    assert norm(combo) == norm(direct)
    nulls = [r for r in direct.collect() if r["card1"] is None and r["P_emaildomain"] == "gmail.com"]
    # (NULL card, gmail.com) was fitted as a pair value (rate 1.0); NULL card misses the card table
    assert all(r["card_email_pair_fraud_rate"] == 1.0 and r["card1_txn_count"] == 1 for r in nulls)
