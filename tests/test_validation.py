"""Run-time checks of the reference as errors and check tables."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from riskfold.operators import encode as E
from riskfold.operators import validate as V
from riskfold.sources import io


def test_select_features_modes(spark):
    df = spark.createDataFrame([(1, 2.0, "x", 0, "train")],
                               "a long, amt_log double, c string, isFraud int, split string")
    assert E.select_features(df, "all") is df
    top = E.select_features(df, "top50", ["c", "a", "c"])
    assert top.columns == ["split", "c", "a", "amt_log", "isFraud"]     # order kept, deduped
    with pytest.raises(ValueError):
        E.select_features(df, "top10")
    for nothing in (None, []):
        with pytest.raises(FileNotFoundError):
            E.select_features(df, "top50", nothing)


def test_label_encode_unknown_rules(spark):
    train = spark.createDataFrame([("b",), ("a",), ("Unknown",)], "c string")
    codes = E.fit_label_index(train, ["c"])
    assert {r["value"]: r["code"] for r in codes.collect()} == {"Unknown": 0, "a": 1, "b": 2}
    new = spark.createDataFrame([("a",), ("zzz",)], "c string")
    assert [r["c"] for r in E.label_encode(new, codes, ["c"]).collect()] == [1, 0]
    no_unknown = E.fit_label_index(spark.createDataFrame([("a",)], "c string"), ["c"])
    with pytest.raises(ValueError):
        E.label_encode(new, no_unknown, ["c"])


def test_validate_output_flags_failures(spark):
    df = spark.createDataFrame(
        [("train", 25, 1.0, 0), ("val", 3, -1.0, 1), ("test", 4, 0.5, 1)],
        "split string, hour int, amt_log double, isFraud int")
    checks = V.validate_output(df, features=["hour", "amt_log", "time_of_day"])
    bad = {(r["split"], r["check_name"], r["name"]) for r in checks.where("ok = 0").collect()}
    assert ("train", "max", "hour") in bad                      # hour 25 out of range
    assert ("val", "min", "amt_log") in bad                     # negative log amount
    assert ("test", "target_present", "isFraud") in bad         # label in the test split
    assert ("train", "present", "time_of_day") in bad           # missing feature
    with pytest.raises(ValueError):
        V.raise_failures(checks)
    with pytest.raises(ValueError):
        V.require_columns(df, ["TransactionDT"])


def test_read_splits_requires_all(spark):
    d = tempfile.mkdtemp(prefix="riskfold-test-")
    path = os.path.join(d, "base")
    spark.createDataFrame([(1, "train"), (2, "val")], "x long, split string") \
        .write.partitionBy("split").parquet(path)
    with pytest.raises(FileNotFoundError):
        io.read_splits(spark, path)
    assert io.read_splits(spark, path, ("train", "val")).where(F.col("x") > 0).count() == 2
