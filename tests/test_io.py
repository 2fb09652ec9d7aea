import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskfold.config import FeatureConfig
from riskfold.plans import features_job as fj
from riskfold.sources import io


def test_csv_na_tokens(spark):
    d = tempfile.mkdtemp(prefix="riskfold-test-")
    path = os.path.join(d, "t.csv")
    with open(path, "w") as f:
        f.write("a,b,c\n1,NA,x\n2,3.5,null\nnan,4,y\n")
    df = io.read_csv(spark, path)
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "string"}
    rows = df.collect()
    assert rows[0]["b"] is None and rows[1]["c"] is None and rows[2]["a"] is None


def test_top_features_shapes(spark):
    d = tempfile.mkdtemp(prefix="riskfold-test-")
    shapes = [{"features": ["a", "b"]}, ["a", "b"], [{"feature": "a"}, {"name": "b"}],
              {"features": ["x"], "top_features": [{"column": "a"}, {"col": "b"}]},
              {"selected_features": ["a", "b"]}]
    for i, doc in enumerate(shapes):
        p = os.path.join(d, f"f{i}.json")
        with open(p, "w") as f:
            json.dump(doc, f)
        assert io.load_top_features(spark, p) == ["a", "b"]
    assert io.load_top_features(spark, os.path.join(d, "missing.json")) == []


def test_param_store_roundtrip(spark):
    train = spark.createDataFrame(
        [(1, 5.0, "a", 0, "d1", 1.0), (1, 7.0, None, 1, None, 2.0), (2, 9.0, "b", 0, "d2", None)],
        "card1 long, TransactionAmt double, P_emaildomain string, isFraud int, "
        "DeviceInfo string, addr1 double")
    p = fj.fit(train, FeatureConfig())
    d = tempfile.mkdtemp(prefix="riskfold-test-")
    summary = {r["param_table"]: r["n_entries"] for r in io.save_params(p, d).collect()}
    assert summary["card"] == 2 and summary["uid"] == 3
    q = io.load_params(spark, d, FeatureConfig())
    a = sorted(map(tuple, fj.apply(train, p).drop("split").collect()))
    b = sorted(map(tuple, fj.apply(train, q).drop("split").collect()))
    assert a == b
    # a table that the store names and that can't be read is an error
    os.rename(os.path.join(d, "uid"), os.path.join(d, "gone"))
    with pytest.raises(Exception):
        io.load_params(spark, d, FeatureConfig())


SPLITS = "id long, x double, isFraud int, split string"


def _splits(spark, shift=0):
    return spark.createDataFrame([(1 + shift, 1.0, 0, "train"), (2 + shift, float("nan"), 1, "val"), (3 + shift, None, 1, "test")],
                                 SPLITS)


def test_publish_keeps_the_old_version_on_failure(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="riskfold-test-"), "t")
    with pytest.raises(FileNotFoundError):
        io.read_published(spark, path)
    seen = spark.sparkContext.accumulator(0)

    def once(rows):
        for r in rows:
            seen.add(1)
            yield r
    counted = spark.createDataFrame(_splits(spark).rdd.mapPartitions(once), SPLITS)
    first = io.publish_splits(counted, path)
    assert seen.value == 3                                   # the plan ran once, the rest reads what was written
    assert first["splits"]["test"] == {"rows": 1, "cols": 2}

    def failing(rows):
        return rows.select("split", F.lit("never").alias("check_name"), F.lit("x").alias("name"),
                           F.lit(1.0).alias("value"), F.lit(0).alias("ok"))
    with pytest.raises(ValueError):
        io.publish_splits(_splits(spark, 10), path, failing)
    rows = io.read_published(spark, path).orderBy("id").collect()
    assert [r["id"] for r in rows] == [1, 2, 3] and rows[1]["x"] is None and rows[2]["isFraud"] is None
    io.publish_splits(_splits(spark, 20), path)
    assert [r["id"] for r in io.read_published(spark, path).orderBy("id").collect()] == [21, 22, 23]
    with pytest.raises(ValueError):
        io.publish_splits(_splits(spark).limit(0), path)
    io.publish_splits(_splits(spark).where("split <> 'val'"), path)
    with pytest.raises(FileNotFoundError):
        io.read_published(spark, path)


def test_malformed_lines_are_set_aside(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="riskfold-test-"), "t.csv")
    with open(path, "w") as f:
        f.write('a,b,c\n1,2.5,x\n2,3.5,y,more\n3\n4,oops,z\nNA,4.5,"q,r"\n')
    rows, bad = io.read_csv_quarantine(spark, path, T.StructType.fromDDL("a LONG, b DOUBLE, c STRING"))
    assert sorted(map(tuple, rows.collect()), key=str) == [(1, 2.5, "x"), (None, 4.5, "q,r")]
    assert sorted(map(tuple, bad.collect()), key=str) == [("2,3.5,y,more", "fields", None), ("3", "fields", None), ("4,oops,z", "value", "b")]
    rows, bad = io.read_csv_quarantine(spark, path)
    assert rows.count() == 3 and bad.count() == 2
    with pytest.raises(FileNotFoundError):
        io.read_csv(spark, path.replace("t.csv", "none.csv"))
    with pytest.raises(ValueError):
        io.read_csv(spark, path + ".gz")
