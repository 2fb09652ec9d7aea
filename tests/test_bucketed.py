"""Co-bucketed tables: joins and groupings on the key without an exchange."""

import collections
import contextlib
import io
import os

import pytest
from pyspark.sql import functions as F

from riskfold.config import FIXTURE_BASE
from riskfold.operators import base as ops
from riskfold.plans import base_job
from riskfold.plans.fixture import Fixture
from riskfold.sources.bucketed import co_bucketed, save_bucketed

SMOKE = "/root/testdata/sf0.001"


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def rows_of(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_joins_without_exchange(spark, no_broadcast):
    fx = Fixture(spark, SMOKE)
    left, right = co_bucketed(fx.txn, fx.idt, "TransactionID")
    merged = ops.merge_identity(left.read(), right.read())
    matched = ops.matched_identity(left.read(), right.read())
    plain = ops.merge_identity(fx.txn, fx.idt)
    assert "Exchange" in plan(plain)
    for df in (merged, matched, merged.dropDuplicates(), merged.groupBy("TransactionID").count()):
        assert "Exchange" not in plan(df)
    assert rows_of(merged) == rows_of(plain)
    assert rows_of(matched) == rows_of(ops.matched_identity(fx.txn, fx.idt))
    left.drop()
    right.drop()
    assert not spark.catalog.tableExists(left.name)
    assert not os.path.exists(left.path.removeprefix("file:"))


def test_one_file_a_bucket(spark):
    fx = Fixture(spark, SMOKE)
    t = save_bucketed(fx.txn, "TransactionID", "files", 5)
    files = t.read().select(F.input_file_name()).distinct().count()
    assert files == 5
    # a table that is dealt by the key already is written without another shuffle
    assert "Exchange" not in plan(t.read().dropDuplicates().repartition(5, "TransactionID"))
    t.drop()


def test_null_repeated_and_mixed_keys(spark, no_broadcast):
    a = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (None, "n"), (3, "x")], "k long, `v.1` string")
    b = spark.createDataFrame([(1, 1.0), (2, None), (None, 5.0), (9, 2.0)], "k int, w double")
    left, right = co_bucketed(a, b, "k", 3)
    got = left.read().join(right.read(), "k", "left")
    assert "Exchange" not in plan(got)
    assert rows_of(got) == collections.Counter(
        {(1, "a", 1.0): 2, (2, None, None): 1, (None, "n", None): 1, (3, "x", None): 1})
    empty, other = co_bucketed(a.limit(0), b, "k", 3)
    assert empty.read().count() == 0 and empty.read().columns == a.columns
    assert empty.read().join(other.read(), "k").count() == 0
    with pytest.raises(KeyError):
        save_bucketed(a, "absent", "none")


def test_base_build_merges_once_and_persists_nothing(spark, monkeypatch):
    fx = Fixture(spark, SMOKE)
    calls = []
    merge = ops.merge_identity
    monkeypatch.setattr(base_job.ops, "merge_identity", lambda *a: calls.append(1) or merge(*a))
    root = spark.sparkContext.getCheckpointDir().removeprefix("file:") + "/riskfold-tables"
    twice = fx.txn.unionByName(fx.txn.limit(200))
    base = base_job.build_base(twice, fx.idt, FIXTURE_BASE)
    assert calls == [1]
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()
    assert not [d for d in os.listdir(root) if d.startswith(("riskfold_merged", "riskfold_distinct"))]
    assert rows_of(base) == rows_of(fx.base)          # repeated rows went
