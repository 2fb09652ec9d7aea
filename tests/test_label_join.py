"""Label codes of several wide vocabularies: one join of the rows."""

import collections
import contextlib
import io

import pytest
from pyspark.sql import functions as F

from riskfold.operators import encode as E


def rows_of(df):
    return collections.Counter(tuple(r) for r in df.collect())


def tables(spark):
    train = spark.createDataFrame([("a", "x", "p", 1), ("b", "Unknown", "q", 2), ("Unknown", "y", "Unknown", 3)],
                                  "c1 string, c2 string, c3 string, k int")
    rows = [("a", "x", "p", 1), ("a", "x", "p", 1), ("zz", "y", "q", 2), (None, None, None, 3),
            ("b", None, "new", 4), ("Unknown", "x", "", 5)] + [("a", "y", "p", 6)] * 40
    return E.fit_label_index(train, ["c1", "c2", "c3"]), spark.createDataFrame(rows, train.schema)


def test_all_paths_give_the_same_codes(spark):
    codes, df = tables(spark)
    narrow = E.label_encode(df, codes, ["c1", "c2", "c3"])
    wide = E.label_encode(df, codes, ["c1", "c2", "c3"], broadcast_limit=-1)
    assert narrow.columns == wide.columns == df.columns
    assert rows_of(narrow) == rows_of(wide)
    table = {(r["column"], r["value"]): r["code"] for r in codes.collect()}
    want = collections.Counter(
        (*[table.get((c, v), table[c, "Unknown"]) for c, v in zip(("c1", "c2", "c3"), r)], r.k) for r in df.collect())
    assert rows_of(wide) == want
    one = E.label_encode(df, codes, ["c1"], broadcast_limit=-1)
    assert rows_of(one.select("c1", "k")) == rows_of(wide.select("c1", "k"))
    assert E.label_encode(df.limit(0), codes, ["c1", "c2"], broadcast_limit=-1).count() == 0


def test_rows_are_joined_once(spark):
    codes, df = tables(spark)
    # a hint would go with limits below zero; a plan without broadcasts shows the joins
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            E.label_encode(df, codes, ["c1", "c2", "c3"], broadcast_limit=-1).explain()
        assert buf.getvalue().count("SortMergeJoin") == 2        # cells with codes, rows with combinations
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_unseen_values_without_unknown_raise(spark):
    codes, df = tables(spark)
    with pytest.raises(ValueError):
        E.label_encode(df, codes.filter(F.col("value") != "Unknown"), ["c1", "c2"], broadcast_limit=-1)
