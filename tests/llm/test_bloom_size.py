"""The runtime Bloom filters, which the driver holds whole, are sized by the keys they are built from."""

import re

import pytest
from pyspark.sql import functions as F

from riskfold.llm import minhash
from riskfold.llm.common import Scratch, settings

BITS = "spark.sql.optimizer.runtime.bloomFilter.numBits"


@pytest.mark.parametrize("rows, bits", [(0, 16), (1, 16), (100, 2048), (20_000, 1 << 19), (3_000_000, 1 << 23)])
def test_bits_follow_the_rows(spark, rows, bits):
    values = minhash._bloom(spark.range(rows))
    assert values[BITS] == str(bits)
    assert values["spark.sql.optimizer.runtime.bloomFilter.expectedNumItems"] == str(max(1, rows))
    assert minhash.BLOOM.items() <= values.items()


def test_plan_has_filters_of_that_size(spark):
    scratch = Scratch()
    pairs = scratch.keep(spark.range(100).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")), "test-pairs")
    classes = scratch.keep(spark.range(5000).select(F.col("id").alias("node"), F.array("id").alias("sketch")), "test-classes")
    # no broadcast of the pairs, as with more of them
    with settings(spark, minhash._bloom(pairs) | {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        plan = minhash._filtered(pairs, classes, 64)._jdf.queryExecution().optimizedPlan().toString()
    found = re.findall(r"bloom_filter_agg\(.*?, (\d+), (\d+), \d+, \d+\)", plan)
    assert found and set(found) == {("100", "2048")}
    scratch.free(spark)


def test_every_filter_of_a_run_is_small(spark, monkeypatch):
    used, real = [], minhash.settings
    monkeypatch.setattr(minhash, "settings", lambda s, values: used.append(values) or real(s, values))
    texts = [f"{' '.join(f'w{i}x{j}' for j in range(40))}" for i in range(6)]
    texts.append(texts[2] + " more")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 2).collect()}
    assert got == {i: i for i in range(6)} | {6: 2}
    used = [v for v in used if v]
    assert used and all(int(v[BITS]) <= 1 << 12 for v in used)
