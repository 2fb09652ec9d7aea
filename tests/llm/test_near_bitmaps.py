"""Candidates that meet by chance are dropped by bitmaps, before sketches are fetched for them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskfold.llm import minhash
from riskfold.llm.common import ship_code


def test_chance_pairs_fetch_no_sketches(spark, monkeypatch):
    rng = np.random.default_rng(5)
    parts = [[f"w{x}" for x in rng.integers(0, 10 ** 9, 5)] for _ in range(200)]
    # most shingles of a text stand in others too, but few in the same one
    texts = [sum((parts[p] for p in rng.choice(200, 14, replace=False)), []) for _ in range(40)]
    texts.append(texts[3][:-1])         # similar to one of them
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    seen, real = [], minhash._filtered

    def counted(pairs, classes, k):
        seen.append(pairs.count())
        return real(pairs, classes, k)

    monkeypatch.setattr(minhash, "_filtered", counted)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 2).collect()}
    assert got == {i: i for i in range(40)} | {40: 3}
    assert sum(seen) <= 40              # without bitmaps 366 pairs, which share a part each


@pytest.mark.parametrize("k", [16, 64])
def test_bitmaps_keep_what_sketches_and_sets_keep(spark, k):
    ship_code(spark)
    rng = np.random.default_rng(k)
    texts = []
    for i in range(120):
        if i % 3:
            t = list(texts[i - 1])
            for at in rng.integers(0, len(t), int(rng.integers(0, 1 + len(t) // 6))):
                t[at] = f"x{rng.integers(10 ** 6)}"
        else:
            t = [f"w{x}" for x in rng.integers(0, 10 ** 6, int(rng.integers(2, 40) ** 1.5) + 2)]
        texts.append(t)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    classes = minhash.sketches(docs, 2, k).dropDuplicates(["node"]).localCheckpoint()
    sets = minhash.full_sets(docs, 2).dropDuplicates(["node"]).localCheckpoint()
    nodes = classes.select("node")
    pairs = nodes.select(F.col("node").alias("a")).crossJoin(nodes.select(F.col("node").alias("b"))).filter("a < b")
    rows = lambda df: {(r.a, r.b) for r in df.collect()}
    near, likely = rows(minhash._signed(pairs, classes, k)), rows(minhash._filtered(pairs, classes, k))
    assert likely and likely <= near
    close, linked = rows(minhash._alike_in_full(pairs, sets)), rows(minhash._confirmed(pairs, sets))
    assert linked and linked <= close and len(close) < len(nodes.collect()) ** 2 / 20
