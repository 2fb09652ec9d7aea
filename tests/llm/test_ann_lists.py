"""Operator 8: boundary vectors stand in several lists, the graph finds near centroids, held-out recall."""

import collections

import numpy as np
from pyspark.sql import functions as F

from riskfold.llm import ann


def test_vectors_are_replicated_and_held_out_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_ROWS", 64)
    monkeypatch.setattr(ann, "CALIBRATION", 40)
    written = {}
    materialize = ann.materialize

    def kept(df, name, *a):
        written[name] = materialize(df, name, *a)
        return written[name]
    monkeypatch.setattr(ann, "materialize", kept)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").withColumn("list", F.lit("a clashing column"))
    got = collections.defaultdict(set)
    for r in ann.nearest(df).collect():
        got[r.query_id].add(r.vec_id)
    vectors, postings = written["op8-vectors"], written["op8-postings"]
    assert postings.count() > 1.2 * vectors.count()
    assert postings.groupBy("vec_id").count().agg(F.max("count")).first()[0] <= ann.REPLICAS
    fitted = {r.vec_id for r in vectors.where("vec_id % 20 = 0").orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(40).collect()}
    rows = vectors.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.v for r in rows], float)
    hits = asked = 0
    for q in np.flatnonzero(ids % 20 == 0):
        if ids[q] in fitted:
            continue
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(ids[np.argsort(-s)[:20]].tolist()) & got[int(ids[q])])
        asked += 20
    assert asked >= 1000 and hits >= 0.9 * asked


def test_graph_search_finds_near_centroids():
    rng = np.random.default_rng(1)
    c = ann.Centroids(rng.normal(size=(700, 16)).astype(np.float32))
    x = rng.normal(size=(300, 16)).astype(np.float32)
    ids, d = c.search(x)
    every = c._distance(x, c.points)
    assert (np.diff(d, axis=1) >= 0).all() and all(len(set(r)) == len(r) for r in ids)
    assert (ids[:, 0] == every.argmin(1)).mean() > 0.97
    assert np.allclose(np.take_along_axis(every, ids, 1), d, atol=1e-4)


def test_hits_keep_ties_and_count_ids_once():
    ids = np.array([1, 1, 2, 3, 4, 5])
    x = np.array([[1.0], [3.0], [2.0], [2.0], [2.0], [1.0]])
    q, i, s = ann._hits(np.array([9, 3]), np.array([[1.0], [1.0]]), np.array([-np.inf, 1.5]), ids, x, 2)
    assert [(a, b, c) for a, b, c in zip(q, i, s)] == [(9, 1, 3.0), (9, 2, 2.0), (9, 3, 2.0), (9, 4, 2.0),
                                                       (3, 1, 3.0), (3, 2, 2.0), (3, 4, 2.0)]


def _peak_mb(run):
    import tracemalloc
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 2 ** 20
    finally:
        tracemalloc.stop()


def test_a_task_holds_few_distances_whatever_the_lists():
    """4,096 lists and long lists, as tables of millions of rows have them."""
    rng = np.random.default_rng(3)
    graph = ann.Centroids(rng.normal(size=(4096, 24)).astype(np.float32))
    x = rng.normal(size=(2048, 24)).astype(np.float32)
    assert _peak_mb(lambda: graph.search(x)) < 80
    size = np.full(4096, 5000)
    assert _peak_mb(lambda: graph.lists_read(x[:1024], size, 1.01, 100)) < 80
    rows, lists, before = graph.lists_read(x[:600], size, 1.2, 100)
    d = graph._distance(x[:600], graph.points)
    near = d <= 1.2 ** 2 * d.min(1)[:, None]
    assert (np.bincount(rows, minlength=600) >= 1).all() and near[rows, lists].mean() > 0.99 and (before % 5000 == 0).all()


def test_scores_of_a_long_list_in_parts(monkeypatch):
    rng = np.random.default_rng(4)
    x, q = rng.integers(-3, 4, (16_000, 8)).astype(float), rng.integers(-3, 4, (1000, 8)).astype(float)
    ids, qid, floor = np.arange(16_000), np.arange(1000), np.full(1000, 40.0)
    whole = [sorted(zip(*ann._best_ids(*ann._hits(qid, q, floor, ids, x, 5), 5)))]
    assert _peak_mb(lambda: ann._hits(qid, q, floor, ids, x, 5)) < 100
    monkeypatch.setattr(ann, "CELLS", 1 << 30)
    whole.append(sorted(zip(*ann._best_ids(*ann._hits(qid, q, floor, ids, x, 5), 5))))
    assert len(whole[0]) > 100 and whole[0] == whole[1]
