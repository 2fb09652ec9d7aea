"""The streams give the batch job's rows, over late and repeated deliveries."""

import datetime as dt
import os
import tempfile
from dataclasses import replace

from pyspark.sql import functions as F

from riskfold.plans.fixture import Fixture
from riskfold.streaming import apply_stream as S

SMOKE = "/root/testdata/sf0.001"


def _rows(df):
    cols = sorted(df.columns)
    rows = [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]
    return sorted(rows, key=lambda t: tuple((v is None, str(v)) for v in t))


def test_stream_equals_batch_at_both_table_sizes(spark):
    """One path and one schema, whether or not the fitted tables are broadcast."""
    f = Fixture(spark, SMOKE)
    batch = f.enriched
    folder, delay = S.deliver(spark, SMOKE)
    arrived = spark.read.parquet(folder)
    assert len(arrived.inputFiles()) > 4
    assert arrived.count() - 1 > arrived.where(F.col("event_id") != S.HEARTBEAT).distinct().count()      # repeats arrive
    txn, identity = S.delivered_streams(spark, folder, delay, 2)
    sink = S.feature_sink(S.merged_stream(txn, identity), f.base_plan, f.params)
    assert sink.batches > 2
    stream = sink.read(spark)
    assert stream.columns == batch.columns
    assert _rows(stream) == _rows(batch)
    forced = S.stream_features(spark, SMOKE, f.base_plan, replace(f.params, broadcast_limit=0))
    assert forced.schema == stream.schema
    assert _rows(forced) == _rows(batch)


def _files(spark, tables):
    """Each list of (id, minute, ...) rows as one Parquet file of a new folder, in order."""
    folder = tempfile.mkdtemp(prefix="riskfold-stream-")
    for k, (rows, schema) in enumerate(tables):
        start = dt.datetime(2024, 1, 1)
        made = [(r[0], start + dt.timedelta(minutes=r[1]), *r[2:]) for r in rows]
        df = spark.createDataFrame(made, f"TransactionID long, event_time timestamp, {schema}")
        df.coalesce(1).write.parquet(os.path.join(folder, f"f{k}"))
    return folder


def _stream(spark, folder, schema, delay="30 minutes"):
    full = spark.read.schema(f"TransactionID long, event_time timestamp, {schema}").parquet(f"{folder}/f0").schema
    return (spark.readStream.schema(full).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
            .withWatermark("event_time", delay))


def test_late_identity_repeats_and_rows_without_identity(spark):
    far = 10_000
    txn = _files(spark, [([(1, 0, 5.0), (2, 1, 6.0), (2, 1, 6.0)], "amt double"),
                         ([(1, 0, 5.0), (3, 20, 7.0)], "amt double"),              # 1 again, in a later batch
                         ([(2, 1, 6.5), (4, 25, None)], "amt double"),             # another row of the same id stays
                         ([(S.HEARTBEAT, far, 0.0)], "amt double")])
    idn = _files(spark, [([(9, 0, "z")], "dev string"), ([(1, 0, "a"), (1, 0, "a")], "dev string"),
                         ([(3, 20, "c")], "dev string"),                           # after its transaction
                         ([(4, 25 + 61, "far"), (S.HEARTBEAT, far, "")], "dev string")])
    merged = S.merged_stream(_stream(spark, txn, "amt double"), _stream(spark, idn, "dev string"))
    sink = S.run_batches(merged, lambda rows: rows)
    got = sorted(map(tuple, sink.read(spark).select("TransactionID", "amt", "dev").collect()), key=str)
    assert got == sorted([(1, 5.0, "a"), (2, 6.0, None), (2, 6.5, None), (3, 7.0, "c"), (4, None, None)], key=str)


def test_stream_scores_equal_batch_scores(spark):
    from riskfold.operators import ml
    f = Fixture(spark, SMOKE)
    model = ml.train_staged(f.enriched, ["TransactionAmt", "hour", "card1_txn_count"], patience=2, max_iter=4, depth=3).model
    batch = ml.score(model, f.enriched)
    stream = S.stream_scores(spark, SMOKE, f.base_plan, f.params, model)
    assert _rows(stream) == _rows(batch)


def test_large_arrivals_come_as_several_files(spark, monkeypatch):
    f = Fixture(spark, SMOKE)
    f.base  # builds the replayable base plan
    few, _ = S.deliver(spark, SMOKE)
    monkeypatch.setattr(S, "FILE_ROWS", 100)
    folder, _ = S.deliver(spark, SMOKE)
    read = spark.read.parquet(folder)
    assert len(read.inputFiles()) > 12
    assert _rows(read) == _rows(spark.read.parquet(few))
    assert _rows(S.stream_features(spark, SMOKE, f.base_plan, f.params)) == _rows(f.enriched)


def test_planner_does_not_broadcast_tables_measured_above_its_threshold(spark, monkeypatch):
    """A fitted table beyond the limit is small as compressed files, and was sent
    through the driver for that."""
    from riskfold.operators import lookup as L
    rows = [(i, i % 7, "v") for i in range(300)]
    keys = spark.createDataFrame(rows, "k long, a long, s string").withColumn("k", F.when(F.col("a") != 0, F.col("k")))
    stats = keys.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for nulls in ("default", "value"):
        lk = L.Lookup.materialise("t", ["k"], stats, nulls)
        monkeypatch.setattr(L, "PLANNER_BYTES", lk.est_bytes)
        small = L.join_lookup(keys, lk, broadcast_limit=0)            # the planner may choose
        monkeypatch.setattr(L, "PLANNER_BYTES", lk.est_bytes - 1)
        large = L.join_lookup(keys, lk, broadcast_limit=0)
        assert _rows(large) == _rows(small) and large.columns == small.columns
        large.collect()
        plan = large._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
        assert "BroadcastHashJoin" in L.join_lookup(keys, lk)._jdf.queryExecution().executedPlan().toString()


def test_large_state_is_kept_on_disk(spark, monkeypatch):
    """beyond ``STATE_ROWS`` the state is RocksDB's, with the same rows; the session's settings stay."""
    folder = tempfile.mkdtemp(prefix="riskfold-events-")
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=7 * i), i % 11, "abc"[i % 3], float(i % 13), '{"k": %d}' % (i * 7 % 100))
            for i in range(200)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
                          ).coalesce(1).write.parquet(f"{folder}/events.parquet")
    f, key = Fixture(spark, folder), next(iter(S.ON_DISK))
    batch, before, inner, kept = _rows(f.enriched), spark.conf.get(key), S.run_batches, []
    monkeypatch.setattr(S, "run_batches", lambda *a, **kw: kept.append(inner(*a, **kw)) or kept[-1])
    for limit, store in ((200, "HDFSBacked"), (199, "RocksDB")):
        monkeypatch.setattr(S, "STATE_ROWS", limit)
        assert _rows(S.stream_features(spark, folder, f.base_plan, f.params)) == batch
        state = spark.read.text(kept[-1].path.removesuffix("/out") + "/chk/offsets/0").collect()
        assert any(f"{store}StateStoreProvider" in r[0] for r in state)
        assert spark.conf.get(key) == before
