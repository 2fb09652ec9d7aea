"""Transactions and identities as streams, features and scores applied.

Both tables arrive as files, in any order within the watermark's delay. Repeated
deliveries of a row are dropped by keyed state that expires with the watermark;
the identity of a transaction is found by a stream-stream left join whose state
expires too: a transaction without one leaves as soon as the watermark says that
none can come. What leaves the state is applied as a batch in ``foreachBatch``:
the fitted tables, whatever their size, meet it as in the batch job, with one
output schema. Each batch overwrites its own folder, so a retried one is written
once; state and sink live under the shared checkpoint folder. The state of a
large table is kept on disk (RocksDB): all rows wait in it for the watermark, and
executors that hold them in memory run out of it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import features_job as fj
from ..session import ensure_checkpoint_dir
from ..sources import fixtures as fx

EVENT_TIME = "event_time"
#: Id of the rows that only move the watermark on.
HEARTBEAT = -1
#: Rows of one file of an arrival; a larger arrival comes as several files.
FILE_ROWS = 500_000
#: Rows from which a stream's state is kept on disk; below, in memory it is faster.
STATE_ROWS = 10_000_000
ON_DISK = {"spark.sql.streaming.stateStore.providerClass":
           "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
           "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


# ---- streams of the two tables ------------------------------------------------------------
def merged_stream(txn: DataFrame, identity: DataFrame, key: str = "TransactionID",
                  bound: str = "1 hour") -> DataFrame:
    """U1 + J1 on streams: both sides without repeated rows, then the left join.

    Both have a watermark on ``event_time``. A row that repeats within the
    watermark's delay is dropped (all columns equal, as in the batch job); an
    identity belongs to a transaction at most ``bound`` away in time."""
    left = txn.dropDuplicatesWithinWatermark()
    right = identity.dropDuplicatesWithinWatermark().withColumnsRenamed({key: "_id", EVENT_TIME: "_time"})
    near = F.col("_time").between(F.col(EVENT_TIME) - F.expr(f"INTERVAL {bound}"),
                                  F.col(EVENT_TIME) + F.expr(f"INTERVAL {bound}"))
    return left.join(right, (F.col(key) == F.col("_id")) & near, "left").drop("_id", "_time")


@dataclass
class Sink:
    """A stream's output: one folder a batch, all of one schema."""

    path: str
    batches: int

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/batch-*")


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings changed for a while: a query takes them when it starts."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_batches(stream: DataFrame, apply: Callable[[DataFrame], DataFrame], name: str = "stream",
                on_disk: bool = False) -> Sink:
    """Run ``stream`` over all that is available; ``apply`` turns what leaves the
    state of a micro-batch into the rows written. ``on_disk``: the state is kept in
    RocksDB and not in the executors' memory."""
    spark = stream.sparkSession
    run = f"{ensure_checkpoint_dir(spark).rstrip('/')}/riskfold-{name}-{uuid.uuid4().hex[:12]}"
    done = []

    def write_batch(batch: DataFrame, number: int) -> None:
        rows = batch.where(F.col("TransactionID") != HEARTBEAT).drop(EVENT_TIME)
        apply(rows).write.mode("overwrite").parquet(f"{run}/out/batch-{number:08d}")
        done.append(number)

    with _settings(spark, ON_DISK if on_disk else {}):
        q = (stream.writeStream.foreachBatch(write_batch).outputMode("append")
             .option("checkpointLocation", f"{run}/chk").trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return Sink(f"{run}/out", len(done))


def feature_sink(merged: DataFrame, base_plan, params, name: str = "features", on_disk: bool = False) -> Sink:
    """Base decisions and features applied to what leaves the join."""
    return run_batches(merged, lambda rows: fj.apply(base_plan.finish(rows), params), name, on_disk)


def score_sink(merged: DataFrame, base_plan, params, model, prepare=None, name: str = "scores",
               on_disk: bool = False) -> Sink:
    """R2: R1 and a fitted model: (id, split, y, p)."""
    from ..operators import ml

    def score(rows: DataFrame) -> DataFrame:
        enriched = fj.apply(base_plan.finish(rows), params)
        return ml.score(model, prepare(enriched) if prepare else enriched)
    return run_batches(merged, score, name, on_disk)


# ---- the fixture's streams ----------------------------------------------------------------
def deliver(spark: SparkSession, sf_dir: str, files: int = 3) -> tuple[str, str]:
    """The events as files in order of arrival: cut by time, one row in 23 a file
    late, one in 29 delivered again with the next file; at last a heartbeat far
    ahead, which lets everything leave the state. An arrival of over ``FILE_ROWS``
    rows is written in parallel, as several files. Returns the folder and the
    watermark's delay, which covers the lateness."""
    events = fx.read_table(spark, sf_dir, "events")
    lo, hi, n = events.agg(F.min("ts"), F.max("ts"), F.count(F.lit(1))).first()
    parts = max(1, -(-n // (files * FILE_ROWS)))
    span = max((hi - lo).total_seconds(), 1.0) / files
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/riskfold-tables/arrivals-{uuid.uuid4().hex[:12]}"
    at = F.floor(F.timestamp_diff("SECOND", F.lit(lo), F.col("ts")) / F.lit(span))
    first = F.least(F.greatest(at, F.lit(0)), F.lit(files - 1)) + (F.col("event_id") % 23 == 0).cast("int")
    # the file numbers that a row comes with
    dealt = events.withColumn("_file", F.explode(F.when(F.col("event_id") % 29 == 0, F.array(first, first + 1))
                                                 .otherwise(F.array(first))))
    for k in range(files + 2):              # one write a file: the source takes files by their time
        arrival = dealt.where(F.col("_file") == k).drop("_file")
        arrival = arrival.coalesce(1) if parts == 1 else arrival.repartition(parts)
        arrival.write.mode("append").parquet(folder)
    ahead = events.limit(1).withColumns({"event_id": F.lit(HEARTBEAT).cast(events.schema["event_id"].dataType),
                                         "props": F.lit('{"k": 99}'),
                                         "ts": F.lit(hi) + F.make_dt_interval(secs=F.lit(span * 20 + 86400.0))})
    ahead.write.mode("append").parquet(folder)
    return folder, f"{int(span * 3) + 3600} seconds"


def delivered_streams(spark: SparkSession, folder: str, delay: str, files_per_trigger: int = 3) -> tuple[DataFrame, DataFrame]:
    """Transactions and identities of a delivery folder as two streams."""
    schema = spark.read.parquet(folder).schema

    def stream(template: str) -> DataFrame:
        events = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
                  .withColumn("_t", F.col("ts").cast("timestamp")).withWatermark("_t", delay))
        return spark.sql(fx._render(template, "{events}", fx.SPARK_SECONDS, f", _t AS {EVENT_TIME}"), events=events)
    return stream(fx._TXN), stream(fx._IDT)


def fixture_streams(spark: SparkSession, sf_dir: str, files: int, files_per_trigger: int) -> tuple[DataFrame, DataFrame]:
    """The delivered events as streams; a micro-batch takes all files of ``files_per_trigger`` arrivals."""
    folder, delay = deliver(spark, sf_dir, files)
    written = len(spark.read.parquet(folder).inputFiles())
    return delivered_streams(spark, folder, delay, max(1, -(-written * files_per_trigger // (files + 3))))


def large(spark: SparkSession, sf_dir: str) -> bool:
    """Whether the events' state is kept on disk (the count reads footers)."""
    return fx.read_table(spark, sf_dir, "events").count() > STATE_ROWS


def stream_features(spark: SparkSession, sf_dir: str, base_plan, params, files: int = 3,
                    files_per_trigger: int = 3) -> DataFrame:
    """R1 over the events delivered as files: the enriched rows, read back."""
    txn, identity = fixture_streams(spark, sf_dir, files, files_per_trigger)
    return feature_sink(merged_stream(txn, identity), base_plan, params, on_disk=large(spark, sf_dir)).read(spark)


def stream_scores(spark: SparkSession, sf_dir: str, base_plan, params, model, prepare=None, files: int = 3,
                  files_per_trigger: int = 3) -> DataFrame:
    """R2 over the events delivered as files: (id, split, y, p)."""
    txn, identity = fixture_streams(spark, sf_dir, files, files_per_trigger)
    return score_sink(merged_stream(txn, identity), base_plan, params, model, prepare,
                      on_disk=large(spark, sf_dir)).read(spark)
