"""Co-bucketed tables: rows dealt by a key once, when they are written, so that
later joins and groupings on that key need no exchange.

A table is written with one file a bucket, sorted by the key, into the shared
checkpoint folder, and named in the session's catalog. Two tables with the same
key type and number of buckets meet bucket by bucket; grouping by the key, or by
columns that include it, stays inside a bucket.

A bucket is read by one task. Keys should therefore be many (ids); a key that
holds a large part of the rows fills its bucket, and a plain join, whose skewed
partitions adaptive execution splits, serves such tables better. Rows with a
NULL key go to one bucket and join nothing. Column names are kept; the key may
not be a column whose name differs by case only from another. An empty table
gives an empty bucketed table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


class BucketedTable:
    """A written table: ``read()`` scans it with its bucketing, ``drop()`` deletes it."""

    def __init__(self, spark: SparkSession, name: str, path: str, key: str, buckets: int):
        self.spark, self.name, self.path, self.key, self.buckets = spark, name, path, key, buckets

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS `{self.name}`")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def bucket_count(spark: SparkSession) -> int:
    """As many buckets as the session has shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def save_bucketed(df: DataFrame, key: str, name: str, buckets: int | None = None) -> BucketedTable:
    """Write ``df`` in ``buckets`` buckets of ``key`` (default: the session's
    shuffle partitions). The rows are dealt by the hash that buckets use, so a
    task writes one file; rows that a join or grouping on ``key`` has dealt so
    already are not shuffled again."""
    if key not in df.columns:
        raise KeyError(f"{key} missing from {name}")
    spark = df.sparkSession
    buckets = buckets or bucket_count(spark)
    table = f"riskfold_{name}_{uuid.uuid4().hex[:12]}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/riskfold-tables/{table}"
    (df.repartition(buckets, f"`{key}`").write.format("parquet").bucketBy(buckets, key).sortBy(key)
     .option("path", path).saveAsTable(table))
    return BucketedTable(spark, table, path, key, buckets)


def co_bucketed(left: DataFrame, right: DataFrame, key: str,
                buckets: int | None = None) -> tuple[BucketedTable, BucketedTable]:
    """Both tables in the same number of buckets of ``key``. The right key is
    read as the left one's type, since equal values of different types need not
    share a bucket."""
    kind = left.schema[key].dataType
    if right.schema[key].dataType != kind:
        right = right.withColumn(key, right[f"`{key}`"].cast(kind))
    return save_bucketed(left, key, "left", buckets), save_bucketed(right, key, "right", buckets)
