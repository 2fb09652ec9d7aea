"""Running totals over a global order without a single-partition window.

Rows are first reduced to one per distinct order value (the caller's
aggregation), then range-partitioned by that value; the range's number is
written beside each row, so it stays fixed however often the table is read.
Per-range totals (one row per range, a bound set by ``RANGE_ROWS``) give each
range its offset; a window *partitioned by range* adds the running sum inside
it. Every task holds one range; a value shared by a third of all rows is still
a single row here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Rows of one range; the number of ranges follows the rows, not a session setting.
RANGE_ROWS = 1_000_000


def running_totals_with_sums(df: DataFrame, order_col: str, cols: list[str],
                             descending: bool = True, ranges: int | None = None,
                             prefix: str = "cum_") -> tuple[DataFrame, dict]:
    """Add ``cum_<c>`` = sum of ``c`` over all rows ordered at or before the
    row (inclusive), and give the grand total of each column (the sum of the
    per-range totals, already on the driver). ``order_col`` must be unique per
    row and not NULL (aggregate first)."""
    spark = df.sparkSession
    o = F.col(order_col)
    ranges = ranges or df.count() // RANGE_ROWS + 1
    ranged = materialize(df.repartitionByRange(ranges, o).withColumn("_rng", F.spark_partition_id()),
                         "ranges")
    totals = ranged.groupBy("_rng").agg(*[F.sum(c).alias(c) for c in cols]).collect()
    totals = sorted(totals, key=lambda r: r["_rng"], reverse=descending)
    offsets, acc = [], {c: 0 for c in cols}
    for r in totals:
        offsets.append((r["_rng"], *[int(acc[c]) for c in cols]))
        for c in cols:
            acc[c] += r[c] or 0
    off = spark.createDataFrame(offsets, "_rng int, " + ", ".join(f"_off_{c} long" for c in cols))
    w = (Window.partitionBy("_rng").orderBy(o.desc() if descending else o.asc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = ranged.join(F.broadcast(off), "_rng", "left")
    out = out.withColumns({
        f"{prefix}{c}": (F.sum(c).over(w) + F.col(f"_off_{c}")) for c in cols
    }).drop("_rng", *[f"_off_{c}" for c in cols])
    return out, dict(acc)


def grouped_running_totals(df: DataFrame, by: str, order_col: str, cols: list[str], descending: bool = True,
                           ranges: int | None = None, prefix: str = "cum_") -> DataFrame:
    """``cum_<c>`` per group ``by``: the running totals of every group from one
    range partitioning by (group, order value). A group may span many ranges and a
    range hold many groups; the offsets are one row per (group, range), at most
    as many as there are ranges and groups together. (``by``, ``order_col``) must
    be unique per row and not NULL."""
    o = F.col(order_col).desc() if descending else F.col(order_col).asc()
    ranges = ranges or df.count() // RANGE_ROWS + 1
    ranged = materialize(df.repartitionByRange(ranges, F.col(by), o).withColumn("_rng", F.spark_partition_id()),
                         "group-ranges")
    before = Window.partitionBy(by).orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)
    off = (ranged.groupBy(by, "_rng").agg(*[F.sum(c).alias(c) for c in cols])
           .select(F.col(by).alias("_by"), F.col("_rng").alias("_r"),
                   *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_off_{c}") for c in cols]))
    w = Window.partitionBy(by, "_rng").orderBy(o).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.join(off, (F.col(by) == F.col("_by")) & (F.col("_rng") == F.col("_r")))
    return out.withColumns({f"{prefix}{c}": F.sum(c).over(w) + F.col(f"_off_{c}") for c in cols}).drop(
        "_by", "_r", "_rng", *[f"_off_{c}" for c in cols])
