"""Base-table operators: merge, high-null drop, dedupe, dtype repair, the
exact ordered time split and split summaries."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .selection import ordered_cuts

log = logging.getLogger(__name__)


# ---- J1 / J2 ---------------------------------------------------------------------
def merge_identity(txn: DataFrame, idn: DataFrame, key: str = "TransactionID") -> DataFrame:
    """Left join keeping every transaction (rows multiply on repeated keys)."""
    for name, df in (("transactions", txn), ("identity", idn)):
        if key not in df.columns:
            raise KeyError(f"{key} missing from {name}")
    return txn.join(idn, key, "left")


def matched_identity(txn: DataFrame, idn: DataFrame, key: str = "TransactionID") -> DataFrame:
    """Identity rows whose key occurs in the transactions (left semi join)."""
    return idn.join(txn.select(key), key, "left_semi")


# ---- P3 -------------------------------------------------------------------------
def null_shares(df: DataFrame, cols: list[str] | None = None) -> dict[str, float]:
    """Null share of every column in one pass (one aggregation row)."""
    cols = cols or df.columns
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols]).first()
    return {c: (row[c] if row[c] is not None else 0.0) for c in cols}


def high_null_columns(df: DataFrame, threshold: float = 0.80,
                      protect: tuple = ()) -> list[str]:
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie in (0, 1)")
    shares = null_shares(df)
    return [c for c, s in shares.items() if s > threshold and c not in protect]


def drop_high_null(df: DataFrame, threshold: float = 0.80, protect: tuple = ()) -> DataFrame:
    """Drop columns whose null share is strictly above ``threshold``."""
    return df.drop(*high_null_columns(df, threshold, protect))


# ---- U1 / A11 --------------------------------------------------------------------
def drop_duplicates(df: DataFrame) -> DataFrame:
    """Full-row distinct; NULLs compare equal."""
    return df.dropDuplicates()


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows and full-row duplicates in one pass: group by every column (NULLs
    compare equal, map-side combined), then total the group sizes."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c"))
    return groups.agg(F.sum("_c").cast("long").alias("n_rows"),
                      (F.sum("_c") - F.count(F.lit(1))).cast("long").alias("n_duplicates"))


# ---- P8 -------------------------------------------------------------------------
#: Text that is a number: no type suffixes, no NaN.
NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)\s*$"


def as_number(col: str):
    """A text column as double; NULL where the text is not a number (a plain
    cast would also take type suffixes, as in ``10d``)."""
    c = F.col(f"`{col}`")
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def numeric_like_columns(df: DataFrame, threshold: float = 0.90) -> list[str]:
    """String columns where more than ``threshold`` of *all* rows parse as a
    number (NULLs count as failures). One aggregation pass."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not strings:
        return []
    row = df.agg(*[F.avg(as_number(c).isNotNull().cast("double"))
                   .alias(c) for c in strings]).first()
    return [c for c in strings if row[c] is not None and row[c] > threshold]


def fix_dtypes(df: DataFrame, threshold: float = 0.90,
               cols: list[str] | None = None) -> DataFrame:
    """Coerce numeric-like string columns (``cols`` if already decided)."""
    cols = numeric_like_columns(df, threshold) if cols is None else cols
    if not cols:
        return df
    return df.withColumns({c: as_number(c) for c in cols})


# ---- W1 -------------------------------------------------------------------------
def cut_ranks(n: int, ratios=(0.70, 0.15, 0.15)) -> tuple[int, int]:
    train_r, val_r, test_r = ratios
    if abs(train_r + val_r + test_r - 1.0) > 1e-6:
        raise ValueError(f"split ratios must sum to 1, got {ratios}")
    return int(n * train_r), int(n * (train_r + val_r))


def split_cuts(df: DataFrame, time_col: str = "TransactionDT",
               id_col: str = "TransactionID", ratios=(0.70, 0.15, 0.15)) -> tuple:
    """The ``(time, id)`` keys of the last train row and the last val row in
    ``(time, id)`` order, found by distributed selection (``ordered_cuts``)
    without a global sort. They are parameters: the same cut applies to
    rows arriving later (streams)."""
    t = F.col(time_col)
    stats = df.agg(F.count(F.lit(1)).alias("n"), F.count(t).alias("nt"),
                   F.min(t).alias("lo"), F.max(t).alias("hi")).first()
    n = stats["n"]
    if n == 0:
        raise ValueError("time_split on an empty table")
    if stats["nt"] != n:
        raise ValueError(f"{time_col} has {n - stats['nt']} NULL values")
    r1, r2 = cut_ranks(n, ratios)
    if r1 <= 0 or r2 <= r1 or r2 >= n:
        raise ValueError(f"a split would be empty (n={n}, cuts={r1},{r2})")
    first = (n, stats["lo"], stats["hi"])
    return tuple(ordered_cuts(df, time_col, id_col, [r1 - 1, r2 - 1], first=first))


def assign_split(df: DataFrame, cuts: tuple, time_col: str = "TransactionDT",
                 id_col: str = "TransactionID", split_col: str = "split") -> DataFrame:
    """Row-local split from the cut keys (no shuffle; stream-safe)."""
    (t1, i1), (t2, i2) = cuts
    t, i = F.col(time_col), F.col(id_col)

    def le(tc, ic):
        return (t < F.lit(tc)) | ((t == F.lit(tc)) & (i <= F.lit(ic)))

    return df.withColumn(split_col, F.when(le(t1, i1), "train")
                         .when(le(t2, i2), "val").otherwise("test"))


def time_split(df: DataFrame, time_col: str = "TransactionDT",
               id_col: str = "TransactionID", ratios=(0.70, 0.15, 0.15),
               split_col: str = "split") -> DataFrame:
    """Exact ordered split by ``(time, id)``: train gets the first
    int(n*0.70) rows, val the next up to int(n*0.85), test the rest. Cut
    keys come from distributed selection, the split is a row-local
    comparison, so no task ever holds more than its own partition."""
    return assign_split(df, split_cuts(df, time_col, id_col, ratios), time_col, id_col,
                        split_col)


# ---- A12 ------------------------------------------------------------------------
def split_summary(df: DataFrame, time_col: str = "TransactionDT",
                  target: str = "isFraud", drift_warn: float = 0.015,
                  split_col: str = "split") -> DataFrame:
    """Per split: rows, time range, target rate and a drift flag against the
    overall rate (one aggregation, joined to the one-row overall)."""
    per = df.groupBy(split_col).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(time_col).alias("min_time"),
        F.max(time_col).alias("max_time"),
        F.sum(target).alias("_pos"),
        F.count(target).alias("_lab"))
    # the overall rate comes from the (few) split rows, not a second scan
    everything = Window.partitionBy()
    overall = F.sum("_pos").over(everything) / F.sum("_lab").over(everything)
    rate = F.col("_pos") / F.col("_lab")
    return per.select(split_col, "n_rows", "min_time", "max_time",
                      F.round(rate, 6).alias("fraud_rate"),
                      (F.abs(rate - overall) > drift_warn).cast("int").alias("drift_flag"))
