"""Model-matrix preparation: column typing, null fills, flag casts, label
codes and column selection (P1, P4-P7, P13-P17, C1, C2)."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import (ALL_ENGINEERED_FEATURES, BINARY_FLAGS, CAT_MISSING, CAT_UNKNOWN,
                      NUMERIC_FILL, TARGET, TOP50_ENGINEERED)
from ..session import materialize

log = logging.getLogger(__name__)


def drop_id(df: DataFrame, col: str = "TransactionID") -> DataFrame:
    if col not in df.columns:
        log.warning("%s not present; nothing dropped", col)
    return df.drop(col)


def split_xy(df: DataFrame, target: str = TARGET, exclude=("split",)) -> tuple[list[str], str]:
    """Feature columns (everything but target and split) and the target;
    one frame is kept, only the column lists are separated."""
    if target not in df.columns:
        raise ValueError(f"target {target!r} not in the frame")
    return [c for c in df.columns if c != target and c not in exclude], target


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def cat_features(df: DataFrame, target: str = TARGET, exclude=("split",)) -> list[str]:
    """Sorted string columns except the target (and the split column)."""
    return sorted(string_columns(df, (target, *exclude)))


def fill_numeric(df: DataFrame, cols: list[str], value=NUMERIC_FILL) -> DataFrame:
    """NULL -> -999 in the given numeric columns (types kept)."""
    return df.na.fill(value, subset=[c for c in cols if c in df.columns])


def fill_unknown(df: DataFrame, cols: list[str], value: str = CAT_UNKNOWN) -> DataFrame:
    """NULL -> "Unknown"."""
    return df.na.fill(value, subset=[c for c in cols if c in df.columns])


def fill_missing(df: DataFrame, cats: list[str], value: str = CAT_MISSING) -> DataFrame:
    """Cast to string, NULL -> "missing"."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(value))
                           for c in cats if c in df.columns})


def cast_flags(df: DataFrame, flags=BINARY_FLAGS) -> DataFrame:
    """Binary flags to int (NULLs stay NULL; Spark ints are nullable)."""
    return df.withColumns({c: F.col(c).cast("int") for c in flags if c in df.columns})


#: Vocabulary values of one range (one task's window).
RANGE_VALUES = 2_000_000


def fit_label_index(train: DataFrame, cats: list[str]) -> DataFrame:
    """(column, value, code) with codes 0..k-1 in code-point order of
    the distinct training values of each column; one scan for all columns."""
    if not cats:
        return train.sparkSession.createDataFrame([], "column string, value string, code long")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                      for c in cats])
    vocab = train.select(F.inline(cells)).where(F.col("value").isNotNull()).distinct()
    return dense_codes(vocab, "column", "value")


def dense_codes(vocab: DataFrame, part: str, value: str,
                range_values: int = RANGE_VALUES) -> DataFrame:
    """0-based rank of each distinct ``value`` within its ``part`` in
    code-point (UTF-8 byte) order.

    The rows are range-partitioned by (part, value) and written with their
    range's number. Counts per part and range (one row each) give offsets and a
    window partitioned by (part, range) ranks inside each range, so no task
    holds a whole large vocabulary."""
    key = F.col(value).cast("binary")
    vocab = materialize(vocab, "vocabulary")
    ranges = vocab.count() // range_values + 1
    ranged = materialize(vocab.repartitionByRange(ranges, F.col(part), key)
                         .withColumn("_rng", F.spark_partition_id()), "vocabulary-ranges")
    totals = sorted((r[part], r["_rng"], r["n"]) for r in
                    ranged.groupBy(part, "_rng").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, acc, last = [], 0, None
    for g, b, n in totals:
        if g != last:
            acc, last = 0, g
        offsets.append((g, b, acc))
        acc += n
    off = vocab.sparkSession.createDataFrame(offsets, f"{part} string, _rng int, _off long")
    w = Window.partitionBy(part, "_rng").orderBy(key)
    codes = (ranged.join(F.broadcast(off), [part, "_rng"])
             .withColumn("code", (F.row_number().over(w) - 1 + F.col("_off")).cast("long"))
             .drop("_rng", "_off"))
    return materialize(codes, "label-codes")


def _codes_by_combination(df: DataFrame, mapping: DataFrame, cols: list[str]) -> DataFrame:
    """``df`` with the code of every column of ``cols`` as ``_code_<column>`` (NULL:
    no such value). The distinct combinations of the columns are stacked as
    (combination, column, value), joined with the code table once, and joined
    back to the rows once, NULL-safely: one shuffle of the wide rows for all columns.
    Stacked rows are narrow, and adaptive execution splits a frequent value."""
    text = {c: F.col(f"`{c}`").cast("string") for c in cols}
    combos = df.select(*[text[c].alias(f"_v_{c}") for c in cols]).distinct()
    key = [f"_v_{c}" for c in cols]
    stacked = combos.select(*key, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`_v_{c}`").alias("value")) for c in cols])).alias("cell"))
    coded = (stacked.select(*key, "cell.column", "cell.value")
             .join(mapping.where(F.col("column").isin(cols)).select("column", "value", "code"), ["column", "value"])
             .groupBy(*key).agg(*[F.max(F.when(F.col("column") == c, F.col("code"))).alias(f"_code_{c}") for c in cols]))
    on = [text[c].eqNullSafe(F.col(f"`_v_{c}`")) for c in cols]
    return df.join(coded, on, "left").drop(*key)


def label_encode(df: DataFrame, mapping: DataFrame, cats: list[str],
                 unknown: str = CAT_UNKNOWN, check: bool = True,
                 broadcast_limit: int = 64 * 1024 * 1024) -> DataFrame:
    """Value -> code; a value unseen in training maps to the code of
    ``unknown``; if that code does not exist and misses occur, raise."""
    unk = {r["column"]: r["code"] for r in
           mapping.where(F.col("value") == unknown).select("column", "code").collect()}
    # vocabulary sizes (one row per column) decide which mappings are broadcast
    sizes = {r["column"]: (r["n"], r["w"] or 0) for r in mapping.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value")).alias("w")).collect()}
    wide = [c for c in cats if (lambda n, w: n * 24 + w)(*sizes.get(c, (0, 0))) > broadcast_limit]
    # one wide vocabulary is joined directly; several share one join of the rows
    out = _codes_by_combination(df, mapping, wide) if len(wide) > 1 else df
    for c in cats:
        default = F.lit(unk.get(c)).cast("long")
        if len(wide) < 2 or c not in wide:
            m = mapping.where(F.col("column") == c).select(
                F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"_code_{c}"))
            if c not in wide:
                m = F.broadcast(m)
            out = out.join(m, F.col(c).cast("string") == F.col(f"_v_{c}"), "left").drop(f"_v_{c}")
        out = out.withColumn(c, F.coalesce(F.col(f"_code_{c}"), default)).drop(f"_code_{c}")
    if check:
        missing_unknown = [c for c in cats if c not in unk]
        if missing_unknown:
            bad = out.where(F.greatest(*[F.col(c).isNull() for c in missing_unknown]
                                       + [F.lit(False)])).limit(1).count()
            if bad:
                raise ValueError(f"unseen values but no '{unknown}' class in training for "
                                 f"{missing_unknown}")
    return out


def select_final(df: DataFrame, top_raw: list[str] | None, raw_columns: list[str],
                 engineered=ALL_ENGINEERED_FEATURES, target: str = TARGET,
                 split_col: str = "split") -> DataFrame:
    """Top raw (empty -> all raw) + engineered + target; the target is
    removed from the test split (NULL in the single-frame layout)."""
    raw = list(top_raw) if top_raw else [c for c in raw_columns if c not in (target, split_col)]
    missing = [c for c in raw + list(engineered) if c not in df.columns]
    if missing:
        log.warning("selected columns not present: %s", missing)
    keep = list(dict.fromkeys([c for c in raw + list(engineered) if c in df.columns]))
    cols = [split_col, *keep] if split_col in df.columns else keep
    out = df.select(*cols, target) if target in df.columns else df.select(*cols)
    if target in df.columns and split_col in df.columns:
        out = out.withColumn(target, F.when(F.col(split_col) != "test", F.col(target)))
    return out


def select_features(df: DataFrame, mode: str, top_raw: list[str] | None = None,
                    target: str = TARGET, split_col: str = "split") -> DataFrame:
    """P5: "all" -> unchanged; "top50" -> top raw + 15 engineered + target,
    order-preserving de-duplication. "top50" needs the list of top raw columns."""
    if mode == "all":
        return df
    if mode != "top50":
        raise ValueError(f"mode must be 'all' or 'top50', got {mode!r}")
    if not top_raw:
        raise FileNotFoundError("mode 'top50' needs the list of top features: rank a V1 model first, or use 'all'")
    wanted = list(top_raw) + TOP50_ENGINEERED + [target]
    present = [c for c in dict.fromkeys(wanted) if c in df.columns]
    absent = [c for c in wanted if c not in df.columns]
    if absent:
        log.warning("top50 columns not present: %s", absent)
    if split_col in df.columns and split_col not in present:
        present = [split_col] + present
    return df.select(*present)
