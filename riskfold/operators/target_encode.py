"""Out-of-fold target encoding of wide categorical columns.

A tree learner that takes category indices needs as many bins as its widest
vocabulary has values, and a model that carries every label. A wide column is
replaced here by one number per row: the smoothed target rate of its value.

* Fit is ONE aggregation over (column, value): label sums and counts per fold
  stand side by side in a value's row, so all folds come from the same
  map-side combined shuffle, however many rows one value has.
* A training row of fold k takes its value's rate over the other folds, with
  the other folds' overall rate as prior: its own label and those of its fold
  never enter. Every other row takes the rate over all folds.
* Apply is a left join per column with a table of one row per value, broadcast
  only under a measured size.

Defined results: NULL is a value of its own. A value unseen outside the row's
fold has the prior rate. Rows without a label count nowhere but are encoded.
Without labelled training rows every encoding is NULL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TARGET
from ..session import materialize

FOLDS, SMOOTHING = 5, 20.0
SUFFIX = "__rate"
#: A column with more distinct training values than this is wide.
WIDE_VALUES = 255
BROADCAST_BYTES = 64 * 1024 * 1024


def fold_of(by: list[str], folds: int = FOLDS):
    """A row's fold, from a digest of its key columns: the same in every run and
    retry, and equal keys share a fold."""
    text = F.concat_ws("|", *[F.col(f"`{c}`").cast("string") for c in by])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % folds).cast("int")


def wide_columns(df: DataFrame, cats: list[str], most: int = WIDE_VALUES, split_col: str = "split") -> list[str]:
    """The columns of ``cats`` with more than ``most`` distinct training values,
    told by one scan."""
    if not cats:
        return []
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in cats])
    values = df.where(F.col(split_col) == "train").select(F.inline(cells)).distinct()
    counts = values.groupBy("column").count().where(F.col("count") > most)
    found = {r["column"] for r in counts.collect()}          # one row per column
    return [c for c in cats if c in found]


@dataclass
class TargetEncoding:
    """``table``: (column, value, rates), one row per value; ``rates[k]`` is for
    training rows of fold k, the last for all other rows. ``priors``: the rates of
    values not in the table, in the same order. ``sizes``: bytes per column."""

    table: DataFrame
    priors: list
    sizes: dict
    columns: list[str]
    fold_by: list[str]
    folds: int = FOLDS

    def apply(self, df: DataFrame, split_col: str = "split", suffix: str = SUFFIX,
              broadcast_limit: int = BROADCAST_BYTES) -> DataFrame:
        """``df`` with ``<column><suffix>`` beside every encoded column. Without a
        split column no row counts as a training row."""
        place = F.lit(self.folds)
        if split_col in df.columns:
            place = F.when(F.col(split_col) == "train", fold_of(self.fold_by, self.folds)).otherwise(place)
        out = df.withColumn("_place", place)
        priors = F.array(*[F.lit(p).cast("double") for p in self.priors])
        for c in self.columns:
            rates = self.table.where(F.col("column") == c).select(F.col("value").alias("_value"), F.col("rates").alias("_rates"))
            if self.sizes.get(c, 0) <= broadcast_limit:
                rates = F.broadcast(rates)
            out = out.join(rates, F.col(f"`{c}`").cast("string").eqNullSafe(F.col("_value")), "left")
            out = out.withColumn(c + suffix, F.get(F.coalesce("_rates", priors), F.col("_place"))).drop("_value", "_rates")
        return out.drop("_place")


def fit_target_encoding(df: DataFrame, cats: list[str], fold_by: list[str], target: str = TARGET,
                        folds: int = FOLDS, smoothing: float = SMOOTHING,
                        split_col: str = "split") -> TargetEncoding:
    """Statistics of the labelled training rows, for all ``cats`` in one scan."""
    rows = df.where((F.col(split_col) == "train") & F.col(target).isNotNull())
    rows = rows.select(*cats, F.col(target).cast("double").alias("_y"), fold_of(fold_by, folds).alias("_fold"))
    stats = [a for k in range(folds) for a in (
        F.sum(F.when(F.col("_fold") == k, F.col("_y")).otherwise(0.0)).alias(f"s{k}"),
        F.count(F.when(F.col("_fold") == k, 1)).alias(f"n{k}"))]
    whole = rows.agg(*stats).first()                          # one row: sums and counts per fold
    sums, counts = [whole[f"s{k}"] or 0.0 for k in range(folds)], [whole[f"n{k}"] for k in range(folds)]

    def rate(s, n):
        return s / n if n else None
    priors = [rate(sum(sums) - s, sum(counts) - n) for s, n in zip(sums, counts)] + [rate(sum(sums), sum(counts))]

    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in cats])
    values = rows.select(F.inline(cells), "_y", "_fold").groupBy("column", "value").agg(*stats)
    total_s = sum((F.col(f"s{k}") for k in range(folds)), F.lit(0.0))
    total_n = sum((F.col(f"n{k}") for k in range(folds)), F.lit(0))

    def smoothed(s, n, prior):
        return (s + F.lit(smoothing) * F.lit(prior).cast("double")) / (n + F.lit(smoothing))
    rates = [smoothed(total_s - F.col(f"s{k}"), total_n - F.col(f"n{k}"), priors[k]) for k in range(folds)]
    rates.append(smoothed(total_s, total_n, priors[folds]))
    table = materialize(values.select("column", "value", F.array(*rates).alias("rates")), "target-rates")
    sizes = table.groupBy("column").agg(                      # one row per column
        F.sum(F.coalesce(F.octet_length("value"), F.lit(0)) + 32 + 8 * (folds + 1)).alias("b")).collect()
    return TargetEncoding(table, priors, {r["column"]: r["b"] for r in sizes}, list(cats), list(fold_by), folds)


def encode_wide(df: DataFrame, cats: list[str], fold_by: list[str], target: str = TARGET,
                most: int = WIDE_VALUES, split_col: str = "split"):
    """Wide columns of ``cats`` replaced by their rates. Returns (frame, the
    categorical columns left, the encoding or None)."""
    wide = wide_columns(df, cats, most, split_col)
    if not wide:
        return df, list(cats), None
    enc = fit_target_encoding(df, wide, fold_by, target, split_col=split_col)
    return enc.apply(df, split_col).drop(*wide), [c for c in cats if c not in wide], enc
