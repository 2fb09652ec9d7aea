"""Scalar feature expressions (time, amount, null flags, ratios).

All are built-in Catalyst expressions, so they stay inside whole-stage
codegen and work unchanged on batch and streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FeatureConfig


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- time (seconds offset, floor semantics) ----------------------------------
def hour(dt) -> Column:
    return F.pmod(F.floor(_c(dt) / 3600), F.lit(24)).cast("int")


def day_of_week(dt) -> Column:
    return F.pmod(F.floor(_c(dt) / 86400), F.lit(7)).cast("int")


def days_since_start(dt) -> Column:
    return F.floor(_c(dt) / 86400).cast("long")


def time_of_day(h: Column) -> Column:
    """Right-closed hour bins: 0 for 0-4, 1 for 5-11, 2 for 12-16, 3 for 17-23."""
    return (F.when(h <= 4, 0).when(h <= 11, 1).when(h <= 16, 2)
            .when(h <= 23, 3).cast("int"))


def time_features(df: DataFrame, dt_col: str = "TransactionDT",
                  cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    if dt_col not in df.columns:          # the block is skipped, as in the reference
        return df
    h = hour(dt_col)
    dow = day_of_week(dt_col)
    lo, hi = cfg.high_risk_hours
    return df.withColumns({
        "hour": h,
        "day_of_week": dow,
        "days_since_start": days_since_start(dt_col),
        "is_weekend": (dow >= 5).cast("int"),
        "is_high_risk_hour": h.between(lo, hi).cast("int"),
        "time_of_day": time_of_day(h),
    })


# ---- amount -------------------------------------------------------------------
def cents(amt) -> Column:
    """``(amt % 1).round(2)`` with floor-mod and round-half-even (numpy)."""
    return F.rint(F.pmod(_c(amt), F.lit(1.0)) * 100) / 100


def cents_type(c: Column) -> Column:
    return F.when(c == 0.0, 0).when(c == 0.95, 1).otherwise(2).cast("int")


def right_closed_bucket(x, inner_edges: list[float]) -> Column:
    """Index of the right-closed interval (e_i, e_i+1] over sorted edges whose
    outer ends are -inf/+inf: the number of inner edges strictly below ``x``.
    NULL input stays NULL."""
    x = _c(x)
    if not inner_edges:
        return F.when(x.isNotNull(), F.lit(0)).cast("int")
    n = None
    for e in inner_edges:
        term = (x > F.lit(float(e))).cast("int")
        n = term if n is None else n + term
    return F.when(x.isNotNull(), n).cast("int")


def amount_features(df: DataFrame, edges: list[float] | None,
                    amt_col: str = "TransactionAmt",
                    cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """``edges`` are the fitted decile edges including the outer -inf/+inf;
    None (not fitted) skips ``amt_bucket``; fewer than two edges (constant
    training column) gives a NULL bucket."""
    if amt_col not in df.columns:
        return df
    a = F.col(amt_col)
    c = cents(a)
    cols = {
        "amt_log": F.log1p(a),
        "amt_cents": c,
        "amt_cents_type": cents_type(c),
        "amt_is_very_low": F.coalesce(a < cfg.amt_very_low, F.lit(False)).cast("int"),
        "amt_is_high": F.coalesce(a > cfg.amt_high, F.lit(False)).cast("int"),
    }
    if edges is not None:
        if len(edges) < 2:
            cols["amt_bucket"] = F.lit(None).cast("int")
        else:
            cols["amt_bucket"] = right_closed_bucket(a, list(edges[1:-1]))
    return df.withColumns(cols)


# ---- null flags ----------------------------------------------------------------
def null_flags(df: DataFrame, present: dict[str, bool] | None = None) -> DataFrame:
    """``present`` says which of id_01/id_13/id_16 the training data had
    (fitted); a flag whose source column was absent is not created."""
    present = present if present is not None else {
        c: c in df.columns for c in ("id_01", "id_13", "id_16")}
    cols = {}
    if present.get("id_01") and "id_01" in df.columns:
        cols["id_data_present"] = F.col("id_01").isNotNull().cast("int")
    if present.get("id_13") and "id_13" in df.columns:
        cols["id_13_was_null"] = F.col("id_13").isNull().cast("int")
    if present.get("id_16") and "id_16" in df.columns:
        cols["id_16_was_null"] = F.col("id_16").isNull().cast("int")
    return df.withColumns(cols) if cols else df


# ---- ratios ---------------------------------------------------------------------
def clipped_ratio(num, den, cfg: FeatureConfig = FeatureConfig()) -> Column:
    """clip(num / (den + smooth), 0, cap) with numpy's semantics: NULL stays
    NULL, a zero denominator gives +-inf which the clip maps to cap / 0."""
    num, den = _c(num), _c(den)
    d = den + F.lit(cfg.ratio_smooth)
    raw = F.when(d == 0, F.when(num > 0, F.lit(float("inf")))
                 .when(num < 0, F.lit(float("-inf"))))
    raw = raw.otherwise(F.try_divide(num, d))
    clipped = F.least(F.greatest(raw, F.lit(0.0)), F.lit(cfg.ratio_cap))
    return F.when(num.isNotNull() & den.isNotNull() & raw.isNotNull(), clipped)


def ratio_features(df: DataFrame, amt_col: str = "TransactionAmt",
                   mean_col: str = "card1_mean_amt", std_col: str = "card1_std_amt",
                   cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    missing = [c for c in (amt_col, mean_col, std_col) if c not in df.columns]
    if missing:   # skipped like the reference; verify_features_added reports it
        return df
    return df.withColumns({
        "amt_to_card1_mean_ratio": clipped_ratio(amt_col, mean_col, cfg),
        "amt_to_card1_std_ratio": clipped_ratio(amt_col, std_col, cfg),
    })
