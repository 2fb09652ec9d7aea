"""Validation as one aggregation per table.

Each validator returns a check table ``(split, check_name, name, value, ok)``
computed by a single ``groupBy(split)`` pass; ``raise_failures`` turns it into
an exception listing every failed check (the table is small: checks x
splits, not rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ALL_ENGINEERED_FEATURES, REQUIRED_INPUTS, TARGET


def require_columns(df: DataFrame, required=REQUIRED_INPUTS, optional=()) -> list[str]:
    """Raise on missing required columns; return missing optional ones."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"required columns missing: {missing}")
    return [c for c in optional if c not in df.columns]


def _long(per_split: DataFrame, entries: list[tuple], split_col: str) -> DataFrame:
    """entries: (check, name, value_col, ok_col) over the per-split row."""
    parts = ", ".join(f"'{c}', '{n}', CAST(`{v}` AS DOUBLE), CAST(`{o}` AS INT)"
                      for c, n, v, o in entries)
    return per_split.selectExpr(split_col, f"stack({len(entries)}, {parts}) "
                                           "AS (check_name, name, value, ok)")


def validate_output(df: DataFrame, features=ALL_ENGINEERED_FEATURES, target: str = TARGET,
                    split_col: str = "split", exempt_all_null=()) -> DataFrame:
    """P11 checks: feature presence, row count, target placement, no
    all-NULL feature, NULL counts and percentages (reported, never failing),
    hour in [0, 23], amt_log >= 0, email_fraud_rate in [0, 1]."""
    present = [f for f in features if f in df.columns]
    n = F.count(F.lit(1))
    aggs = [n.alias("_n")]
    for f in present:
        aggs.append(F.count(F.col(f)).alias(f"_nn_{f}"))
    has_target = target in df.columns
    aggs.append((F.count(F.col(target)) if has_target else F.lit(0)).alias("_nn_target"))
    rng = {"hour": (0, 23), "amt_log": (0, None), "email_fraud_rate": (0, 1)}
    for f in rng:
        if f in df.columns:
            aggs += [F.min(f).alias(f"_min_{f}"), F.max(f).alias(f"_max_{f}")]
    per = df.groupBy(split_col).agg(*aggs)
    cols = {"_ok_rows": F.col("_n") > 0,
            "_ok_target": F.when(F.col(split_col) == "test", F.col("_nn_target") == 0)
            .otherwise(F.col("_nn_target") > 0),
            "_one": F.lit(1), "_zero": F.lit(0)}
    entries = [("rows", "*", "_n", "_ok_rows"), ("target_present", target, "_nn_target",
                                                 "_ok_target")]
    for f in features:
        if f in present:
            cols[f"_null_{f}"] = F.col("_n") - F.col(f"_nn_{f}")
            cols[f"_ok_{f}"] = (F.col(f"_nn_{f}") > 0) | F.lit(f in exempt_all_null)
            cols[f"_pct_{f}"] = F.col(f"_null_{f}") * 100.0 / F.col("_n")
            entries.append(("null_count", f, f"_null_{f}", f"_ok_{f}"))
            entries.append(("null_pct", f, f"_pct_{f}", "_one"))
        else:
            entries.append(("present", f, "_zero", "_zero"))
    for f, (lo, hi) in rng.items():
        if f in df.columns:
            ok = F.coalesce(F.col(f"_min_{f}") >= lo, F.lit(True))
            if hi is not None:
                ok = ok & F.coalesce(F.col(f"_max_{f}") <= hi, F.lit(True))
            cols[f"_ok_rng_{f}"] = ok
            entries.append(("min", f, f"_min_{f}", f"_ok_rng_{f}"))
            entries.append(("max", f, f"_max_{f}", f"_ok_rng_{f}"))
    return _long(per.withColumns(cols), entries, split_col)


def validate_ready(df: DataFrame, cats: list[str], numeric: list[str],
                   target: str = TARGET, split_col: str = "split") -> DataFrame:
    """P12 checks: categoricals are strings without NULLs, target
    placement, and a NULL report of numeric columns (never failing)."""
    n = F.count(F.lit(1))
    aggs = [n.alias("_n"),
            (F.count(F.col(target)) if target in df.columns else F.lit(0)).alias("_nn_target")]
    aggs += [(n - F.count(F.col(c))).alias(f"_null_{c}") for c in cats + numeric]
    per = df.groupBy(split_col).agg(*aggs)
    cols = {"_ok_target": F.when(F.col(split_col) == "test", F.col("_nn_target") == 0)
            .otherwise(F.col("_nn_target") > 0), "_one": F.lit(1)}
    entries = [("target_present", target, "_nn_target", "_ok_target")]
    for c in cats:
        cols[f"_ok_{c}"] = F.col(f"_null_{c}") == 0
        cols[f"_str_{c}"] = F.lit(int(isinstance(df.schema[c].dataType, T.StringType)))
        entries.append(("cat_nulls", c, f"_null_{c}", f"_ok_{c}"))
        entries.append(("cat_type", c, f"_str_{c}", f"_str_{c}"))
    for c in numeric:
        entries.append(("numeric_nulls", c, f"_null_{c}", "_one"))
    return _long(per.withColumns(cols), entries, split_col)


def raise_failures(checks: DataFrame) -> None:
    bad = checks.where(F.col("ok") == 0).collect()
    if bad:
        raise ValueError("validation failed: " + "; ".join(
            f"[{r['split']}] {r['check_name']} {r['name']}={r['value']}" for r in bad))
