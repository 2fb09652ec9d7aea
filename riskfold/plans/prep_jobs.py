"""O4 (indexed matrix, V1) and O5 (categorical matrix, V2) preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TARGET
from ..operators import encode as E
from ..operators import validate as V


def prepare_indexed(base: DataFrame, id_col: str = "TransactionID", target: str = TARGET,
                    split_col: str = "split", keep_id: bool = False) -> tuple[DataFrame, DataFrame]:
    """Drop the id, fill numeric NULLs with -999 and string NULLs with
    "Unknown", label-encode strings with codes fitted on train. Returns the
    matrix (split, X..., target) and the code table. ``keep_id`` leaves the id
    beside the matrix, as a key and not as one of X."""
    df = base if keep_id else E.drop_id(base, id_col)
    x_cols = [c for c in df.columns if c not in (target, split_col, id_col)]
    train = df.where(F.col(split_col) == "train")
    numeric = E.numeric_columns(train.select(*x_cols))
    cats = E.string_columns(train.select(*x_cols))
    df = E.fill_unknown(E.fill_numeric(df, numeric), cats)
    codes = E.fit_label_index(df.where(F.col(split_col) == "train"), cats)
    out = E.label_encode(df, codes, cats)
    return out.select(*([id_col] if keep_id else []), split_col, *x_cols, target), codes


def prepare_categorical(enriched_final: DataFrame, mode: str = "all",
                        top_raw: list[str] | None = None, target: str = TARGET,
                        split_col: str = "split") -> tuple[DataFrame, list[str], DataFrame]:
    """Select by mode, fill categoricals with "missing", cast flags, and
    validate. Returns (matrix, categorical list, check table)."""
    df = E.select_features(enriched_final, mode, top_raw, target, split_col)
    cats = E.cat_features(df.where(F.col(split_col) == "train"), target, (split_col,))
    df = E.cast_flags(E.fill_missing(df, cats))
    numeric = E.numeric_columns(df, (target,))
    checks = V.validate_ready(df, cats, numeric, target, split_col)
    return df, cats, checks
