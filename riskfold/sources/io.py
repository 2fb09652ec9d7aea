"""Scans and sinks.

CSV only at the edge: ``read_csv`` turns pandas' NA spellings into NULL
before typing (Spark's CSV reader would keep "NA"/"nan"/"null" as text and
make the column a string). Everything between stages is Parquet, the split
set is one table partitioned by ``split``, and fitted parameters are one
Parquet table per lookup plus a one-row scalars table.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import NA_TOKENS, TARGET


def path_kind(spark: SparkSession, path: str) -> str | None:
    """"file" or "folder", None if nothing is there; asked of the path's own file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    return "folder" if fs.getFileStatus(p).isDirectory() else "file"


def path_exists(spark: SparkSession, path: str) -> bool:
    return path_kind(spark, path) is not None


# ---- S1 ----------------------------------------------------------------------------
def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             na_tokens=NA_TOKENS) -> DataFrame:
    """Header CSV scan; NA tokens -> NULL; numeric columns typed afterwards
    (explicit ``schema`` casts, else a parse-share rule like pandas').

    Raises FileNotFoundError / ValueError like the reference loader."""
    _check_csv_path(spark, path)
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return _typed(_without_na(raw, na_tokens), schema, path)


def _check_csv_path(spark: SparkSession, path: str) -> None:
    kind = path_kind(spark, path)
    if not path.endswith(".csv") and kind != "folder":
        raise ValueError(f"not a .csv path: {path}")
    if kind is None:
        raise FileNotFoundError(path)


def _without_na(raw: DataFrame, na_tokens) -> DataFrame:
    tokens = F.array(*[F.lit(t) for t in na_tokens])
    return raw.select(*[F.when(F.array_contains(tokens, F.col(f"`{c}`")), None)
                        .otherwise(F.col(f"`{c}`")).alias(c) for c in raw.columns])


CORRUPT = "_corrupt_record"


def read_csv_quarantine(spark: SparkSession, path: str, schema: T.StructType | None = None,
                        na_tokens=NA_TOKENS) -> tuple[DataFrame, DataFrame]:
    """``read_csv`` that keeps going over malformed lines: (rows, quarantine). A
    line with more or fewer fields than the header is set aside whole, as is one
    whose text is no value of its ``schema`` column; quarantine is (line, reason,
    column). Neither is read twice: the parsed lines are written once."""
    from ..session import materialize

    _check_csv_path(spark, path)
    names = spark.read.option("header", True).option("inferSchema", False).csv(path).columns
    text = T.StructType([T.StructField(c, T.StringType()) for c in [*names, CORRUPT]])
    raw = (spark.read.schema(text).option("header", True).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", CORRUPT).csv(path))
    parsed = materialize(raw, "csv-lines")
    whole = _without_na(parsed.where(F.col(CORRUPT).isNull()).drop(CORRUPT), na_tokens)
    bad = parsed.where(F.col(CORRUPT).isNotNull()).select(
        F.col(CORRUPT).alias("line"), F.lit("fields").alias("reason"), F.lit(None).cast("string").alias("column"))
    if schema is not None:
        wrong = F.array_compact(F.array(*[
            F.when(F.col(f"`{f.name}`").isNotNull() & F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()}) IS NULL"),
                   F.lit(f.name)) for f in schema.fields]))
        whole = whole.withColumn("_wrong", wrong)
        line = F.concat_ws(",", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in names])
        bad = bad.unionByName(whole.where(F.size("_wrong") > 0).select(
            line.alias("line"), F.lit("value").alias("reason"), F.element_at("_wrong", 1).alias("column")))
        whole = whole.where(F.size("_wrong") == 0).drop("_wrong")
    return _typed(whole, schema, path), bad


def _typed(clean: DataFrame, schema: T.StructType | None, path: str) -> DataFrame:
    if schema is not None:
        clean = clean.select(*[F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})")
                               .alias(f.name) for f in schema.fields])
    else:
        clean = infer_numeric(clean)
    if clean.isEmpty():
        raise ValueError(f"empty table: {path}")
    return clean


def infer_numeric(df: DataFrame) -> DataFrame:
    """Type string columns whose non-NULL values all parse: long if all are
    integral, else double (one aggregation pass)."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not strings:
        return df
    from ..operators.base import as_number
    aggs = []
    for c in strings:
        d = as_number(c)
        l_ = F.expr(f"try_cast(`{c}` AS BIGINT)")
        aggs += [F.count(F.col(c)).alias(f"n_{c}"), F.count(d).alias(f"d_{c}"),
                 F.count(l_).alias(f"l_{c}")]
    row = df.agg(*aggs).first()
    cast = {}
    for c in strings:
        n = row[f"n_{c}"]
        if n and row[f"l_{c}"] == n:
            cast[c] = F.expr(f"try_cast(`{c}` AS BIGINT)")
        elif n and row[f"d_{c}"] == n:
            cast[c] = F.expr(f"try_cast(`{c}` AS DOUBLE)")
    return df.withColumns(cast) if cast else df


# ---- S2 / S3 / S4 -------------------------------------------------------------------------
def read_splits(spark: SparkSession, path: str, splits=("train", "val", "test"),
                split_col: str = "split") -> DataFrame:
    """Partitioned split table; checks that every named split is present."""
    df = nan_to_null(spark.read.parquet(path))
    found = {r[0] for r in df.select(split_col).distinct().collect()}
    missing = [s for s in splits if s not in found]
    if missing:
        raise FileNotFoundError(f"splits missing under {path}: {missing}")
    return df.where(F.col(split_col).isin(*splits))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in floating columns as NULL: the one missing value of the engine."""
    kinds = (T.DoubleType, T.FloatType)
    fix = {f.name: F.when(~F.isnan(F.col(f"`{f.name}`")), F.col(f"`{f.name}`"))
           for f in df.schema.fields if isinstance(f.dataType, kinds)}
    return df.withColumns(fix) if fix else df


# ---- S5 / S6 / S7 -------------------------------------------------------------------------
def write_table(df: DataFrame, path: str, partition_by: str | None = None,
                fmt: str = "parquet") -> None:
    """Refuses an empty frame; overwrites; Parquet by default."""
    if df.isEmpty():
        raise ValueError(f"refusing to write an empty table to {path}")
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def split_manifest(df: DataFrame, target: str = TARGET, split_col: str = "split") -> DataFrame:
    """Per split: rows and column count (the test split carries no target)."""
    n_cols = len([c for c in df.columns if c != split_col])
    return df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_cols", F.when(F.col(split_col) == "test", F.lit(n_cols - 1 if target in df.columns
                                                           else n_cols))
        .otherwise(F.lit(n_cols)))


def publish_splits(df: DataFrame, path: str, check: Callable[[DataFrame], DataFrame] | None = None,
                   mode: str | None = None, target: str = TARGET, split_col: str = "split") -> dict:
    """Publish a table partitioned by split, after checks of what was written.

    ``df`` is computed once, into a folder of its own under ``path/versions``.
    ``check`` gives the check table (a boolean or 0/1 column ``ok``) of the written
    rows; any failure raises, and the version that was live stays so. Otherwise a
    line of ``path/_published`` names the new version together with the manifest
    (rows, columns, dtype classes, target placement); appending that line is the
    only step a reader can see."""
    from ..operators.validate import raise_failures

    spark = df.sparkSession
    out = df.withColumn(target, F.when(F.col(split_col) != "test", F.col(target))) \
        if target in df.columns else df
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    staged = os.path.join(path, "versions", version)
    out.write.partitionBy(split_col).parquet(staged)
    written = spark.read.schema(_split_last(out, split_col)).parquet(staged)
    man = {r[split_col]: {"rows": r["n_rows"], "cols": r["n_cols"]}
           for r in split_manifest(written, target, split_col).collect()}
    if not man:
        raise ValueError(f"refusing to publish an empty table to {path}")
    if check is not None:
        raise_failures(check(written))
    manifest = _manifest(df, man, mode, split_col) | {"version": version}
    spark.createDataFrame([(version, json.dumps(manifest))], "version string, manifest string").coalesce(1) \
        .write.mode("append").json(os.path.join(path, "_published"))
    return manifest


def _split_last(df: DataFrame, split_col: str) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != split_col] + [df.schema[split_col]])


def live_version(spark: SparkSession, path: str) -> dict:
    """The manifest of the version published last."""
    if not path_exists(spark, os.path.join(path, "_published")):
        raise FileNotFoundError(f"nothing was published under {path}")
    row = spark.read.schema("version string, manifest string").json(os.path.join(path, "_published")) \
        .orderBy(F.desc("version")).first()
    return json.loads(row["manifest"])


def read_published(spark: SparkSession, path: str, splits=("train", "val", "test"),
                   split_col: str = "split") -> DataFrame:
    """The live version of a published table, every named split checked to be there."""
    manifest = live_version(spark, path)
    missing = [s for s in splits if s not in manifest["splits"]]
    if missing:
        raise FileNotFoundError(f"splits missing under {path}: {missing}")
    df = nan_to_null(spark.read.parquet(os.path.join(path, "versions", manifest["version"])))
    return df.where(F.col(split_col).isin(*splits))


def write_splits_with_manifest(df: DataFrame, path: str, mode: str | None = None,
                               target: str = TARGET, split_col: str = "split") -> dict:
    """One table partitioned by split + ``manifest.json`` (rows,
    columns, dtype classes, target placement)."""
    out = df.withColumn(target, F.when(F.col(split_col) != "test", F.col(target))) \
        if target in df.columns else df
    write_table(out, path, partition_by=split_col)
    man = {r[split_col]: {"rows": r["n_rows"], "cols": r["n_cols"]}
           for r in split_manifest(df, target, split_col).collect()}
    manifest = _manifest(df, man, mode, split_col)
    _write_json(df.sparkSession, os.path.join(path, "_manifest"), manifest)
    return manifest


def _manifest(df: DataFrame, man: dict, mode: str | None, split_col: str) -> dict:
    classes = {"numeric": [], "categorical": [], "other": []}
    for f in df.schema.fields:
        if f.name == split_col:
            continue
        k = ("numeric" if isinstance(f.dataType, T.NumericType) else
             "categorical" if isinstance(f.dataType, T.StringType) else "other")
        classes[k].append(f.name)
    return {"splits": man, "columns": [c for c in df.columns if c != split_col],
            "dtype_classes": classes, "has_target": {s: s != "test" for s in man}, "mode": mode}


def write_json_doc(spark: SparkSession, path: str, obj) -> None:
    """A small document (parameters, a list of names) as one JSON text."""
    _write_json(spark, path, obj)


def _write_json(spark: SparkSession, path: str, obj) -> None:
    spark.createDataFrame([(json.dumps(obj),)], "value string").coalesce(1) \
        .write.mode("overwrite").text(path)


def read_json_doc(spark: SparkSession, path: str):
    rows = spark.read.text(path, wholetext=True).collect()
    return json.loads(rows[0]["value"]) if rows else None


# ---- S8 ------------------------------------------------------------------------------------
def save_params(params, path: str) -> DataFrame:
    """One Parquet table per lookup, scalars as a one-row table; returns the
    readable summary (entries per table)."""
    spark = None
    rows = []
    for name, lk in params.lookups.items():
        lk.df.write.mode("overwrite").parquet(os.path.join(path, name))
        rows.append((name, lk.rows))
        spark = lk.df.sparkSession
    scal = spark.createDataFrame(
        [(params.median_amt, params.global_rate, params.edges,
          json.dumps(params.id_present), list(params.lookups))],
        "median_amt double, global_fraud_rate double, edges array<double>, id_present string, "
        "tables array<string>")
    scal.write.mode("overwrite").parquet(os.path.join(path, "_scalars"))
    rows.append(("amt_edges", max(len(params.edges or []) - 2, 0)))
    return spark.createDataFrame(rows, "param_table string, n_entries long")


def load_params(spark: SparkSession, path: str, cfg):
    from ..operators.lookup import Lookup
    from ..plans.features_job import FeatureParams
    policies = {"card": ["card1"], "email": ["P_emaildomain"], "device": ["DeviceInfo"],
                "addr": ["addr1"], "card_email": ["card1", "P_emaildomain"],
                "uid": ["card1", "addr1"]}
    nulls = {"device": "null", "addr": "null", "card_email": "value", "uid": "value"}
    p = FeatureParams(cfg)
    # the store names its tables: one that can't be read is an error
    s = spark.read.parquet(os.path.join(path, "_scalars")).first()
    for name in s["tables"]:
        df = spark.read.parquet(os.path.join(path, name))
        p.lookups[name] = Lookup(name, policies[name], df, df.count(), nulls.get(name, "default"))
    p.median_amt, p.global_rate = s["median_amt"], s["global_fraud_rate"]
    p.edges = list(s["edges"]) if s["edges"] is not None else None
    p.id_present = json.loads(s["id_present"])
    return p


# ---- S9 / S10 --------------------------------------------------------------------------------
def save_cat_features(spark: SparkSession, cats: list[str], path: str,
                      null_fill: str = "missing", mode: str = "all") -> None:
    spark.createDataFrame([(cats, len(cats), null_fill, mode)],
                          "cat_features array<string>, count int, null_fill string, "
                          "mode string").coalesce(1).write.mode("overwrite").json(path)


def load_cat_features(spark: SparkSession, path: str) -> list[str]:
    return list(spark.read.json(path).first()["cat_features"])


# fixed values, in the order in which they are looked up
_LIST_KEYS = ("top_features", "features", "columns", "selected_features")
_NAME_KEYS = ("feature", "name", "col", "column")


def load_top_features(spark: SparkSession, path: str) -> list[str]:
    """A JSON document in any of the shapes the reference accepts: a
    dict with the list under one of four keys (not empty), a plain list, or a list of
    dicts with the name under one of four keys. Missing file -> [] (keep
    all). The document is a small driver-side list (tens of names)."""
    if not path_exists(spark, path):
        return []
    doc = read_json_doc(spark, path)
    if isinstance(doc, dict):
        doc = next((doc[k] for k in _LIST_KEYS if k in doc), None)
        if doc is None:
            raise ValueError(f"no feature list under {_LIST_KEYS} in {path}")
    if not isinstance(doc, list) or not doc:
        raise ValueError(f"unsupported or empty top-feature document in {path}")
    names = []
    for item in doc:
        if isinstance(item, dict):
            item = next((item[k] for k in _NAME_KEYS if k in item), None)
        if not isinstance(item, str):
            raise ValueError(f"feature names must be strings, got {item!r}")
        names.append(item)
    return names


# ---- S11 / S12 / S13 ----------------------------------------------------------------------------
def write_report(df: DataFrame, path: str) -> None:
    """Small report tables (one to a few hundred rows) as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


def save_model(model, path: str) -> None:
    """Spark ML pipeline model, overwriting."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


def save_target_encoding(encoding, path: str) -> None:
    """The rates as a Parquet table, the rest as a document beside it."""
    encoding.table.write.mode("overwrite").parquet(f"{path}/rates")
    write_json_doc(encoding.table.sparkSession, f"{path}/encoding",
                   {"priors": encoding.priors, "sizes": encoding.sizes, "columns": encoding.columns,
                    "fold_by": encoding.fold_by, "folds": encoding.folds})


def load_target_encoding(spark: SparkSession, path: str):
    from ..operators.target_encode import TargetEncoding
    return TargetEncoding(spark.read.parquet(f"{path}/rates"), **read_json_doc(spark, f"{path}/encoding"))
