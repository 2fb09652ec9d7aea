"""Registered queries, part 2: selection, encodings, validation, manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ALL_ENGINEERED_FEATURES, BINARY_FLAGS, TOP50_ENGINEERED
from ..operators import encode as E
from ..operators import target_encode as TE
from ..operators import validate as V
from ..sources.fixtures import BASE_COLUMNS
from .catalog_core import ENRICHED_FLOATS, plain, with_params
from .fixture import fixture
from ..session import ensure_checkpoint_dir
from .prep_jobs import prepare_categorical, prepare_indexed

Q: dict = {}


def reg(key, fn, sql, floats=()):
    Q[key] = (fn, sql, list(floats))


RAW = [c for c in BASE_COLUMNS if c != "isFraud"]
NUMERIC_BASE = ["TransactionDT", "TransactionAmt", "card1", "addr1", "k", "id_01", "id_13"]
CATS = ["DeviceInfo", "P_emaildomain", "id_16"]
# raw columns a ranking would put on top (fixture stand-in for the top-50 file)
TOP_RAW = ["TransactionAmt", "card1", "addr1", "P_emaildomain", "DeviceInfo", "id_01"]


def _final(spark, sf):
    fxt = fixture(spark, sf)
    return E.select_final(fxt.enriched, [], RAW)


FINAL_SQL = ("final AS (SELECT * REPLACE (CASE WHEN split = 'test' THEN NULL ELSE isFraud END "
             "AS isFraud) FROM enriched)")


def with_final(body: str) -> str:
    return with_params("").replace("-- result\n", "") + "," + FINAL_SQL + "\n-- result\n" + body


# ---- P1, P13-P16 ---------------------------------------------------------------------
reg("drop_id", lambda s, sf: E.drop_id(fixture(s, sf).base),
    plain("SELECT * EXCLUDE (TransactionID) FROM base"),
    ["TransactionAmt", "addr1", "id_01", "id_13"])
reg("fill_numeric", lambda s, sf: E.fill_numeric(fixture(s, sf).base, NUMERIC_BASE)
    .select("TransactionID", *NUMERIC_BASE),
    plain("SELECT TransactionID, TransactionDT, coalesce(TransactionAmt, -999) AS TransactionAmt, "
          "card1, coalesce(addr1, -999) AS addr1, k, coalesce(id_01, -999) AS id_01, "
          "coalesce(id_13, -999) AS id_13 FROM base"),
    ["TransactionAmt", "addr1", "id_01", "id_13"])
reg("fill_unknown", lambda s, sf: E.fill_unknown(fixture(s, sf).base, CATS)
    .select("TransactionID", *CATS),
    plain("SELECT TransactionID, coalesce(DeviceInfo, 'Unknown') AS DeviceInfo, "
          "coalesce(P_emaildomain, 'Unknown') AS P_emaildomain, "
          "coalesce(id_16, 'Unknown') AS id_16 FROM base"))
reg("fill_missing", lambda s, sf: E.fill_missing(fixture(s, sf).enriched,
                                                 CATS + ["card_device_is_high"])
    .select("TransactionID", *CATS, "card_device_is_high"),
    with_params("SELECT TransactionID, coalesce(DeviceInfo, 'missing') AS DeviceInfo, "
                "coalesce(P_emaildomain, 'missing') AS P_emaildomain, "
                "coalesce(id_16, 'missing') AS id_16, "
                "coalesce(CAST(card_device_is_high AS VARCHAR), 'missing') AS card_device_is_high "
                "FROM enriched"))
_FLAGS = [f for f in BINARY_FLAGS if f != "amt_is_round"]
reg("cast_flags", lambda s, sf: E.cast_flags(fixture(s, sf).enriched)
    .select("TransactionID", *_FLAGS),
    with_params("SELECT TransactionID, " + ", ".join(f"CAST({f} AS INTEGER) AS {f}"
                                                    for f in _FLAGS) + " FROM enriched"))


# ---- C1 / C2 / O4 ----------------------------------------------------------------------
def _v1(spark, sf):
    return prepare_indexed(fixture(spark, sf).base)


_V1_FILLED = ("v1f AS (SELECT split, TransactionDT, coalesce(TransactionAmt, -999) AS "
              "TransactionAmt, card1, coalesce(P_emaildomain, 'Unknown') AS P_emaildomain, "
              "coalesce(addr1, -999) AS addr1, isFraud, k, coalesce(id_01, -999) AS id_01, "
              "coalesce(id_13, -999) AS id_13, coalesce(id_16, 'Unknown') AS id_16, "
              "coalesce(DeviceInfo, 'Unknown') AS DeviceInfo FROM base),\n"
              "vocab AS (SELECT col AS \"column\", value, CAST(row_number() OVER "
              "(PARTITION BY col ORDER BY value) - 1 AS BIGINT) AS code FROM ("
              "SELECT DISTINCT 'DeviceInfo' AS col, DeviceInfo AS value FROM v1f WHERE split = 'train' "
              "UNION SELECT DISTINCT 'P_emaildomain', P_emaildomain FROM v1f WHERE split = 'train' "
              "UNION SELECT DISTINCT 'id_16', id_16 FROM v1f WHERE split = 'train') v)")


def with_v1(body: str) -> str:
    return plain("").replace("-- result\n", "") + "," + _V1_FILLED + "\n-- result\n" + body


reg("fit_label_index", lambda s, sf: _v1(s, sf)[1],
    with_v1('SELECT "column", value, code FROM vocab'))


def _code(col):
    return (f"coalesce((SELECT code FROM vocab WHERE \"column\" = '{col}' AND value = v1f.{col}), "
            f"(SELECT code FROM vocab WHERE \"column\" = '{col}' AND value = 'Unknown')) AS {col}")


_V1_SELECT = ("SELECT split, TransactionDT, TransactionAmt, card1, " + _code("P_emaildomain")
              + ", addr1, isFraud, k, id_01, id_13, " + _code("id_16") + ", "
              + _code("DeviceInfo") + " FROM v1f")
reg("label_encode", lambda s, sf: _v1(s, sf)[0].select("split", *CATS),
    with_v1("SELECT split, DeviceInfo, P_emaildomain, id_16 FROM (" + _V1_SELECT + ") e"))
reg("v1_matrix", lambda s, sf: _v1(s, sf)[0], with_v1(_V1_SELECT),
    ["TransactionAmt", "addr1", "id_01", "id_13"])


# ---- P4 / P5 / O5 ------------------------------------------------------------------------
reg("select_final", _final, with_final("SELECT * FROM final"), ENRICHED_FLOATS)


def _top50(spark, sf):
    """The list comes from a document, as V1's ranking writes it."""
    from ..sources import io
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/riskfold-tables/top-{uuid.uuid4().hex[:12]}"
    io.write_json_doc(spark, path, {"top_features": TOP_RAW})
    return E.select_features(_final(spark, sf), "top50", io.load_top_features(spark, path))


_TOP50_COLS = list(dict.fromkeys(TOP_RAW + [c for c in TOP50_ENGINEERED
                                            if c != "amt_is_round"] + ["isFraud"]))
reg("select_top50", _top50, with_final("SELECT split, " + ", ".join(_TOP50_COLS) + " FROM final"),
    ["TransactionAmt", "addr1", "id_01", "amt_log", "amt_cents"])


def _v2(spark, sf):
    return prepare_categorical(_final(spark, sf), "all")


_V2 = ("SELECT * REPLACE (coalesce(DeviceInfo, 'missing') AS DeviceInfo, "
       "coalesce(P_emaildomain, 'missing') AS P_emaildomain, "
       "coalesce(id_16, 'missing') AS id_16) FROM final")
reg("v2_matrix", lambda s, sf: _v2(s, sf)[0], with_final(_V2), ENRICHED_FLOATS)


# ---- T2: out-of-fold rates of text columns and of a key column ----------------------------
ENCODED = ["DeviceInfo", "P_emaildomain", "id_16", "card1"]


def _target_encoding(spark, sf):
    final = _final(spark, sf)
    enc = TE.fit_target_encoding(final, ENCODED, ["TransactionID"])
    return enc.apply(final).select("TransactionID", "split", *[c + TE.SUFFIX for c in ENCODED])


def _rate_sql(col):
    def lab(what, part):
        return f"coalesce({what} FILTER (split = 'train') OVER ({part}), 0)"
    value, fold, both = f"PARTITION BY {col}", "PARTITION BY fold", f"PARTITION BY {col}, fold"
    s, n = "sum(isFraud)", "count(isFraud)"
    return (f"CASE WHEN split = 'train' THEN ({lab(s, value)} - {lab(s, both)} + 20.0::DOUBLE * "
            f"({lab(s, '')} - {lab(s, fold)}) / ({lab(n, '')} - {lab(n, fold)})) / ({lab(n, value)} - {lab(n, both)} + 20) "
            f"ELSE ({lab(s, value)} + 20.0::DOUBLE * {lab(s, '')} / {lab(n, '')}) / ({lab(n, value)} + 20) END AS {col}__rate")


reg("target_encoding", _target_encoding, with_final(
    "SELECT TransactionID, split, " + ", ".join(_rate_sql(c) for c in ENCODED) + " FROM (SELECT *, "
    "CASE WHEN split = 'train' THEN CAST('0x' || substr(md5(CAST(TransactionID AS VARCHAR)), 1, 8) AS BIGINT) % 5 END "
    "AS fold FROM final) t"), [c + TE.SUFFIX for c in ENCODED])


def _v2_cats(spark, sf):
    cats = _v2(spark, sf)[1]
    return spark.createDataFrame([(i, c) for i, c in enumerate(cats)], "position int, name string")


reg("cat_feature_list", _v2_cats, plain(
    "SELECT * FROM (VALUES (0, 'DeviceInfo'), (1, 'P_emaildomain'), (2, 'id_16')) "
    "t(position, name)"))


# ---- P11 / P12 ---------------------------------------------------------------------------
def _vout_sql() -> str:
    parts = [
        "SELECT split, 'rows' AS check_name, '*' AS name, CAST(count(*) AS DOUBLE) AS value, "
        "CAST(count(*) > 0 AS INTEGER) AS ok FROM final GROUP BY split",
        "SELECT split, 'target_present', 'isFraud', CAST(count(isFraud) AS DOUBLE), "
        "CAST(CASE WHEN split = 'test' THEN count(isFraud) = 0 ELSE count(isFraud) > 0 END "
        "AS INTEGER) FROM final GROUP BY split"]
    for f in ALL_ENGINEERED_FEATURES:
        parts.append(f"SELECT split, 'null_count', '{f}', CAST(count(*) - count({f}) AS DOUBLE), "
                     f"CAST(count({f}) > 0 AS INTEGER) FROM final GROUP BY split")
        parts.append(f"SELECT split, 'null_pct', '{f}', (count(*) - count({f})) * 100.0 / count(*), "
                     f"1 FROM final GROUP BY split")
    for f, lo, hi in (("hour", 0, 23), ("amt_log", 0, None), ("email_fraud_rate", 0, 1)):
        ok = f"coalesce(min({f}) >= {lo}, true)" + (
            f" AND coalesce(max({f}) <= {hi}, true)" if hi is not None else "")
        for agg in ("min", "max"):
            parts.append(f"SELECT split, '{agg}', '{f}', CAST({agg}({f}) AS DOUBLE), "
                         f"CAST({ok} AS INTEGER) FROM final GROUP BY split")
    return "\nUNION ALL ".join(parts)


reg("validate_output", lambda s, sf: V.validate_output(_final(s, sf)),
    with_final(_vout_sql()), ["value"])

_V2_NUMERIC = ["TransactionID", "TransactionDT", "TransactionAmt", "card1", "addr1", "k",
               "id_01", "id_13"] + [f for f in ALL_ENGINEERED_FEATURES]


def _vready_sql() -> str:
    parts = ["SELECT split, 'target_present' AS check_name, 'isFraud' AS name, "
             "CAST(count(isFraud) AS DOUBLE) AS value, CAST(CASE WHEN split = 'test' THEN "
             "count(isFraud) = 0 ELSE count(isFraud) > 0 END AS INTEGER) AS ok FROM v2 GROUP BY split"]
    for c in CATS:
        parts.append(f"SELECT split, 'cat_nulls', '{c}', CAST(count(*) - count({c}) AS DOUBLE), "
                     f"CAST(count(*) = count({c}) AS INTEGER) FROM v2 GROUP BY split")
        parts.append(f"SELECT split, 'cat_type', '{c}', 1.0, 1 FROM v2 GROUP BY split")
    for c in _V2_NUMERIC:
        parts.append(f"SELECT split, 'numeric_nulls', '{c}', CAST(count(*) - count({c}) AS DOUBLE), "
                     "1 FROM v2 GROUP BY split")
    return "\nUNION ALL ".join(parts)


reg("validate_ready", lambda s, sf: _v2(s, sf)[2],
    with_final("").replace("-- result\n", "").rstrip() + ",\nv2 AS (" + _V2 + ")\n-- result\n"
    + _vready_sql(), ["value"])


# ---- S4 / S6 -----------------------------------------------------------------------------
def _scan_summary(spark, sf):
    df = _v2(spark, sf)[0].where(F.col("split").isin("train", "val"))
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"),
                                   F.avg("isFraud").alias("fraud_rate"))


reg("train_scan_summary", _scan_summary, with_final(
    "SELECT split, count(*) AS n_rows, avg(isFraud) AS fraud_rate FROM final "
    "WHERE split IN ('train', 'val') GROUP BY split"), ["fraud_rate"])


def _manifest(spark, sf):
    from ..sources.io import split_manifest
    return split_manifest(_final(spark, sf))


_N_FINAL = len(RAW) + len(ALL_ENGINEERED_FEATURES) + 1


def _published(spark, sf):
    """The enriched splits written once, checked as written, published and read back."""
    from ..sources import io
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/riskfold-tables/published-{uuid.uuid4().hex[:12]}"
    io.publish_splits(_final(spark, sf), path, V.validate_output)
    return io.read_published(spark, path)


reg("publish_splits", _published, with_final("SELECT * FROM final"), ENRICHED_FLOATS)


# ---- S1: a CSV with malformed lines -------------------------------------------------------
_LINE = ("CASE WHEN event_id % 11 = 0 THEN concat(event_id, ',', user_id, ',', event_type, ',extra') "
         "WHEN event_id % 13 = 0 THEN concat(event_id, ',', user_id) "
         "WHEN event_id % 17 = 0 THEN concat(event_id, ',u', user_id, ',', event_type) "
         "WHEN event_id % 19 = 0 THEN concat(event_id, ',NA,', event_type) "
         "ELSE concat(event_id, ',', user_id, ',', event_type) END")


def _quarantine(spark, sf):
    """Every event as a line of a CSV, some broken by rule: rows read and set aside."""
    from ..sources import io
    from ..sources.fixtures import read_table
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/riskfold-tables/lines-{uuid.uuid4().hex[:12]}"
    lines = read_table(spark, sf, "events").select(F.expr(_LINE).alias("event_id,user_id,event_type"))
    lines.write.option("header", True).option("sep", "\u0001").csv(path)
    rows, bad = io.read_csv_quarantine(spark, path, T.StructType.fromDDL(
        "event_id LONG, user_id LONG, event_type STRING"))
    good = rows.agg(F.lit("read").alias("outcome"), F.lit(None).cast("string").alias("column_name"),
                    F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"), F.count("user_id").alias("users"))
    aside = bad.groupBy(F.col("reason").alias("outcome"), F.col("column").alias("column_name")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.substring_index("line", ",", 1).cast("long")).alias("ids"),
        F.lit(0).cast("long").alias("users"))
    return good.unionByName(aside)


reg("csv_quarantine", _quarantine, """
SELECT CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN 'fields' WHEN event_id % 17 = 0 THEN 'value'
       ELSE 'read' END AS outcome,
       CASE WHEN event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 = 0 THEN 'user_id' END AS column_name,
       count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids,
       CAST(sum(CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 OR event_id % 17 = 0 OR event_id % 19 = 0 THEN 0
                ELSE 1 END) AS BIGINT) AS users
FROM events GROUP BY 1, 2
""")
reg("split_manifest", _manifest, with_final(
    f"SELECT split, count(*) AS n_rows, CASE WHEN split = 'test' THEN {_N_FINAL - 1} "
    f"ELSE {_N_FINAL} END AS n_cols FROM final GROUP BY split"))
