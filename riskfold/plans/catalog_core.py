"""Registered queries, part 1: base build, feature fit and apply.

Every entry is ``key -> (spark_fn, oracle_sql, round_cols)``. ``spark_fn``
takes (spark, sf_dir) and returns a DataFrame built by the library;
``oracle_sql`` is an independent DuckDB statement over the raw tables;
``round_cols`` are rounded to 6 digits on both sides before comparison.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import ALL_ENGINEERED_FEATURES
from ..operators import base as ops
from ..sources.bucketed import co_bucketed
from ..sources.fixtures import BASE_COLUMNS, MERGED_COLUMNS, duckdb_prefix
from .fixture import fixture

# ---- oracle building blocks ------------------------------------------------------
# Fixed values of the fixture: high_freq 50, card_device_high 10 (FIXTURES §3).
PARAMS_SQL = """p_card AS (SELECT card1, count(TransactionAmt) AS n, avg(TransactionAmt) AS m,
  coalesce(stddev_samp(TransactionAmt), 0.0) AS s,
  CAST(count(TransactionAmt) >= 50 AS INTEGER) AS hf,
  count(DISTINCT DeviceInfo) AS dd
  FROM train WHERE card1 IS NOT NULL GROUP BY card1),
p_sc AS (SELECT quantile_cont(TransactionAmt, 0.5) AS med, avg(isFraud) AS gr FROM train),
p_email AS (SELECT P_emaildomain, avg(isFraud) AS r, count(isFraud) AS n FROM train
  WHERE P_emaildomain IS NOT NULL GROUP BY P_emaildomain),
p_dev AS (SELECT DeviceInfo, count(*) AS n FROM train WHERE DeviceInfo IS NOT NULL
  GROUP BY DeviceInfo),
p_addr AS (SELECT addr1, count(DISTINCT card1) AS d FROM train WHERE addr1 IS NOT NULL
  GROUP BY addr1),
p_ce AS (SELECT card1, P_emaildomain, avg(isFraud) AS r, true AS hit FROM train
  GROUP BY card1, P_emaildomain),
p_uid AS (SELECT card1, addr1, avg(isFraud) AS r, true AS hit FROM train GROUP BY card1, addr1),
p_q AS (SELECT DISTINCT unnest(quantile_cont(TransactionAmt,
  [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM train),
p_inner AS (SELECT e FROM p_q WHERE e > (SELECT min(e) FROM p_q)
  AND e < (SELECT max(e) FROM p_q)),
enriched0 AS (SELECT b.*,
  CAST((b.TransactionDT // 3600) % 24 AS INTEGER) AS hour,
  CAST((b.TransactionDT // 86400) % 7 AS INTEGER) AS day_of_week,
  CAST(b.TransactionDT // 86400 AS BIGINT) AS days_since_start,
  CAST((b.TransactionDT // 86400) % 7 >= 5 AS INTEGER) AS is_weekend,
  CAST((b.TransactionDT // 3600) % 24 BETWEEN 5 AND 10 AS INTEGER) AS is_high_risk_hour,
  CAST(CASE WHEN (b.TransactionDT // 3600) % 24 <= 4 THEN 0
            WHEN (b.TransactionDT // 3600) % 24 <= 11 THEN 1
            WHEN (b.TransactionDT // 3600) % 24 <= 16 THEN 2 ELSE 3 END AS INTEGER) AS time_of_day,
  ln(1 + b.TransactionAmt) AS amt_log,
  round_even((b.TransactionAmt - floor(b.TransactionAmt)) * 100.0, 0) / 100.0 AS amt_cents,
  CAST(coalesce(b.TransactionAmt < 26, false) AS INTEGER) AS amt_is_very_low,
  CAST(coalesce(b.TransactionAmt > 280, false) AS INTEGER) AS amt_is_high,
  CAST(CASE WHEN b.TransactionAmt IS NULL THEN NULL
       ELSE (SELECT count(*) FROM p_inner WHERE b.TransactionAmt > e) END AS INTEGER) AS amt_bucket,
  CAST(b.id_01 IS NOT NULL AS INTEGER) AS id_data_present,
  CAST(b.id_13 IS NULL AS INTEGER) AS id_13_was_null,
  CAST(b.id_16 IS NULL AS INTEGER) AS id_16_was_null,
  CASE WHEN c.card1 IS NOT NULL THEN c.n ELSE 1 END AS card1_txn_count,
  CASE WHEN c.card1 IS NOT NULL THEN c.m ELSE sc.med END AS card1_mean_amt,
  CASE WHEN c.card1 IS NOT NULL THEN c.s ELSE 0.0 END AS card1_std_amt,
  CASE WHEN c.card1 IS NOT NULL THEN c.hf ELSE 0 END AS card1_is_high_freq,
  CAST(CASE WHEN c.card1 IS NOT NULL THEN c.dd ELSE 0 END > 10 AS INTEGER) AS card_device_is_high,
  CASE WHEN em.P_emaildomain IS NOT NULL THEN em.r ELSE sc.gr END AS email_fraud_rate,
  CASE WHEN em.P_emaildomain IS NOT NULL THEN em.n ELSE 1 END AS email_txn_count,
  CASE WHEN b.DeviceInfo IS NULL THEN NULL WHEN dv.DeviceInfo IS NOT NULL THEN dv.n
       ELSE 1 END AS device_txn_count,
  CASE WHEN b.addr1 IS NULL THEN NULL
       ELSE CAST(coalesce(ad.d, 0) = 1 AS INTEGER) END AS addr_is_unique,
  CASE WHEN ce.hit THEN ce.r ELSE sc.gr END AS card_email_pair_fraud_rate,
  CASE WHEN u.hit THEN u.r ELSE sc.gr END AS uid_fraud_rate,
  c.card1 IS NOT NULL AS _hit_card, em.P_emaildomain IS NOT NULL AS _hit_email,
  coalesce(ce.hit, false) AS _hit_card_email, coalesce(u.hit, false) AS _hit_uid
  FROM base b
  LEFT JOIN p_card c ON b.card1 = c.card1
  LEFT JOIN p_email em ON b.P_emaildomain = em.P_emaildomain
  LEFT JOIN p_dev dv ON b.DeviceInfo = dv.DeviceInfo
  LEFT JOIN p_addr ad ON b.addr1 = ad.addr1
  LEFT JOIN p_ce ce ON b.card1 IS NOT DISTINCT FROM ce.card1
       AND b.P_emaildomain IS NOT DISTINCT FROM ce.P_emaildomain
  LEFT JOIN p_uid u ON b.card1 IS NOT DISTINCT FROM u.card1
       AND b.addr1 IS NOT DISTINCT FROM u.addr1
  CROSS JOIN p_sc sc),
enriched AS (SELECT * EXCLUDE (_hit_card, _hit_email, _hit_card_email, _hit_uid),
  CAST(CASE WHEN amt_cents = 0 THEN 0 WHEN amt_cents = 0.95 THEN 1 ELSE 2 END AS INTEGER)
    AS amt_cents_type,
  CASE WHEN TransactionAmt IS NULL OR card1_mean_amt IS NULL THEN NULL
       ELSE least(greatest(TransactionAmt / (card1_mean_amt + 1), 0.0), 500.0) END
    AS amt_to_card1_mean_ratio,
  CASE WHEN TransactionAmt IS NULL OR card1_std_amt IS NULL THEN NULL
       ELSE least(greatest(TransactionAmt / (card1_std_amt + 1), 0.0), 500.0) END
    AS amt_to_card1_std_ratio
  FROM enriched0)"""

ENRICHED_FLOATS = ["TransactionAmt", "addr1", "id_01", "id_13", "amt_log", "amt_cents",
                   "card1_mean_amt", "card1_std_amt", "email_fraud_rate",
                   "amt_to_card1_mean_ratio", "amt_to_card1_std_ratio",
                   "card_email_pair_fraud_rate", "uid_fraud_rate"]


def with_params(sql: str) -> str:
    return duckdb_prefix(PARAMS_SQL) + sql


def plain(sql: str) -> str:
    return duckdb_prefix() + sql


def _enriched(spark, sf):
    return fixture(spark, sf).enriched


def _feature_cols(*cols):
    def fn(spark, sf):
        return _enriched(spark, sf).select("TransactionID", *cols)
    return fn


Q: dict = {}


def reg(key, fn, sql, floats=()):
    Q[key] = (fn, sql, list(floats))


# ---- features (apply side) -----------------------------------------------------------
_CARD = ["split", "card1_txn_count", "card1_mean_amt", "card1_std_amt", "card1_is_high_freq"]
reg("card1_features", _feature_cols(*_CARD),
    with_params(f"SELECT TransactionID, {', '.join(_CARD)} FROM enriched"),
    ["card1_mean_amt", "card1_std_amt"])
reg("ratio_features", _feature_cols("amt_to_card1_mean_ratio", "amt_to_card1_std_ratio"),
    with_params("SELECT TransactionID, amt_to_card1_mean_ratio, amt_to_card1_std_ratio "
                "FROM enriched"),
    ["amt_to_card1_mean_ratio", "amt_to_card1_std_ratio"])
reg("email_features", _feature_cols("email_fraud_rate", "email_txn_count"),
    with_params("SELECT TransactionID, email_fraud_rate, email_txn_count FROM enriched"),
    ["email_fraud_rate"])
reg("device_txn_count", _feature_cols("device_txn_count"),
    with_params("SELECT TransactionID, device_txn_count FROM enriched"))
reg("card_device_is_high", _feature_cols("card_device_is_high"),
    with_params("SELECT TransactionID, card_device_is_high FROM enriched"))
reg("addr_is_unique", _feature_cols("addr_is_unique"),
    with_params("SELECT TransactionID, addr_is_unique FROM enriched"))
reg("card_email_pair_rate", _feature_cols("card_email_pair_fraud_rate"),
    with_params("SELECT TransactionID, card_email_pair_fraud_rate FROM enriched"),
    ["card_email_pair_fraud_rate"])
reg("uid_fraud_rate", _feature_cols("uid_fraud_rate"),
    with_params("SELECT TransactionID, uid_fraud_rate FROM enriched"), ["uid_fraud_rate"])
_TIME = ["hour", "day_of_week", "days_since_start", "is_weekend", "is_high_risk_hour",
         "time_of_day"]
reg("time_features", _feature_cols(*_TIME),
    with_params(f"SELECT TransactionID, {', '.join(_TIME)} FROM enriched"))
_AMT = ["amt_log", "amt_cents", "amt_cents_type", "amt_is_very_low", "amt_is_high",
        "amt_bucket"]
reg("amount_features", _feature_cols(*_AMT),
    with_params(f"SELECT TransactionID, {', '.join(_AMT)} FROM enriched"),
    ["amt_log", "amt_cents"])
_NULLF = ["id_data_present", "id_13_was_null", "id_16_was_null"]
reg("null_flags", _feature_cols(*_NULLF),
    with_params(f"SELECT TransactionID, {', '.join(_NULLF)} FROM enriched"))
reg("enriched_features", _enriched,
    with_params("SELECT * FROM enriched"), ENRICHED_FLOATS)


def _enriched_shuffled(spark, sf):
    """The flagship with a zero broadcast limit: every lookup block is
    resolved on distinct key combinations and joined back once (the plan
    used when fitted tables outgrow broadcast)."""
    from dataclasses import replace
    from . import features_job as fj
    fxt = fixture(spark, sf)
    return fj.apply(fxt.base, replace(fxt.params, broadcast_limit=0))


reg("enriched_features_shuffled", _enriched_shuffled,
    with_params("SELECT * FROM enriched"), ENRICHED_FLOATS)


def _stream_features(spark, sf):
    from ..streaming.apply_stream import stream_features
    fxt = fixture(spark, sf)
    fxt.base  # builds the replayable base plan
    return stream_features(spark, sf, fxt.base_plan, fxt.params)


# The same features produced by a Structured Streaming query; same oracle
reg("stream_features", _stream_features,
    with_params("SELECT * FROM enriched"), ENRICHED_FLOATS)


def _stream_features_batches(spark, sf):
    """R1 with a zero broadcast limit: the same path and schema, each batch with
    the key-combination plan (fitted tables beyond broadcast)."""
    from dataclasses import replace
    from ..streaming.apply_stream import stream_features
    fxt = fixture(spark, sf)
    fxt.base
    return stream_features(spark, sf, fxt.base_plan, replace(fxt.params, broadcast_limit=0))


reg("stream_features_batches", _stream_features_batches,
    with_params("SELECT * FROM enriched"), ENRICHED_FLOATS)


def _unseen(spark, sf):
    from . import features_job as fj
    fxt = fixture(spark, sf)
    hits = fj.apply(fxt.base, fxt.params, keep_hits=True)
    names = ["card", "email", "card_email", "uid"]
    return (hits.groupBy("split").agg(*[
        F.sum((~F.col(f"_hit_{n}")).cast("long")).alias(n) for n in names])
        .selectExpr("split", "stack(4, " + ", ".join(f"'{n}', {n}" for n in names)
                    + ") AS (lookup, n_unseen)"))


reg("unseen_keys", _unseen, with_params("""
SELECT split, lookup, CAST(sum(CASE WHEN hit THEN 0 ELSE 1 END) AS BIGINT) AS n_unseen
FROM (SELECT split, 'card' AS lookup, _hit_card AS hit FROM enriched0
      UNION ALL SELECT split, 'email', _hit_email FROM enriched0
      UNION ALL SELECT split, 'card_email', _hit_card_email FROM enriched0
      UNION ALL SELECT split, 'uid', _hit_uid FROM enriched0) t
GROUP BY split, lookup"""))


# ---- fit side -----------------------------------------------------------------------
def _lookup_df(name, *cols):
    def fn(spark, sf):
        return fixture(spark, sf).params.lookups[name].df.select(*cols)
    return fn


reg("fit_card1", _lookup_df("card", "card1", "card1_txn_count", "card1_mean_amt",
                            "card1_std_amt", "card1_is_high_freq", "device_degree"),
    with_params("SELECT card1, n AS card1_txn_count, m AS card1_mean_amt, "
                "s AS card1_std_amt, hf AS card1_is_high_freq, dd AS device_degree FROM p_card"),
    ["card1_mean_amt", "card1_std_amt"])
reg("fit_card_device_degree", _lookup_df("card", "card1", "device_degree"),
    with_params("SELECT card1, dd AS device_degree FROM p_card"))
reg("fit_email", _lookup_df("email", "P_emaildomain", "email_fraud_rate", "email_txn_count"),
    with_params("SELECT P_emaildomain, r AS email_fraud_rate, n AS email_txn_count "
                "FROM p_email"), ["email_fraud_rate"])
reg("fit_device_count", _lookup_df("device", "DeviceInfo", "device_txn_count"),
    with_params("SELECT DeviceInfo, n AS device_txn_count FROM p_dev"))
reg("fit_addr_degree", _lookup_df("addr", "addr1", "card_degree"),
    with_params("SELECT addr1, d AS card_degree FROM p_addr"))
reg("fit_card_email_rate", _lookup_df("card_email", "card1", "P_emaildomain", "fraud_rate"),
    with_params("SELECT card1, P_emaildomain, r AS fraud_rate FROM p_ce"), ["fraud_rate"])
reg("fit_uid_rate", _lookup_df("uid", "card1", "addr1", "fraud_rate"),
    with_params("SELECT card1, addr1, r AS fraud_rate FROM p_uid"), ["fraud_rate"])


def _median(spark, sf):
    p = fixture(spark, sf).params
    return spark.createDataFrame([(p.median_amt, p.global_rate)],
                                 "median_amt double, global_fraud_rate double")


reg("fit_median", _median,
    with_params("SELECT med AS median_amt, gr AS global_fraud_rate FROM p_sc"),
    ["median_amt", "global_fraud_rate"])


def _edges(spark, sf):
    e = fixture(spark, sf).params.edges
    inner = e[1:-1] if len(e) >= 2 else []
    return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(inner)],
                                 "i int, edge double")


reg("fit_decile_edges", _edges,
    with_params("SELECT CAST(row_number() OVER (ORDER BY e) AS INTEGER) AS i, e AS edge "
                "FROM p_inner"), ["edge"])


def _param_summary(spark, sf):
    p = fixture(spark, sf).params
    rows = [(k, v.rows) for k, v in p.lookups.items()]
    rows.append(("amt_edges", max(len(p.edges) - 2, 0)))
    return spark.createDataFrame(rows, "param_table string, n_entries long")


reg("param_summary", _param_summary, with_params("""
SELECT 'card' AS param_table, (SELECT count(*) FROM p_card) AS n_entries
UNION ALL SELECT 'email', (SELECT count(*) FROM p_email)
UNION ALL SELECT 'device', (SELECT count(*) FROM p_dev)
UNION ALL SELECT 'addr', (SELECT count(*) FROM p_addr)
UNION ALL SELECT 'card_email', (SELECT count(*) FROM p_ce)
UNION ALL SELECT 'uid', (SELECT count(*) FROM p_uid)
UNION ALL SELECT 'amt_edges', (SELECT count(*) FROM p_inner)"""))


# ---- base build -----------------------------------------------------------------------
reg("merge_identity", lambda spark, sf: fixture(spark, sf).merged,
    plain("SELECT * FROM merged"))


def _matched(spark, sf):
    fxt = fixture(spark, sf)
    m = ops.matched_identity(fxt.txn, fxt.idt)
    return m.agg(F.count(F.lit(1)).alias("n_matched"))


reg("matched_identity", _matched,
    plain("SELECT count(*) AS n_matched FROM idt WHERE TransactionID IN "
          "(SELECT TransactionID FROM txn)"))


def _co_bucketed(spark, sf):
    """The transactions and identities in buckets of the id, written once per session and folder."""
    fxt = fixture(spark, sf)
    if fxt.bucketed is None:
        fxt.bucketed = co_bucketed(fxt.txn, fxt.idt, "TransactionID")
    return [t.read() for t in fxt.bucketed]


reg("merge_co_bucketed", lambda spark, sf: ops.merge_identity(*_co_bucketed(spark, sf)),
    plain("SELECT * FROM merged"))


def _matched_co_bucketed(spark, sf):
    m = ops.matched_identity(*_co_bucketed(spark, sf))
    return m.agg(F.count(F.lit(1)).alias("n_matched"))


reg("matched_co_bucketed", _matched_co_bucketed,
    plain("SELECT count(*) AS n_matched FROM idt WHERE TransactionID IN "
          "(SELECT TransactionID FROM txn)"))


def _drop_high_null(spark, sf):
    from ..config import FIXTURE_BASE
    return ops.drop_high_null(fixture(spark, sf).merged, FIXTURE_BASE.null_threshold)


reg("drop_high_null", _drop_high_null, plain("SELECT * EXCLUDE (id_25) FROM merged"))


_MIXED = ("SELECT TransactionID, "
          "CASE WHEN TransactionID % 20 = 0 THEN 'n/a' ELSE CAST(k AS STRING) END AS k_text, "
          "CASE WHEN TransactionID % 5 = 0 THEN 'none' ELSE CAST(card1 AS STRING) END AS card_text, "
          "P_emaildomain FROM {t}")


def _fix_dtypes(spark, sf):
    txn = fixture(spark, sf).txn
    mixed = spark.sql(_MIXED.format(t="{t}"), t=txn)
    return ops.fix_dtypes(mixed, 0.90)


reg("fix_dtypes", _fix_dtypes, plain(
    "SELECT TransactionID, TRY_CAST(k_text AS DOUBLE) AS k_text, card_text, P_emaildomain "
    "FROM (" + _MIXED.format(t="txn") + ") m"))


def _dedupe(spark, sf):
    return ops.drop_duplicates(fixture(spark, sf).txn.select("card1", "P_emaildomain", "isFraud"))


reg("drop_duplicates", _dedupe,
    plain("SELECT DISTINCT card1, P_emaildomain, isFraud FROM txn"))


def _dup_count(spark, sf):
    return ops.duplicate_count(fixture(spark, sf).txn.select("card1", "P_emaildomain", "isFraud"))


reg("duplicate_count", _dup_count, plain(
    "SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT card1, "
    "P_emaildomain, isFraud FROM txn) d) AS n_duplicates FROM txn"))


reg("time_split", lambda spark, sf: fixture(spark, sf).base.select("TransactionID", "split"),
    plain("SELECT TransactionID, split FROM base"))
reg("split_summary", lambda spark, sf: ops.split_summary(fixture(spark, sf).base),
    plain("""SELECT split, count(*) AS n_rows, min(TransactionDT) AS min_time,
  max(TransactionDT) AS max_time, avg(isFraud) AS fraud_rate,
  CAST(abs(avg(isFraud) - (SELECT avg(isFraud) FROM base)) > 0.015 AS INTEGER) AS drift_flag
FROM base GROUP BY split"""), ["fraud_rate"])
reg("build_base", lambda spark, sf: fixture(spark, sf).base, plain("SELECT * FROM base"),
    ["TransactionAmt", "addr1", "id_01", "id_13"])

assert set(BASE_COLUMNS) <= set(MERGED_COLUMNS)
assert len(ALL_ENGINEERED_FEATURES) == 28
