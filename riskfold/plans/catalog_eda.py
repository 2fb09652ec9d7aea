"""Registered queries, part 4: exploratory aggregates over the base table.

The notebook works on the whole labelled table; here that is ``base`` (all
splits). HAVING limits are the notebook's (>100, >50) unless stated.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as fxf
from ..operators import profile as P
from ..operators.selection import exact_quantiles
from ..operators.weighted import weighted_stats
from ..session import materialize
from ..sources.fixtures import duckdb_prefix
from .fixture import fixture

Q: dict = {}


def reg(key, fn, sql, floats=()):
    Q[key] = (fn, sql, list(floats))


def _base(spark, sf):
    return fixture(spark, sf).base


def plain(body: str) -> str:
    return duckdb_prefix() + body


def ctes(extra: str, body: str) -> str:
    return duckdb_prefix(extra) + body


Y = "isFraud"
AMT = "TransactionAmt"
COUNT_BINS = ([0, 1, 5, 20, 100, 99999], ["1 txn", "2-5", "6-20", "21-100", "100+"])
UID_BINS = ([0, 1, 3, 10, 50, 99999], ["1", "2-3", "4-10", "11-50", "50+"])
DEV_BINS = ([0, 1, 5, 20, 100, 99999], ["1", "2-5", "6-20", "21-100", "100+"])


def _sql_bins(x: str, bins) -> str:
    edges, labels = bins
    parts = " ".join(f"WHEN {x} > {edges[i]} AND {x} <= {edges[i + 1]} THEN '{labels[i]}'"
                     for i in range(len(labels)))
    return f"CASE {parts} END"


_DESCRIBE_COLS = "count, mean, std, min, q25, q50, q75, max"
_DESC_FLOATS = ["mean", "std", "min", "q25", "q50", "q75", "max"]


def _sql_describe(x: str, src: str, by: str | None = None) -> str:
    g = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    return (f"SELECT {g}count({x}) AS count, avg({x}) AS mean, stddev_samp({x}) AS std, "
            f"CAST(min({x}) AS DOUBLE) AS min, quantile_cont({x}, 0.25) AS q25, "
            f"quantile_cont({x}, 0.5) AS q50, quantile_cont({x}, 0.75) AS q75, "
            f"CAST(max({x}) AS DOUBLE) AS max FROM {src}{grp}")


# ---- E1-E9 ------------------------------------------------------------------------------
def _time_profile(spark, sf):
    b = _base(spark, sf)
    t = F.col("TransactionDT")
    return b.agg((F.count(F.lit(1)) - F.count(t)).alias("n_null"), F.min(t).alias("min_dt"),
                 F.max(t).alias("max_dt"),
                 ((F.max(t) - F.min(t)) / 86400.0).alias("day_span"))


reg("eda_time_profile", _time_profile, plain(
    "SELECT count(*) - count(TransactionDT) AS n_null, min(TransactionDT) AS min_dt, "
    "max(TransactionDT) AS max_dt, (max(TransactionDT) - min(TransactionDT)) / 86400.0 "
    "AS day_span FROM base"), ["day_span"])
reg("eda_rate_by_hour", lambda s, sf: P.rate_by(_base(s, sf), fxf.hour("TransactionDT"), Y, "hour"),
    plain("SELECT CAST((TransactionDT // 3600) % 24 AS INTEGER) AS hour, avg(isFraud) AS "
          "fraud_rate, count(*) AS n FROM base GROUP BY 1"), ["fraud_rate"])
reg("eda_rate_by_dow",
    lambda s, sf: P.rate_by(_base(s, sf), fxf.day_of_week("TransactionDT"), Y, "day_of_week"),
    plain("SELECT CAST((TransactionDT // 86400) % 7 AS INTEGER) AS day_of_week, avg(isFraud) "
          "AS fraud_rate, count(*) AS n FROM base GROUP BY 1"), ["fraud_rate"])


def _amt_summary(spark, sf):
    b = _base(spark, sf)
    a = F.col(AMT)
    row = b.agg((F.count(F.lit(1)) - F.count(a)).alias("n_null"), F.min(a).alias("min"),
                F.max(a).alias("max"), F.avg(a).alias("mean"),
                P.bias_corrected_skew(AMT).alias("skew"))
    med = exact_quantiles(b, AMT, [0.5])[0]
    return row.withColumn("median", F.lit(med).cast("double"))


reg("eda_amt_summary", _amt_summary, plain(
    "SELECT count(*) - count(TransactionAmt) AS n_null, min(TransactionAmt) AS min, "
    "max(TransactionAmt) AS max, avg(TransactionAmt) AS mean, "
    "skewness(TransactionAmt) AS skew, quantile_cont(TransactionAmt, 0.5) AS median FROM base"),
    ["min", "max", "mean", "skew", "median"])


def _hist(spark, sf):
    b = _base(spark, sf)
    raw = P.equal_width_hist(b, F.col(AMT)).withColumn("kind", F.lit("raw"))
    log = P.equal_width_hist(b, F.log1p(AMT)).withColumn("kind", F.lit("log1p"))
    return raw.unionByName(log).select("kind", "bin", "n")


_HIST = """SELECT kind, CAST(least(floor((v - lo) / w), 99) AS INTEGER) AS bin, count(*) AS n
FROM (SELECT 'raw' AS kind, TransactionAmt AS v FROM base WHERE TransactionAmt IS NOT NULL
      UNION ALL SELECT 'log1p', ln(1 + TransactionAmt) FROM base WHERE TransactionAmt IS NOT NULL) x
JOIN (SELECT kind, min(v) AS lo, CASE WHEN max(v) > min(v) THEN (max(v) - min(v)) / 100
      ELSE 1.0 END AS w FROM (SELECT 'raw' AS kind, TransactionAmt AS v FROM base
      UNION ALL SELECT 'log1p', ln(1 + TransactionAmt) FROM base) y GROUP BY kind) r USING (kind)
GROUP BY kind, bin"""
reg("eda_histogram", _hist, plain(_HIST))


def _rate_by_decile(spark, sf):
    from .features_job import decile_edges
    from ..config import FeatureConfig
    b = _base(spark, sf)
    edges = decile_edges(b, FeatureConfig())
    bucket = fxf.right_closed_bucket(AMT, edges[1:-1])
    return P.rate_by(b, bucket, Y, "amt_bucket")


reg("eda_rate_by_decile", _rate_by_decile, ctes(
    "q AS (SELECT DISTINCT unnest(quantile_cont(TransactionAmt, [0.0, 0.1, 0.2, 0.3, 0.4, "
    "0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM base),\n"
    "qi AS (SELECT e FROM q WHERE e > (SELECT min(e) FROM q) AND e < (SELECT max(e) FROM q))",
    "SELECT CAST(CASE WHEN TransactionAmt IS NULL THEN NULL ELSE (SELECT count(*) FROM qi "
    "WHERE TransactionAmt > e) END AS INTEGER) AS amt_bucket, avg(isFraud) AS fraud_rate, "
    "count(*) AS n FROM base GROUP BY 1"), ["fraud_rate"])

_CENTS_SQL = "round_even((TransactionAmt - floor(TransactionAmt)) * 100.0, 0) / 100.0"


def _cents_top(spark, sf):
    b = _base(spark, sf).where(F.col(AMT).isNotNull())
    return (b.groupBy(fxf.cents(AMT).alias("cents")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), F.col("cents")).limit(10))


reg("eda_cents_top10", _cents_top, plain(
    f"SELECT {_CENTS_SQL} AS cents, count(*) AS n FROM base WHERE TransactionAmt IS NOT NULL "
    "GROUP BY 1 ORDER BY n DESC, cents LIMIT 10"), ["cents"])
reg("eda_rate_round", lambda s, sf: P.rate_by(
    _base(s, sf), F.coalesce(F.pmod(F.col(AMT), F.lit(1.0)) == 0, F.lit(False)).cast("int"),
    Y, "is_round"),
    plain("SELECT CAST(coalesce(TransactionAmt - floor(TransactionAmt) = 0, false) AS INTEGER) "
          "AS is_round, avg(isFraud) AS fraud_rate, count(*) AS n FROM base GROUP BY 1"),
    ["fraud_rate"])


def _cohorts(spark, sf):
    b = _base(spark, sf)
    a, y = F.col(AMT), F.col(Y)
    return b.agg(F.avg(F.when(a < 26, y)).alias("rate_very_low"),
                 F.avg(F.when(a > 280, y)).alias("rate_high"),
                 F.count(F.when(a < 26, y)).alias("n_very_low"),
                 F.count(F.when(a > 280, y)).alias("n_high"))


reg("eda_rate_cohorts", _cohorts, plain(
    "SELECT avg(isFraud) FILTER (WHERE TransactionAmt < 26) AS rate_very_low, "
    "avg(isFraud) FILTER (WHERE TransactionAmt > 280) AS rate_high, "
    "count(isFraud) FILTER (WHERE TransactionAmt < 26) AS n_very_low, "
    "count(isFraud) FILTER (WHERE TransactionAmt > 280) AS n_high FROM base"),
    ["rate_very_low", "rate_high"])
reg("eda_rate_cents_type", lambda s, sf: P.rate_by(
    _base(s, sf), fxf.cents_type(fxf.cents(AMT)), Y, "amt_cents_type"),
    plain(f"SELECT CAST(CASE WHEN {_CENTS_SQL} = 0 THEN 0 WHEN {_CENTS_SQL} = 0.95 THEN 1 "
          "ELSE 2 END AS INTEGER) AS amt_cents_type, avg(isFraud) AS fraud_rate, count(*) AS n "
          "FROM base GROUP BY 1"), ["fraud_rate"])

# ---- E10-E13 -----------------------------------------------------------------------------
_NULLABLE = ["TransactionID", "TransactionDT", "TransactionAmt", "card1", "P_emaildomain",
             "addr1", "k", "id_01", "id_13", "id_16", "DeviceInfo"]


def _null_gap(spark, sf):
    b = _base(spark, sf)
    cols = [c for c in b.columns if c not in (Y, "split")]
    y = F.col(Y)
    aggs = []
    for c in cols:
        isn = F.col(c).isNull().cast("double")
        aggs += [F.count(F.when(F.col(c).isNull(), 1)).alias(f"n_{c}"),
                 F.avg(F.when(y == 1, isn)).alias(f"f_{c}"),
                 F.avg(F.when(y == 0, isn)).alias(f"l_{c}")]
    wide = b.agg(*aggs)
    parts = ", ".join(f"'{c}', n_{c}, f_{c}, l_{c}" for c in cols)
    long = wide.selectExpr(f"stack({len(cols)}, {parts}) AS (column_name, n_null, fr, lr)")
    return long.where(F.col("n_null") > 0).select(
        "column_name", F.round("fr", 3).alias("fraud_null_rate"),
        F.round("lr", 3).alias("legit_null_rate"),
        F.round(F.abs(F.col("fr") - F.col("lr")), 3).alias("diff"))


reg("eda_null_gap", _null_gap, plain("SELECT column_name, round(fr, 3) AS fraud_null_rate, "
    "round(lr, 3) AS legit_null_rate, round(abs(fr - lr), 3) AS diff FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS n_null, "
        f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) FILTER (WHERE isFraud = 1) AS fr, "
        f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) FILTER (WHERE isFraud = 0) AS lr "
        "FROM base" for c in _NULLABLE) + ") t WHERE n_null > 0"),
    ["fraud_null_rate", "legit_null_rate", "diff"])

_ID_COLS = ["id_01", "id_13", "id_16"]


def _null_corr(spark, sf):
    b = _base(spark, sf)
    return P.null_indicator_corr(b, [c for c in b.columns if c.startswith("id_")])


reg("eda_null_corr", _null_corr, plain(" UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, CASE WHEN isnan(r) THEN NULL ELSE r END AS corr "
    f"FROM (SELECT corr(CAST({a} IS NULL AS DOUBLE), CAST({b} IS NULL AS DOUBLE)) AS r FROM base) x"
    for a in _ID_COLS for b in _ID_COLS)), ["corr"])


def _null_block(spark, sf):
    b = _base(spark, sf)
    ids = [c for c in b.columns if c.startswith("id_")]
    all_null = F.lit(True)
    for c in ids:
        all_null = all_null & F.col(c).isNull()
    return b.agg(F.avg((all_null == F.col("id_01").isNull()).cast("double")).alias("coverage"))


reg("eda_null_block", _null_block, plain(
    "SELECT avg(CAST(((id_01 IS NULL AND id_13 IS NULL AND id_16 IS NULL) = (id_01 IS NULL)) "
    "AS DOUBLE)) AS coverage FROM base"), ["coverage"])

#: The fixture has no second card column: one is derived, NULL for some rows.
_CARD2 = "CASE WHEN k % 7 <> 0 THEN card1 % 100 END"
_KEYS = ["card1", "card2", "addr1", "P_emaildomain"]


def _key_profile(spark, sf):
    """One scan: the keys are stacked as (key, value-as-text) pairs, grouped
    once per (key, value) with map-side combining (the NULL group included),
    then reduced to one profile row per key."""
    b = _base(spark, sf).withColumn("card2", F.expr(_CARD2))
    pairs = ", ".join(f"'{k}', CAST(`{k}` AS STRING)" for k in _KEYS)
    st = b.selectExpr(f"stack({len(_KEYS)}, {pairs}) AS (key, value)", f"`{Y}` AS _y")
    per = st.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("r"))
    seen = F.col("value").isNotNull()
    return per.groupBy("key").agg(
        F.count(F.col("value")).alias("n_unique"),
        (F.sum(F.when(~seen, F.col("n")).otherwise(0)) / F.sum("n")).alias("null_rate"),
        F.min(F.when(seen, F.col("r"))).alias("min_rate"),
        F.max(F.when(seen, F.col("r"))).alias("max_rate"),
        F.count(F.when(seen & (F.col("r") > 0.1), 1)).alias("n_groups_over_10pct"))


reg("eda_key_profile", _key_profile, ctes(f"keyed AS (SELECT *, {_CARD2} AS card2 FROM base)", " UNION ALL ".join(
    f"SELECT '{k}' AS key, (SELECT count(DISTINCT {k}) FROM keyed) AS n_unique, "
    f"(SELECT avg(CAST({k} IS NULL AS DOUBLE)) FROM keyed) AS null_rate, min(r) AS min_rate, "
    f"max(r) AS max_rate, count(*) FILTER (WHERE r > 0.1) AS n_groups_over_10pct "
    f"FROM (SELECT {k}, avg(isFraud) AS r FROM keyed WHERE {k} IS NOT NULL GROUP BY {k}) g"
    for k in _KEYS)), ["null_rate", "min_rate", "max_rate"])


# ---- E14-E18 ------------------------------------------------------------------------------
def _card_count_bins(spark, sf):
    b = _base(spark, sf)
    per = b.where(F.col("card1").isNotNull()).groupBy("card1").agg(
        F.count(Y).alias("txn_count"), F.avg(Y).alias("fraud_rate"))
    return (per.withColumn("count_bin", P.right_closed_bins(F.col("txn_count"), *COUNT_BINS))
            .groupBy("count_bin").agg(F.avg("fraud_rate").alias("mean_rate"),
                                      F.count(F.lit(1)).alias("n_cards")))


reg("eda_rate_by_card_count", _card_count_bins, plain(
    f"SELECT {_sql_bins('txn_count', COUNT_BINS)} AS count_bin, avg(fraud_rate) AS mean_rate, "
    "count(*) AS n_cards FROM (SELECT card1, count(isFraud) AS txn_count, avg(isFraud) AS "
    "fraud_rate FROM base WHERE card1 IS NOT NULL GROUP BY card1) c GROUP BY 1"), ["mean_rate"])


def _deviation(spark, sf):
    b = _base(spark, sf).select("card1", AMT, Y)
    rows = P.group_stat(b, "card1", "mean_amt", F.avg(AMT))
    rows = rows.select(Y, (F.col(AMT) - F.col("mean_amt")).alias("amt_vs_card_mean"))
    return P.describe(materialize(rows, "deviation"), "amt_vs_card_mean", by=Y, groups=P.CLASSES)


reg("eda_deviation_by_class", _deviation, ctes(
    "d AS (SELECT b.isFraud, b.TransactionAmt - m.mean_amt AS v FROM base b LEFT JOIN "
    "(SELECT card1, avg(TransactionAmt) AS mean_amt FROM base WHERE card1 IS NOT NULL "
    "GROUP BY card1) m ON b.card1 = m.card1)", _sql_describe("v", "d", "isFraud")),
    _DESC_FLOATS)


def _domain(spark, sf, top: bool):
    b = _base(spark, sf)
    st = (b.where(F.col("P_emaildomain").isNotNull()).groupBy("P_emaildomain")
          .agg(F.count(Y).alias("txn_count"), F.avg(Y).alias("fraud_rate"))
          .where(F.col("txn_count") > 100))
    if top:
        return st.orderBy(F.col("fraud_rate").desc(), "P_emaildomain").limit(15)
    return st.orderBy(F.col("fraud_rate").asc(), F.col("P_emaildomain").desc()).limit(10)


_DOM = ("SELECT P_emaildomain, count(isFraud) AS txn_count, avg(isFraud) AS fraud_rate "
        "FROM base WHERE P_emaildomain IS NOT NULL GROUP BY 1 HAVING count(isFraud) > 100")
reg("eda_domain_top", lambda s, sf: _domain(s, sf, True),
    plain(f"SELECT * FROM ({_DOM}) d ORDER BY fraud_rate DESC, P_emaildomain LIMIT 15"),
    ["fraud_rate"])
reg("eda_domain_bottom", lambda s, sf: _domain(s, sf, False),
    plain(f"SELECT * FROM ({_DOM}) d ORDER BY fraud_rate ASC, P_emaildomain DESC LIMIT 10"),
    ["fraud_rate"])


def _uid_groups(b):
    return b.groupBy("card1", "addr1").agg(F.count(Y).alias("txn_count"),
                                          F.avg(Y).alias("fraud_rate"))


def _uid_stats(spark, sf):
    u = materialize(_uid_groups(_base(spark, sf)).select("txn_count", "fraud_rate"), "uids")
    return P.describe(u, "fraud_rate", sums={"n_uids": F.lit(1),
                                             "n_multi": F.when(F.col("txn_count") > 1, 1).otherwise(0)})


_UID = ("u AS (SELECT card1, addr1, count(isFraud) AS txn_count, avg(isFraud) AS fraud_rate "
        "FROM base GROUP BY card1, addr1)")
reg("eda_uid_stats", _uid_stats, ctes(
    _UID, "SELECT count(fraud_rate) AS count, avg(fraud_rate) AS mean, stddev_samp(fraud_rate) "
    "AS std, min(fraud_rate) AS min, quantile_cont(fraud_rate, 0.25) AS q25, "
    "quantile_cont(fraud_rate, 0.5) AS q50, quantile_cont(fraud_rate, 0.75) AS q75, "
    "max(fraud_rate) AS max, count(*) AS n_uids, count(*) FILTER (WHERE txn_count > 1) "
    "AS n_multi FROM u"), _DESC_FLOATS)
reg("eda_uid_bins", lambda s, sf: (
    _uid_groups(_base(s, sf)).withColumn("count_bin", P.right_closed_bins(
        F.col("txn_count"), *UID_BINS)).groupBy("count_bin").agg(
        F.avg("fraud_rate").alias("mean_rate"), F.count(F.lit(1)).alias("n_uids"))),
    ctes(_UID, f"SELECT {_sql_bins('txn_count', UID_BINS)} AS count_bin, avg(fraud_rate) AS "
         "mean_rate, count(*) AS n_uids FROM u GROUP BY 1"), ["mean_rate"])


def _std_by_class(spark, sf):
    cards = P.key_classes(_base(spark, sf), "card1", F.stddev_samp(AMT), Y)
    return P.describe(cards, "stat", by=Y, groups=P.CLASSES, weight="n")


reg("eda_std_by_class", _std_by_class, ctes(
    "d AS (SELECT b.isFraud, s.v FROM base b LEFT JOIN (SELECT card1, stddev_samp("
    "TransactionAmt) AS v FROM base WHERE card1 IS NOT NULL GROUP BY card1) s "
    "ON b.card1 = s.card1)", _sql_describe("v", "d", "isFraud")), _DESC_FLOATS)


# ---- E19-E25 ------------------------------------------------------------------------------
def _degrees(spark, sf, key, other):
    return P.key_degrees(_base(spark, sf), key, other, Y)


def _degree_rate(spark, sf, key, other, name, having, limit=None):
    out = (_degrees(spark, sf, key, other).groupBy(F.col("degree").alias(name))
           .agg(F.try_divide(F.sum("pos").cast("double"), F.sum("labelled")).alias("fraud_rate"),
                F.sum("n").alias("n"))
           .where(F.col("n") > having))
    if limit:
        out = out.orderBy(name).limit(limit)
    return out


def _sql_degree(key, other, name, having, limit=None):
    lim = f" ORDER BY {name} LIMIT {limit}" if limit else ""
    return plain(
        f"SELECT {name}, avg(isFraud) AS fraud_rate, count(*) AS n FROM (SELECT b.isFraud, "
        f"d.{name} FROM base b LEFT JOIN (SELECT {key}, count(DISTINCT {other}) AS {name} "
        f"FROM base WHERE {key} IS NOT NULL GROUP BY {key}) d ON b.{key} = d.{key}) x "
        f"WHERE {name} IS NOT NULL GROUP BY {name} HAVING count(*) > {having}{lim}")


reg("eda_card_email_degree",
    lambda s, sf: _degree_rate(s, sf, "card1", "P_emaildomain", "card_email_degree", 100),
    _sql_degree("card1", "P_emaildomain", "card_email_degree", 100), ["fraud_rate"])
reg("eda_card_device_degree",
    lambda s, sf: _degree_rate(s, sf, "card1", "DeviceInfo", "card_device_degree", 50),
    _sql_degree("card1", "DeviceInfo", "card_device_degree", 50), ["fraud_rate"])
reg("eda_addr_degree",
    lambda s, sf: _degree_rate(s, sf, "addr1", "card1", "addr_card_degree", 100, 20),
    _sql_degree("addr1", "card1", "addr_card_degree", 100, 20), ["fraud_rate"])


def _email_card_degree(spark, sf):
    per = materialize(_degrees(spark, sf, "P_emaildomain", "card1"), "degrees")
    (st,) = weighted_stats(per, F.col("degree"), F.col("n"), probs=[i / 5 for i in range(6)])
    bucket = fxf.right_closed_bucket("degree", sorted(set(st.quantiles))[1:-1])
    return (per.withColumn("degree", F.col("degree").cast("double")).groupBy(bucket.alias("bucket"))
            .agg(F.try_divide(F.sum("pos").cast("double"), F.sum("labelled")).alias("fraud_rate"),
                 F.sum("n").alias("n")))


reg("eda_email_card_degree", _email_card_degree, ctes(
    "d AS (SELECT b.isFraud, CAST(g.deg AS DOUBLE) AS deg FROM base b JOIN (SELECT "
    "P_emaildomain, count(DISTINCT card1) AS deg FROM base WHERE P_emaildomain IS NOT NULL "
    "GROUP BY 1) g ON b.P_emaildomain = g.P_emaildomain),\n"
    "q AS (SELECT DISTINCT unnest(quantile_cont(deg, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS e "
    "FROM d),\nqi AS (SELECT e FROM q WHERE e > (SELECT min(e) FROM q) AND e < "
    "(SELECT max(e) FROM q))",
    "SELECT CAST((SELECT count(*) FROM qi WHERE deg > e) AS INTEGER) AS bucket, avg(isFraud) "
    "AS fraud_rate, count(*) AS n FROM d GROUP BY 1"), ["fraud_rate"])


def _devices(spark, sf):
    """One row per device, the rows without one included: its labelled rows as
    value (NULL without a device), rows, labelled rows and positives."""
    return _base(spark, sf).groupBy("DeviceInfo").agg(
        F.count(F.lit(1)).alias("n"), F.count(Y).alias("labelled"), F.sum(Y).alias("pos")).withColumn(
        "device_txn_count", F.when(F.col("DeviceInfo").isNotNull(), F.col("labelled")))


def _device_count(spark, sf):
    return P.describe(materialize(_devices(spark, sf), "devices"), "device_txn_count",
                      percentiles=[0.25, 0.5, 0.75, 0.9, 0.99], weight="n")


_DEV = ("dv AS (SELECT b.isFraud, CAST(g.n AS DOUBLE) AS v FROM base b LEFT JOIN "
        "(SELECT DeviceInfo, count(isFraud) AS n FROM base WHERE DeviceInfo IS NOT NULL "
        "GROUP BY 1) g ON b.DeviceInfo = g.DeviceInfo)")
reg("eda_device_count", _device_count, ctes(
    _DEV, "SELECT count(v) AS count, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, "
    "quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS "
    "q75, quantile_cont(v, 0.9) AS q90, quantile_cont(v, 0.99) AS q99, max(v) AS max FROM dv"),
    ["mean", "std", "min", "q25", "q50", "q75", "q90", "q99", "max"])
reg("eda_device_count_bins", lambda s, sf: _devices(s, sf).groupBy(
    P.right_closed_bins(F.col("device_txn_count"), *DEV_BINS).alias("count_bin")).agg(
    F.try_divide(F.sum("pos").cast("double"), F.sum("labelled")).alias("fraud_rate"), F.sum("n").alias("n")),
    ctes(_DEV, f"SELECT {_sql_bins('v', DEV_BINS)} AS count_bin, avg(isFraud) AS fraud_rate, "
         "count(*) AS n FROM dv GROUP BY 1"), ["fraud_rate"])


def _pairs(spark, sf, other):
    """One row per pair of card and ``other`` (NULL is a value): rate and rows."""
    return _base(spark, sf).groupBy("card1", other).agg(F.avg(Y).alias("pair_rate"), F.count(F.lit(1)).alias("n"))


def _pair_rate(spark, sf):
    pairs = materialize(_pairs(spark, sf, "P_emaildomain").select("pair_rate", "n"), "pairs")

    def rows_at(rate):
        return F.when(F.col("pair_rate") == rate, F.col("n")).otherwise(0)
    return P.describe(pairs, "pair_rate", weight="n", sums={"n_rows_at_1": rows_at(1.0), "n_rows_at_0": rows_at(0.0)})


reg("eda_pair_rate", _pair_rate, ctes(
    "pr AS (SELECT b.isFraud, g.r AS v FROM base b LEFT JOIN (SELECT card1, P_emaildomain, "
    "avg(isFraud) AS r FROM base GROUP BY 1, 2) g ON b.card1 IS NOT DISTINCT FROM g.card1 AND "
    "b.P_emaildomain IS NOT DISTINCT FROM g.P_emaildomain)",
    _sql_describe("v", "pr").replace(" FROM pr", ", count(*) FILTER (WHERE v = 1.0) AS "
                                     "n_rows_at_1, count(*) FILTER (WHERE v = 0.0) AS n_rows_at_0 "
                                     "FROM pr")), _DESC_FLOATS)


def _uid_rate(spark, sf):
    known = _pairs(spark, sf, "addr1").where(F.col("pair_rate").isNotNull())

    def share(rate):
        return F.try_divide(F.sum(F.when(F.col("pair_rate") == rate, F.col("n")).otherwise(0)).cast("double"), F.sum("n")) * 100
    return known.agg(share(1.0).alias("pct_rows_at_1"), share(0.0).alias("pct_rows_at_0"))


reg("eda_uid_rate", _uid_rate, ctes(
    "ur AS (SELECT g.r AS v FROM base b LEFT JOIN (SELECT card1, addr1, avg(isFraud) AS r "
    "FROM base GROUP BY 1, 2) g ON b.card1 IS NOT DISTINCT FROM g.card1 AND "
    "b.addr1 IS NOT DISTINCT FROM g.addr1)",
    "SELECT avg(CAST(v = 1.0 AS DOUBLE)) * 100 AS pct_rows_at_1, avg(CAST(v = 0.0 AS DOUBLE)) * "
    "100 AS pct_rows_at_0 FROM ur"), ["pct_rows_at_1", "pct_rows_at_0"])


# ---- E26 ------------------------------------------------------------------------------------
def _profile(spark, sf):
    return P.profile_table(_base(spark, sf))


_PROFILE_COLS = ["TransactionID", "TransactionDT", "TransactionAmt", "card1", "P_emaildomain",
                 "addr1", "isFraud", "k", "id_01", "id_13", "id_16", "DeviceInfo"]
_PROFILE_NUM = ["TransactionID", "TransactionDT", "TransactionAmt", "card1", "addr1", "isFraud",
                "k", "id_01", "id_13"]


def _profile_sql() -> str:
    stacked = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, isFraud AS y FROM base"
        for c in _PROFILE_COLS)
    nums = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, avg({c}) AS mean, stddev_samp({c}) AS std, "
        f"CAST(min({c}) AS DOUBLE) AS min, quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q25, "
        f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q50, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q75, "
        f"CAST(max({c}) AS DOUBLE) AS max FROM base"
        for c in _PROFILE_NUM)
    texts = ", ".join(f"'{c}'" for c in _PROFILE_COLS if c not in _PROFILE_NUM)
    return ctes(
        f"st AS ({stacked}),\npv AS (SELECT column_name, value, count(*) AS n, avg(y) AS rate "
        "FROM st GROUP BY column_name, value),\n"
        "pc AS (SELECT column_name, sum(n) AS n_rows, sum(CASE WHEN value IS NULL THEN n ELSE 0 END) "
        f"AS n_null, count(value) AS n_distinct, min(value) FILTER (WHERE column_name IN ({texts})) AS min_text, "
        f"max(value) FILTER (WHERE column_name IN ({texts})) AS max_text FROM pv GROUP BY column_name),\n"
        "tp AS (SELECT column_name, value AS top_value, n AS top_count, rate AS top_fraud_rate FROM "
        "(SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rn FROM pv "
        "WHERE value IS NOT NULL) t WHERE rn = 1),\n"
        f"nm AS ({nums})",
        "SELECT pc.column_name, CAST(n_rows AS BIGINT) AS n_rows, CAST(n_null AS BIGINT) AS n_null, "
        "n_distinct, mean, std, min, q25, q50, q75, max, min_text, max_text, top_value, top_count, top_fraud_rate FROM pc "
        "LEFT JOIN tp USING (column_name) LEFT JOIN nm USING (column_name)")


reg("profile_table", _profile, _profile_sql(), ["mean", "std", "min", "q25", "q50", "q75", "max", "top_fraud_rate"])


# ---- E19 / E20 extra outputs: value counts and describe of the row degrees --------------
def _deg_sql(key, other, name):
    return (f"dg AS (SELECT CAST(d.{name} AS DOUBLE) AS v FROM base b JOIN (SELECT {key}, "
            f"count(DISTINCT {other}) AS {name} FROM base WHERE {key} IS NOT NULL GROUP BY {key}) d "
            f"ON b.{key} = d.{key})")


reg("eda_card_email_degree_top10", lambda s, sf: (
    _degrees(s, sf, "card1", "P_emaildomain")
    .groupBy(F.col("degree").cast("double").alias("card_email_degree")).agg(F.sum("n").alias("n"))
    .orderBy(F.col("n").desc(), "card_email_degree").limit(10)),
    ctes(_deg_sql("card1", "P_emaildomain", "card_email_degree"),
         "SELECT v AS card_email_degree, count(*) AS n FROM dg GROUP BY v "
         "ORDER BY n DESC, v LIMIT 10"), ["card_email_degree"])
reg("eda_card_email_degree_describe", lambda s, sf: P.describe(
    materialize(_degrees(s, sf, "card1", "P_emaildomain"), "degrees"), "degree", weight="n"),
    ctes(_deg_sql("card1", "P_emaildomain", "card_email_degree"), _sql_describe("v", "dg")),
    _DESC_FLOATS)
reg("eda_email_card_degree_describe", lambda s, sf: P.describe(
    materialize(_degrees(s, sf, "P_emaildomain", "card1"), "degrees"), "degree", weight="n"),
    ctes(_deg_sql("P_emaildomain", "card1", "email_card_degree"), _sql_describe("v", "dg")),
    _DESC_FLOATS)


# ---- J11: per-card statistics merged back onto the rows ---------------------------------
def _card_deviation(spark, sf):
    b = _base(spark, sf)
    stats = (b.where(F.col("card1").isNotNull()).groupBy("card1")
             .agg(F.avg(AMT).alias("mean_amt"), F.stddev_samp(AMT).alias("std_amt"),
                  F.count(AMT).alias("txn_count"), F.max(AMT).alias("max_amt"),
                  F.min(AMT).alias("min_amt")))
    rows = b.select("TransactionID", "card1", AMT).join(stats, "card1", "left")
    return rows.withColumn("amt_vs_card_mean", F.col(AMT) - F.col("mean_amt"))


reg("card_deviation", _card_deviation, plain(
    "SELECT b.TransactionID, b.card1, b.TransactionAmt, s.mean_amt, s.std_amt, s.txn_count, "
    "s.max_amt, s.min_amt, b.TransactionAmt - s.mean_amt AS amt_vs_card_mean FROM base b "
    "LEFT JOIN (SELECT card1, avg(TransactionAmt) AS mean_amt, stddev_samp(TransactionAmt) AS "
    "std_amt, count(TransactionAmt) AS txn_count, max(TransactionAmt) AS max_amt, "
    "min(TransactionAmt) AS min_amt FROM base WHERE card1 IS NOT NULL GROUP BY card1) s "
    "ON b.card1 = s.card1"),
    ["TransactionAmt", "mean_amt", "std_amt", "max_amt", "min_amt", "amt_vs_card_mean"])


# ---- E10 / E11 extra outputs ------------------------------------------------------------
def _null_gap_counts(spark, sf):
    gaps = _null_gap(spark, sf)
    return gaps.agg(F.count(F.when(F.col("diff") > 0.05, 1)).alias("n_diff_over_5pct"),
                    F.count(F.when(F.col("diff") > 0.10, 1)).alias("n_diff_over_10pct"))


reg("eda_null_gap_counts", _null_gap_counts, plain(
    "SELECT count(*) FILTER (WHERE d > 0.05) AS n_diff_over_5pct, "
    "count(*) FILTER (WHERE d > 0.10) AS n_diff_over_10pct FROM (" + " UNION ALL ".join(
        f"SELECT count(*) FILTER (WHERE {c} IS NULL) AS n_null, round(abs("
        f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) FILTER (WHERE isFraud = 1) - "
        f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) FILTER (WHERE isFraud = 0)), 3) AS d "
        "FROM base" for c in _NULLABLE) + ") t WHERE n_null > 0"))


def _null_corr_id01(spark, sf):
    b = _base(spark, sf)
    cols = [c for c in ("DeviceInfo", "DeviceType", "R_emaildomain") if c in b.columns]
    return P.null_indicator_corr(b, ["id_01"] + cols).where(
        (F.col("col_a") != "id_01") & (F.col("col_b") == "id_01"))


reg("eda_null_corr_id01", _null_corr_id01, plain(
    "SELECT 'DeviceInfo' AS col_a, 'id_01' AS col_b, CASE WHEN isnan(r) THEN NULL ELSE r END "
    "AS corr FROM (SELECT corr(CAST(DeviceInfo IS NULL AS DOUBLE), CAST(id_01 IS NULL AS "
    "DOUBLE)) AS r FROM base) x"), ["corr"])
