"""Exploratory aggregates (E1-E26) as DataFrame queries.

A key's statistic repeated on its rows (pandas ``groupby().transform``) is not
joined back to them: a description of the rows is one of the keys, each weighted
by its rows (``key_degrees``, ``key_classes``), and quantiles of all classes come
from the shared passes of ``weighted.weighted_stats``. Only a value that differs
from row to row (the deviation from the card's mean) needs ``group_stat``'s join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .weighted import MAX_GROUPS, weighted_stats

QUARTILES = [0.25, 0.5, 0.75]


def group_stat(df: DataFrame, key: str, name: str, agg: Column) -> DataFrame:
    """Attach a per-key statistic to every row (NULL key -> NULL stat, as
    pandas' transform leaves NaN there)."""
    stats = df.where(F.col(key).isNotNull()).groupBy(key).agg(agg.alias(name))
    return df.join(stats, key, "left")


def right_closed_bins(x: Column, edges: list[float], labels: list[str]) -> Column:
    """pandas.cut(bins=edges, labels=labels): right-closed (e_i, e_i+1]."""
    expr = None
    for i in range(len(edges) - 1):
        cond = (x > edges[i]) & (x <= edges[i + 1])
        expr = F.when(cond, labels[i]) if expr is None else expr.when(cond, labels[i])
    return expr


#: The label's values that ``key_classes`` counts.
CLASSES = (0, 1, None)


def key_degrees(df: DataFrame, key: str, other: str, label: str) -> DataFrame:
    """One row per non-NULL ``key``: its number of distinct non-NULL ``other``
    values, its rows, labelled rows and positives; the (key, other) edges are
    aggregated first, so a hot key is combined on the map side."""
    edges = df.where(F.col(key).isNotNull()).groupBy(key, other).agg(
        F.count(F.lit(1)).alias("n"), F.count(label).alias("labelled"), F.sum(label).alias("pos"))
    return edges.groupBy(key).agg(F.count(other).alias("degree"),
                                  *[F.sum(c).alias(c) for c in ("n", "labelled", "pos")])


def key_classes(df: DataFrame, key: str, stat: Column, label: str) -> DataFrame:
    """One row per non-NULL ``key`` and class: the key's ``stat`` and its rows
    ``n`` of the class, written once."""
    counts = [F.count_if(F.col(label).eqNullSafe(F.lit(c))).alias(f"n_{k}") for k, c in enumerate(CLASSES)]
    per = df.where(F.col(key).isNotNull()).groupBy(key).agg(stat.alias("stat"), *counts)
    kind = df.schema[label].dataType.simpleString()
    pairs = ", ".join(f"CAST({'NULL' if c is None else c} AS {kind}), n_{k}" for k, c in enumerate(CLASSES))
    return materialize(per.selectExpr("stat", f"stack({len(CLASSES)}, {pairs}) AS (`{label}`, n)").where("n > 0"),
                       "key-classes")


def describe(df: DataFrame, col: str, by: str | None = None, groups=None, percentiles=QUARTILES,
             weight: str | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
    """count, mean, std, min, percentiles, max of ``col`` (per ``by`` group), each
    row standing for ``weight`` ones; NULL and NaN excluded like pandas' describe.
    ``groups`` names the groups to look for (default: all, at most MAX_GROUPS);
    those without rows are left out. ``sums`` adds sums over all rows of a group."""
    x, sums = F.col(col), sums or {}
    number, names = None, [None]
    if by is not None:
        if groups is None:
            groups = [r[0] for r in df.select(by).distinct().limit(MAX_GROUPS + 1).collect()]
        names = sorted(groups, key=lambda v: (v is None, v))
        number = F.lit(None).cast("int")
        for k, g in reversed(list(enumerate(names))):
            number = F.when(F.col(by).eqNullSafe(F.lit(g)), k).otherwise(number)
    stats = weighted_stats(df, x, F.col(weight) if weight else None, number, len(names), percentiles,
                           {"__rows": F.lit(1), **sums})
    rows = [((g,) if by else ()) + (st.n, st.mean, st.std, st.lo, *st.quantiles, st.hi,
                                    *[None if st.sums[k] is None else int(st.sums[k]) for k in sums])
            for g, st in zip(names, stats) if by is None or st.sums["__rows"]]
    fields = ["count long", "mean double", "std double", "min double",
              *[f"q{int(round(p * 100))} double" for p in percentiles], "max double", *[f"{k} long" for k in sums]]
    if by:
        fields.insert(0, f"{by} {df.schema[by].dataType.simpleString()}")
    return df.sparkSession.createDataFrame(rows, ", ".join(fields))


def rate_by(df: DataFrame, key: Column | str, target: str = "isFraud",
            name: str | None = None) -> DataFrame:
    k = F.col(key) if isinstance(key, str) else key
    return df.groupBy(k.alias(name) if name else k).agg(
        F.avg(target).alias("fraud_rate"), F.count(F.lit(1)).alias("n"))


def bias_corrected_skew(x: str) -> Column:
    """pandas' (adjusted Fisher-Pearson) skewness from Spark's biased one."""
    n = F.count(F.col(x)).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def equal_width_hist(df: DataFrame, col: Column, bins: int = 100) -> DataFrame:
    """Counts in ``bins`` equal-width bins over [min, max]; the max falls in
    the last bin. Returns (bin, n) for non-empty bins."""
    v = df.select(col.alias("_v")).where(F.col("_v").isNotNull())
    mm = v.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi")).first()
    lo, hi = mm["lo"], mm["hi"]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, n long")
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((F.col("_v") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return v.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def null_patterns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows per NULL pattern: one aggregation by the columns' NULL indicators as
    a text of 0 and 1."""
    mask = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in cols])
    return df.groupBy(mask.alias("mask")).agg(F.count(F.lit(1)).alias("n"))


def null_indicator_corr(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of NULL indicators for every ordered pair; a constant
    indicator gives NULL. Rows are counted per NULL pattern; the n(n-1)/2 pair
    counts are sums over the patterns, and a correlation follows from them."""
    patterns = null_patterns(df, cols)

    def both(i, j):
        bit = F.substring("mask", i + 1, 1) == "1"
        return F.sum(F.when(bit if i == j else bit & (F.substring("mask", j + 1, 1) == "1"), F.col("n")).otherwise(0))
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = patterns.agg(F.sum("n"), *[both(i, j) for i, j in pairs]).first()
    n = int(row[0] or 0)
    count = dict(zip(pairs, (int(x or 0) for x in row[1:])))

    def corr(i, j):
        a, b, ab = count[i, i], count[j, j], count[min(i, j), max(i, j)]
        spread = a * (n - a) * b * (n - b)
        return None if not spread else (n * ab - a * b) / math.sqrt(spread)
    vals = [(a, b, corr(i, j)) for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return df.sparkSession.createDataFrame(vals, "col_a string, col_b string, corr double")


def profile_table(df: DataFrame, target: str = "isFraud", exclude=("split",)) -> DataFrame:
    """Per column: count, NULLs, distinct, mean/std/min/quartiles/max (numeric),
    least and greatest text (others), most frequent value with its count and
    target rate.

    One pass stacks (column, value-as-text) pairs and aggregates them per
    (column, value) with map-side combining; per-column results come from a
    second aggregation over those (column, value) groups. The numeric columns'
    moments and quartiles come from shared passes over (column, value)."""
    cols = [c for c in df.columns if c not in exclude]
    numeric = [f.name for f in df.schema.fields
               if isinstance(f.dataType, T.NumericType) and f.name in cols]
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in cols)
    stacked = df.selectExpr(f"stack({len(cols)}, {pairs}) AS (column_name, value)", f"`{target}` AS _y")
    per_value = stacked.groupBy("column_name", "value").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_y").alias("rate"))
    text = F.when(~F.col("column_name").isin(numeric), F.col("value"))
    per_col = per_value.groupBy("column_name").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
        F.count(F.col("value")).alias("n_distinct"), F.min(text).alias("min_text"), F.max(text).alias("max_text"),
        F.min_by(F.struct("value", "n", "rate"),
                 F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("k"), F.col("value").alias("v")))
                 ).alias("t"))
    rows = []
    if numeric:
        pairs = ", ".join(f"{k}, CAST(`{c}` AS DOUBLE)" for k, c in enumerate(numeric))
        values = df.selectExpr(f"stack({len(numeric)}, {pairs}) AS (g, x)")
        stats = weighted_stats(values, F.col("x"), None, F.col("g"), len(numeric), QUARTILES)
        rows = [(c, st.mean, st.std, st.lo, *st.quantiles, st.hi) for c, st in zip(numeric, stats)]
    nums = df.sparkSession.createDataFrame(
        rows, "column_name string, mean double, std double, min double, q25 double, q50 double, q75 double, max double")
    return (per_col.join(F.broadcast(nums), "column_name", "left")
            .select("column_name", "n_rows", "n_null", "n_distinct", "mean", "std", "min", "q25", "q50", "q75", "max",
                    "min_text", "max_text", F.col("t.value").alias("top_value"), F.col("t.n").alias("top_count"),
                    F.col("t.rate").alias("top_fraud_rate")))
