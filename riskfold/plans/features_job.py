"""O2: fit feature parameters on train, apply them to every split.

``fit`` runs a handful of aggregations over the training rows and
checkpoints each parameter table; ``apply`` is one lazy plan of row-local
expressions and six left joins (one per lookup key), with no action, global
sort or window, so the same function serves batch and streaming input.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import (ALL_ENGINEERED_FEATURES, AMT_COL, TARGET, FeatureConfig)
from ..functions import features as fx
from ..operators.lookup import (DEFAULT_BROADCAST_LIMIT, Lookup, drop_lookup_columns,
                                join_lookup, stat_or_default)
from ..operators.selection import exact_quantiles
from ..session import materialize

CARD, EMAIL, DEVICE, ADDR = "card1", "P_emaildomain", "DeviceInfo", "addr1"


@dataclass
class FeatureParams:
    cfg: FeatureConfig
    lookups: dict[str, Lookup] = field(default_factory=dict)
    median_amt: float | None = None
    global_rate: float | None = None
    edges: list[float] | None = None
    id_present: dict[str, bool] = field(default_factory=dict)
    broadcast_limit: int = DEFAULT_BROADCAST_LIMIT

    def summary(self) -> dict:
        out = {f"n_{k}": v.rows for k, v in self.lookups.items()}
        out.update(median_amt=self.median_amt, global_fraud_rate=self.global_rate,
                   n_edges=len(self.edges) if self.edges is not None else None)
        return out


# ---- fit ----------------------------------------------------------------------------
def fit_card(train: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """A1 + A5 in one aggregation: amount stats and device degree per card."""
    amt = F.col(AMT_COL)
    aggs = [F.count(amt).alias("card1_txn_count"),
            F.avg(amt).alias("card1_mean_amt"),
            F.coalesce(F.stddev_samp(amt), F.lit(0.0)).alias("card1_std_amt"),
            (F.count(amt) >= cfg.high_freq_min_txns).cast("int").alias("card1_is_high_freq")]
    if DEVICE in train.columns:
        aggs.append(F.countDistinct(DEVICE).alias("device_degree"))
    return train.where(F.col(CARD).isNotNull()).groupBy(CARD).agg(*aggs)


def fit_email(train: DataFrame, target: str = TARGET) -> DataFrame:
    return (train.where(F.col(EMAIL).isNotNull()).groupBy(EMAIL)
            .agg(F.avg(target).alias("email_fraud_rate"),
                 F.count(target).alias("email_txn_count")))


def fit_device(train: DataFrame) -> DataFrame:
    return (train.where(F.col(DEVICE).isNotNull()).groupBy(DEVICE)
            .agg(F.count(F.lit(1)).alias("device_txn_count")))


def fit_addr(train: DataFrame) -> DataFrame:
    return (train.where(F.col(ADDR).isNotNull()).groupBy(ADDR)
            .agg(F.countDistinct(CARD).alias("card_degree")))


def fit_pair(train: DataFrame, other: str, target: str = TARGET) -> DataFrame:
    """Mean target per (card1, other); NULL is an ordinary key value."""
    return train.groupBy(CARD, other).agg(F.avg(target).alias("fraud_rate"))


def decile_edges(train: DataFrame, cfg: FeatureConfig, amt_col: str = AMT_COL,
                 qs: list[float] | None = None) -> list[float]:
    """Quantile edges (linear interpolation), duplicates dropped, outer
    edges replaced by -inf/+inf. Fewer than two edges: no interval."""
    q = cfg.n_deciles
    if qs is None:
        qs = exact_quantiles(train, amt_col, [i / q for i in range(q + 1)])
    if qs[0] is None:
        return []
    edges = sorted(set(qs))
    if len(edges) < 2:
        return edges
    return [float("-inf")] + edges[1:-1] + [float("inf")]


def fit(base: DataFrame, cfg: FeatureConfig = FeatureConfig(),
        split_col: str = "split", target: str = TARGET) -> FeatureParams:
    """Fit every parameter on the training rows only."""
    train = base.where(F.col(split_col) == "train") if split_col in base.columns else base
    p = FeatureParams(cfg)
    cols = train.columns
    p.id_present = {c: c in cols for c in ("id_01", "id_13", "id_16")}
    if AMT_COL in cols:
        # median and decile edges from the same selection passes
        probs = [i / cfg.n_deciles for i in range(cfg.n_deciles + 1)]
        qs = exact_quantiles(train, AMT_COL, probs + [0.5])
        p.median_amt = qs[-1]
        p.edges = decile_edges(train, cfg, qs=qs[:-1])
    if CARD in cols and AMT_COL in cols:
        p.lookups["card"] = Lookup.materialise("card", [CARD], fit_card(train, cfg))
    if ADDR in cols and CARD in cols:
        p.lookups["addr"] = Lookup.materialise("addr", [ADDR], fit_addr(train), "null")
    shared, p.global_rate = fit_shared(train, target)
    p.lookups.update(shared)
    return p


def fit_shared(train: DataFrame, target: str = TARGET) -> tuple[dict[str, Lookup], float | None]:
    """The email, device, card+email and card+address tables and the global
    target rate from ONE aggregation: a GROUPING SETS query (one scan of the
    train partition, map-side partial aggregation, one shuffle), written once
    partitioned by grouping id; each lookup reads its own partition.

    Per set the result equals the single-table fits above: NULL email or
    device groups are dropped from those tables, while the pair sets keep
    NULL as a key value (grouping_id tells a real NULL from a rolled-up
    column)."""
    cols = train.columns
    has_t = target in cols
    sets = {}
    if EMAIL in cols and has_t:
        sets["email"] = [EMAIL]
    if DEVICE in cols:
        sets["device"] = [DEVICE]
    if CARD in cols and EMAIL in cols and has_t:
        sets["card_email"] = [CARD, EMAIL]
    if CARD in cols and ADDR in cols and has_t:
        sets["uid"] = [CARD, ADDR]
    if has_t:
        sets["all"] = []
    if not sets:
        return {}, None
    keys = [c for c in (EMAIL, DEVICE, CARD, ADDR) if any(c in s for s in sets.values())]
    gid = {name: sum(1 << (len(keys) - 1 - i) for i, c in enumerate(keys) if c not in s)
           for name, s in sets.items()}
    spec = ", ".join("(" + ", ".join(f"`{c}`" for c in s) + ")" for s in sets.values())
    y = f"`{target}`" if has_t else "CAST(NULL AS INT)"
    key_list = ", ".join(f"`{c}`" for c in keys)
    agg = train.sparkSession.sql(
        f"SELECT grouping_id({key_list}) AS _gid, {key_list}, avg({y}) AS fraud_rate, "
        f"count({y}) AS n_target, count(1) AS n_rows FROM {{train}} "
        f"GROUP BY GROUPING SETS ({spec})", train=train)
    groups = materialize(agg, "fit-groups", partition_by="_gid")
    g = F.col("_gid")

    def part(name):
        return groups.where(g == gid[name])

    tables = {}
    if "email" in sets:
        tables["email"] = ([EMAIL], part("email").where(F.col(EMAIL).isNotNull()).select(
            EMAIL, F.col("fraud_rate").alias("email_fraud_rate"),
            F.col("n_target").alias("email_txn_count")), "default")
    if "device" in sets:
        tables["device"] = ([DEVICE], part("device").where(F.col(DEVICE).isNotNull()).select(
            DEVICE, F.col("n_rows").alias("device_txn_count")), "null")
    if "card_email" in sets:
        tables["card_email"] = ([CARD, EMAIL], part("card_email").select(
            CARD, EMAIL, "fraud_rate"), "value")
    if "uid" in sets:
        tables["uid"] = ([CARD, ADDR], part("uid").select(CARD, ADDR, "fraud_rate"), "value")
    # entry counts and the global rate in one small job over the grouped table
    stats = groups.agg(*[F.count(F.when(g == gid[n], F.lit(1))).alias(f"n_{n}")
                         for n in ("card_email", "uid") if n in sets],
                       *([F.count(F.when(g == gid["email"], F.col(EMAIL))).alias("n_email")]
                         if "email" in sets else []),
                       *([F.count(F.when(g == gid["device"], F.col(DEVICE))).alias("n_device")]
                         if "device" in sets else []),
                       F.max(F.when(g == gid.get("all", -1), F.col("fraud_rate"))).alias("rate")
                       ).first()
    lookups = {name: Lookup(name, ks, df.withColumn("_hit", F.lit(True)), int(stats[f"n_{name}"]),
                            nulls)
               for name, (ks, df, nulls) in tables.items()}
    return lookups, (stats["rate"] if has_t else None)


# ---- apply ----------------------------------------------------------------------------
def apply_card(df: DataFrame, p: FeatureParams, keep_hit: bool = False) -> DataFrame:
    lk = p.lookups.get("card")
    if lk is None or CARD not in df.columns:
        return df
    cfg = p.cfg
    out = join_lookup(df, lk, broadcast_limit=p.broadcast_limit)
    cols = {
        "card1_txn_count": stat_or_default(lk, "card1_txn_count", F.lit(1).cast("long")),
        "card1_mean_amt": stat_or_default(lk, "card1_mean_amt", F.lit(p.median_amt).cast("double")),
        "card1_std_amt": stat_or_default(lk, "card1_std_amt", 0.0),
        "card1_is_high_freq": stat_or_default(lk, "card1_is_high_freq", 0),
    }
    if "device_degree" in lk.df.columns:
        deg = stat_or_default(lk, "device_degree", F.lit(cfg.card_device_unseen).cast("long"))
        cols["card_device_is_high"] = (deg > cfg.card_device_high).cast("int")
    return drop_lookup_columns(out.withColumns(cols), lk, keep_hit)


def apply_email(df: DataFrame, p: FeatureParams, keep_hit: bool = False) -> DataFrame:
    lk = p.lookups.get("email")
    if lk is None or EMAIL not in df.columns:
        return df
    out = join_lookup(df, lk, broadcast_limit=p.broadcast_limit).withColumns({
        "email_fraud_rate": stat_or_default(lk, "email_fraud_rate", F.lit(p.global_rate).cast("double")),
        "email_txn_count": stat_or_default(lk, "email_txn_count", F.lit(1).cast("long")),
    })
    return drop_lookup_columns(out, lk, keep_hit)


def apply_device(df: DataFrame, p: FeatureParams, keep_hit: bool = False) -> DataFrame:
    lk = p.lookups.get("device")
    if lk is None or DEVICE not in df.columns:
        return df
    out = join_lookup(df, lk, broadcast_limit=p.broadcast_limit).withColumn(
        "device_txn_count",
        F.when(F.col(DEVICE).isNull(), F.lit(None).cast("long"))
        .otherwise(stat_or_default(lk, "device_txn_count",
                                   F.lit(p.cfg.device_unseen).cast("long"))))
    return drop_lookup_columns(out, lk, keep_hit)


def apply_addr(df: DataFrame, p: FeatureParams, keep_hit: bool = False) -> DataFrame:
    lk = p.lookups.get("addr")
    if lk is None or ADDR not in df.columns:
        return df
    deg = stat_or_default(lk, "card_degree", F.lit(p.cfg.addr_unseen).cast("long"))
    out = join_lookup(df, lk, broadcast_limit=p.broadcast_limit).withColumn(
        "addr_is_unique",
        F.when(F.col(ADDR).isNull(), F.lit(None).cast("int")).otherwise((deg == 1).cast("int")))
    return drop_lookup_columns(out, lk, keep_hit)


def apply_pairs(df: DataFrame, p: FeatureParams, keep_hit: bool = False) -> DataFrame:
    fallback = p.global_rate if p.global_rate is not None else p.cfg.last_resort_rate
    for name, other, feature in (("card_email", EMAIL, "card_email_pair_fraud_rate"),
                                 ("uid", ADDR, "uid_fraud_rate")):
        lk = p.lookups.get(name)
        if lk is None or other not in df.columns or CARD not in df.columns:
            continue
        df = join_lookup(df, lk, broadcast_limit=p.broadcast_limit).withColumn(
            feature, stat_or_default(lk, "fraud_rate", F.lit(fallback).cast("double")))
        df = drop_lookup_columns(df, lk, keep_hit)
    return df


def _null_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Announced-but-absent features become typed NULL columns."""
    missing = {n: F.lit(None).cast(t) for n, t in names.items() if n not in df.columns}
    return df.withColumns(missing) if missing else df


# feature blocks: (name, apply function, key columns, lookups it reads)
BLOCKS = [
    ("card", lambda d, p, k: apply_card(d, p, k), [CARD], ["card"]),
    ("email", lambda d, p, k: apply_email(d, p, k), [EMAIL], ["email"]),
    ("device", lambda d, p, k: apply_device(d, p, k), [DEVICE], ["device"]),
    ("addr", lambda d, p, k: apply_addr(d, p, k), [ADDR], ["addr"]),
    ("pairs", lambda d, p, k: apply_pairs(d, p, k), [CARD, EMAIL, ADDR], ["card_email", "uid"]),
]


def blocks_by_combination(df: DataFrame, p: FeatureParams) -> list[str]:
    """Blocks reading a table beyond the broadcast limit (batch input only:
    a distinct over a stream would be stateful)."""
    if df.isStreaming:
        return []
    return [name for name, _, _, lks in BLOCKS
            if any(n in p.lookups and p.lookups[n].est_bytes > p.broadcast_limit for n in lks)]


def apply_by_combination(df: DataFrame, p: FeatureParams, names: list[str],
                         keep_hits: bool = False) -> DataFrame:
    """Lookup features depend only on their key columns. With tables beyond
    the broadcast limit, joining each to the fact table would shuffle its
    wide rows once per table; instead the blocks are applied to the distinct
    combinations of their keys (narrow, map-side deduplicated) and the result
    is joined back once, NULL-safely. AQE may broadcast the combination table
    at run time or split hot keys of the fact side."""
    keys = []
    for name, _, ks, _ in BLOCKS:
        if name in names:
            keys += [k for k in ks if k in df.columns and k not in keys]
    combos = df.select(*keys).distinct()
    for name, fn, _, _ in BLOCKS:
        if name in names:
            combos = fn(combos, p, keep_hits)
    right = combos.select(*[F.col(k).alias(f"_ck_{k}") for k in keys],
                          *[c for c in combos.columns if c not in keys])
    cond = None
    for k in keys:
        c = df[k].eqNullSafe(F.col(f"_ck_{k}"))
        cond = c if cond is None else cond & c
    return df.join(right, cond, "left").drop(*[f"_ck_{k}" for k in keys])


def apply(df: DataFrame, p: FeatureParams, keep_hits: bool = False,
          amt_col: str = AMT_COL) -> DataFrame:
    """All 28 features: time, amount, null flags (row-local), the lookup
    blocks (broadcast joins, or one join by key combination for tables
    beyond the broadcast limit), then the ratios. Pure transformation, no
    action (stream-safe)."""
    big = blocks_by_combination(df, p)
    out = fx.time_features(df, cfg=p.cfg)
    out = fx.amount_features(out, p.edges, amt_col, p.cfg)
    out = fx.null_flags(out, p.id_present)
    if big:
        out = apply_by_combination(out, p, big, keep_hits)
    for name, fn, _, _ in BLOCKS:
        if name not in big:
            out = fn(out, p, keep_hits)
    out = fx.ratio_features(out, amt_col, cfg=p.cfg)
    return _null_columns(out, {"device_txn_count": "long", "card_device_is_high": "int",
                               "addr_is_unique": "int"})


def verify_features_added(df: DataFrame, names: list[str] = ALL_ENGINEERED_FEATURES,
                          block: str = "all") -> None:
    """P10: raise if an expected feature is missing after a step."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{block}: features missing after apply: {missing}")
