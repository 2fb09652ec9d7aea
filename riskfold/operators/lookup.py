"""Fitted lookup tables and their application by left join.

A fitted parameter is a small DataFrame (key columns + statistics + a
constant ``_hit`` marker). Applying it is a left join followed by
``when(_hit, stat).otherwise(default)``: the default fires on a *miss* only,
never on a key that was seen with a NULL statistic (``coalesce`` would get
that wrong).

Null keys follow one of three policies:
  "default"  a NULL key misses and takes the default (plain equality join)
  "null"     a NULL key gives a NULL feature
  "value"    NULL is an ordinary key value, fitted and looked up (``<=>``)

Broadcast is used only when the table's measured size (rows x estimated row
width) is under a limit; otherwise the planner's shuffle join runs, with
AQE's skew-join splitting of hot keys on the large side. The planner goes by the
bytes of compressed files and would broadcast, through the driver, tables many
times its threshold; one measured above ``PLANNER_BYTES`` is always shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

DEFAULT_BROADCAST_LIMIT = 64 * 1024 * 1024
#: Measured size up to which the planner may choose, as Spark's own default threshold.
PLANNER_BYTES = 10 * 1024 * 1024


def _row_width(schema: T.StructType) -> int:
    """Estimated bytes per row: 48 per string, 8 per other field, plus row
    overhead (a deliberately generous estimate for the broadcast decision)."""
    return 16 + sum(48 if isinstance(f.dataType, T.StringType) else 8 for f in schema.fields)


@dataclass
class Lookup:
    """A fitted lookup: ``df`` has ``keys`` + statistic columns + ``_hit``."""

    name: str
    keys: list[str]
    df: DataFrame
    rows: int
    null_keys: str = "default"   # "default" | "null" | "value"

    @property
    def est_bytes(self) -> int:
        return self.rows * _row_width(self.df.schema)

    @classmethod
    def materialise(cls, name: str, keys: list[str], stats: DataFrame,
                    null_keys: str = "default") -> "Lookup":
        """Write the fitted table as Parquet under the shared checkpoint
        folder (computed once, lineage cut, survives executor loss) and
        measure it for the broadcast decision (the count reads footers)."""
        df = materialize(stats.withColumn("_hit", F.lit(True)), f"param-{name}")
        return cls(name, keys, df, df.count(), null_keys)


def join_lookup(df: DataFrame, lk: Lookup, on: list[str] | None = None,
                broadcast_limit: int = DEFAULT_BROADCAST_LIMIT) -> DataFrame:
    """Left-join ``lk`` onto ``df``; adds the statistic columns (raw) and
    ``_hit_<name>``. ``on`` names the probe columns (default: same names)."""
    on = on or lk.keys
    prefix = _prefix(lk)
    stats = [c for c in lk.df.columns if c not in lk.keys and c != "_hit"]
    right = lk.df.select(*[F.col(k).alias(prefix + k) for k in lk.keys],
                         *[F.col(s).alias(prefix + s) for s in stats],
                         F.col("_hit").alias(f"_hit_{lk.name}"))
    if lk.est_bytes <= broadcast_limit:
        right = F.broadcast(right)
    elif lk.est_bytes > PLANNER_BYTES:
        right = right.hint("merge")
    cond = None
    for probe, key in zip(on, lk.keys):
        rk = F.col(prefix + key)
        c = df[probe].eqNullSafe(rk) if lk.null_keys == "value" else (df[probe] == rk)
        cond = c if cond is None else cond & c
    out = df.join(right, cond, "left").drop(*[prefix + k for k in lk.keys])
    return out.withColumn(f"_hit_{lk.name}",
                          F.coalesce(F.col(f"_hit_{lk.name}"), F.lit(False)))


def stat_or_default(lk: Lookup, stat: str, default) -> Column:
    """The looked-up statistic on a hit, ``default`` on a miss."""
    d = default if isinstance(default, Column) else F.lit(default)
    return F.when(F.col(f"_hit_{lk.name}"), F.col(_prefix(lk) + stat)).otherwise(d)


def _prefix(lk: Lookup) -> str:
    """Private column prefix of one lookup (the double underscore keeps
    "card" from matching "card_email")."""
    return f"_{lk.name}__"


def drop_lookup_columns(df: DataFrame, lk: Lookup, keep_hit: bool = False) -> DataFrame:
    prefix = _prefix(lk)
    drop = [c for c in df.columns if c.startswith(prefix)]
    if not keep_hit:
        drop.append(f"_hit_{lk.name}")
    return df.drop(*drop)
