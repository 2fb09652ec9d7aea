"""Exact order statistics without funnelling rows into one task.

``order_statistics`` finds the values at given 0-based ranks of a numeric
column by histogram refinement: every pass is one distributed aggregation
that returns at most ``buckets`` rows per open search interval (count, min,
max per bucket). The driver only ever sees those bucket summaries, whose size
is bounded by ``buckets`` times the number of ranks, never by the data.

Intervals are delimited by *observed* bucket minima and maxima, so bucket
arithmetic cannot misplace a row; a bucket holding a single distinct value
(a hot key holding a third of all rows, say) resolves at once.

Exact quantiles (median, decile edges) and the exact ordered time split are
built on it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class _Search:
    rank: int          # 0-based rank among non-null values
    lo: float          # inclusive value interval known to hold the rank
    hi: float
    below: int         # number of values strictly below ``lo``
    size: int          # number of values inside [lo, hi]
    value: float | None = None
    value_below: int | None = None   # values strictly below the answer

    @property
    def open(self) -> bool:
        return self.value is None


def _interval_index(x: Column, intervals: list[tuple]) -> Column:
    expr = F.lit(None).cast("int")
    for i in reversed(range(len(intervals))):
        lo, hi = intervals[i]
        expr = F.when((x >= F.lit(lo)) & (x <= F.lit(hi)), F.lit(i)).otherwise(expr)
    return expr


def _bucket(x: Column, iv: Column, intervals: list[tuple], buckets: int) -> Column:
    """Monotone bucket of ``x`` inside its interval (0..buckets-1)."""
    expr = F.lit(0).cast("long")
    for i in reversed(range(len(intervals))):
        lo, hi = intervals[i]
        width = (float(hi) - float(lo)) / buckets
        if math.isinf(width):
            # infinities are buckets of their own; a finite range too wide for a
            # double is halved at 0
            if math.isinf(float(lo)) or math.isinf(float(hi)):
                b = (F.when(x == F.lit(float("-inf")), 0).when(x == F.lit(float("inf")), 2)
                     .otherwise(1).cast("long"))
            else:
                b = (x > F.lit(0.0)).cast("long")
        elif not width > 0 or float(lo) + width == float(lo):
            # a range too narrow for the arithmetic (adjacent or subnormal
            # doubles): split into {lo} and (lo, hi], which always shrinks it
            b = (x > F.lit(lo)).cast("long")
        else:
            b = F.least(F.floor((x.cast("double") - F.lit(float(lo))) / F.lit(width)),
                        F.lit(buckets - 1)).cast("long")
        expr = F.when(iv == i, b).otherwise(expr)
    return expr


def _value(df: DataFrame, col: str) -> Column:
    """The column with NaN as NULL: neither is a value."""
    x = F.col(col)
    return F.when(~F.isnan(x), x) if df.schema[col].dataType.typeName() in ("double", "float") else x


def first_stats(df: DataFrame, col: str) -> tuple:
    """(count, min, max) of the values of ``col`` in one aggregation."""
    x = _value(df, col)
    r = df.agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    return int(r["n"]), r["lo"], r["hi"]


def order_statistics(df: DataFrame, col: str, ranks: list[int],
                     buckets: int = 1024, final_rows: int = 4096,
                     first: tuple | None = None) -> list[tuple]:
    """Values at 0-based ``ranks`` of ``col`` in ascending order; NULL and
    NaN have no rank, infinities do.

    Returns ``[(value, n_below_value), ...]`` aligned with ``ranks``; the
    second item counts the non-null values strictly smaller than the answer.
    """
    data = df.select(_value(df, col).alias("_x")).where(F.col("_x").isNotNull())
    xs = F.col("_x")
    n, lo, hi = first if first is not None else first_stats(df, col)
    for r in ranks:
        if r < 0 or r >= n:
            raise ValueError(f"rank {r} outside 0..{n - 1} of column {col}")
    searches = [_Search(r, lo, hi, 0, n) for r in ranks]
    for s in searches:
        if s.lo == s.hi:
            s.value, s.value_below = s.lo, 0

    # every pass puts the ends of an open interval into different buckets, so
    # each interval shrinks until it holds a single value
    while pending := [s for s in searches if s.open]:
        size = {(s.lo, s.hi): s.size for s in pending}
        intervals = sorted(size)
        small = [i for i, k in enumerate(intervals) if size[k] <= final_rows]
        large = [i for i, k in enumerate(intervals) if size[k] > final_rows]

        if small:
            # finish these intervals from their (value, count) list, which is
            # bounded by final_rows rows per interval
            ivs = [intervals[i] for i in small]
            siv = _interval_index(xs, ivs)
            rows = (data.where(siv.isNotNull())
                    .groupBy(siv.alias("_iv"), xs).agg(F.count(F.lit(1)).alias("c"))
                    .orderBy("_iv", "_x").collect())
            per = {}
            for r in rows:
                per.setdefault(ivs[r["_iv"]], []).append((r["_x"], r["c"]))
            for s in pending:
                if (s.lo, s.hi) not in per:
                    continue
                acc = s.below
                for v, c in per[(s.lo, s.hi)]:
                    if acc <= s.rank < acc + c:
                        s.value, s.value_below = v, acc
                        break
                    acc += c
        if large:
            ivs = [intervals[i] for i in large]
            liv = _interval_index(xs, ivs)
            b = _bucket(xs, liv, ivs, buckets)
            rows = (data.where(liv.isNotNull())
                    .groupBy(liv.alias("_iv"), b.alias("_b"))
                    .agg(F.count(F.lit(1)).alias("c"), F.min(xs).alias("mn"),
                         F.max(xs).alias("mx"))
                    .orderBy("_iv", "_b").collect())
            per = {}
            for r in rows:
                per.setdefault(ivs[r["_iv"]], []).append((r["c"], r["mn"], r["mx"]))
            for s in pending:
                if not s.open or (s.lo, s.hi) not in per:
                    continue
                acc = s.below
                for c, mn, mx in per[(s.lo, s.hi)]:
                    if acc <= s.rank < acc + c:
                        if mn == mx:
                            s.value, s.value_below = mn, acc
                        else:
                            s.lo, s.hi, s.below, s.size = mn, mx, acc, c
                        break
                    acc += c
    return [(s.value, s.value_below) for s in searches]


def _lerp(a: float, b: float, t: float) -> float:
    """Linear interpolation in numpy's form (exact at both ends)."""
    if math.isinf(a) or math.isinf(b):
        return a * (1 - t) + b * t
    return b - (b - a) * (1 - t) if t >= 0.5 else a + (b - a) * t


def exact_quantiles(df: DataFrame, col: str, probs: list[float]) -> list[float | None]:
    """Quantiles with linear interpolation between closest ranks
    (position = (n - 1) * p), as numpy/pandas ``quantile`` and Spark's exact
    ``percentile`` define them; NULL and NaN are left out."""
    first = first_stats(df, col)
    n = first[0]
    if n == 0:
        return [None] * len(probs)
    positions = [(n - 1) * p for p in probs]
    ranks = sorted({int(math.floor(h)) for h in positions} |
                   {int(math.ceil(h)) for h in positions})
    got = dict(zip(ranks, (v for v, _ in order_statistics(df, col, ranks, first=first))))
    out = []
    for h in positions:
        lo, hi = int(math.floor(h)), int(math.ceil(h))
        a, b = float(got[lo]), float(got[hi])
        out.append(a if lo == hi or a == b else _lerp(a, b, h - lo))
    return out


def ordered_cuts(df: DataFrame, order_col: str, tie_col: str, ranks: list[int],
                 first: tuple | None = None) -> list[tuple]:
    """The ``(order, tie)`` keys of the rows at 0-based ``ranks`` when rows
    are sorted by ``(order_col, tie_col)``: selection on the order column
    (all ranks in the same passes), then on the tie column among the rows
    sharing each selected order value. A NULL tie key comes last among equal
    order values; a rank that falls on one gets the last key before it (None
    if there is none)."""
    out = []
    for r, (t, below) in zip(ranks, order_statistics(df, order_col, ranks, first=first)):
        tied = df.where(F.col(order_col) == F.lit(t))
        stats = first_stats(tied, tie_col)
        at = min(r - below, stats[0] - 1)
        out.append((t, order_statistics(tied, tie_col, [at], first=stats)[0][0] if at >= 0 else None))
    return out


def ordered_cut(df: DataFrame, order_col: str, tie_col: str, rank: int) -> tuple:
    return ordered_cuts(df, order_col, tie_col, [rank])[0]
