"""Weighted order statistics of many groups in shared passes.

The input is a table of (group number, value, weight): usually one row per key
and class instead of one per fact row, since a key's statistic repeats on all its
rows. Every pass is one aggregation over that table for all groups and all
probabilities together, with at most one row per (open interval, bucket) on the
driver:

* pass 0 buckets by the logarithm of the value (``PER_OCTAVE`` buckets between a
  number and its double), which needs no bounds; its sums give count, mean, std,
  min and max, and every wanted rank falls into one bucket;
* the next passes refine only the buckets that hold a wanted rank, bounded by
  their observed minima and maxima, until these hold ``FINAL_ROWS`` rows or less,
  which are then listed by value.

A value held by any share of the rows resolves at once. NULL and NaN are no
values, infinities are; rows of weight 0 have no rank. Weights are whole numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import _lerp

#: Buckets of pass 0 between x and 2x, and of one open interval afterwards.
PER_OCTAVE, BUCKETS = 64, 1024
#: Rows of open intervals that a last pass may list by value.
FINAL_ROWS = 16_384
#: Groups of one call: their bucket rows are what the driver sees.
MAX_GROUPS = 4_096
_EDGE = 131_072         # above PER_OCTAVE * the largest binary exponent, by size
#: Share of the squares around the buckets' centres below which the variance is
#: summed again around the mean, in a pass of its own.
_LOST = 1e-7


@dataclass
class GroupStats:
    """Count, moments and quantiles of one group; ``sums`` over all its rows."""

    n: int = 0
    mean: float | None = None
    std: float | None = None
    lo: float | None = None
    hi: float | None = None
    quantiles: list = field(default_factory=list)
    sums: dict = field(default_factory=dict)


@dataclass
class _Open:
    group: int
    lo: float
    hi: float
    below: int              # weight below the interval
    rows: int
    ranks: list


def _summary() -> list[Column]:
    """What a pass tells of a bucket; with two rows, the weight at ``mn`` tells both."""
    return [F.count(F.lit(1)).alias("rows"), F.sum("w").alias("w"), F.min("x").alias("mn"), F.max("x").alias("mx"),
            F.min_by("w", "x").alias("w_mn")]


def _octave(x: Column) -> Column:
    """A monotone bucket number by sign and logarithm."""
    size = F.least(F.floor(F.log2(F.abs(x)) * PER_OCTAVE), F.lit(_EDGE)) + _EDGE + 1
    return F.when(x == 0, F.lit(0).cast("long")).when(x > 0, size).otherwise(-size).cast("long")


def _centre(bucket: Column) -> Column:
    """A number in the bucket, to take sums of squares around."""
    e = (F.abs(bucket) - _EDGE - 1) / PER_OCTAVE
    return F.when((bucket == 0) | (e >= 1024), 0.0).otherwise(F.signum(bucket.cast("double")) * F.pow(F.lit(2.0), e))


def _inside(iv: _Open) -> tuple[int, float, float, float]:
    """How an interval is cut: (form, start, width, pivot). Form 0: equal widths;
    1: above the pivot or not; 2: finite or which infinity."""
    width = (iv.hi - iv.lo) / BUCKETS
    if math.isinf(iv.lo) or math.isinf(iv.hi):
        return 2, 0.0, 1.0, 0.0
    if math.isinf(width):
        return 1, 0.0, 1.0, 0.0
    if not width > 0 or iv.lo + width == iv.lo:
        return 1, 0.0, 1.0, iv.lo
    return 0, iv.lo, width, 0.0


def _refine(data: DataFrame, opened: list[_Open], n_groups: int, listed: bool) -> list:
    """One pass over the open intervals: rows (interval, bucket or value, rows, weight, min, max)."""
    per_group: list[list] = [[] for _ in range(n_groups)]
    for k, iv in enumerate(opened):
        form, start, width, pivot = _inside(iv)
        per_group[iv.group].append((k, iv.lo, iv.hi, form, start, width, pivot))
    kind = "array<struct<k:int,lo:double,hi:double,form:int,start:double,width:double,pivot:double>>"

    def literal(rows):
        return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("k", "lo", "hi", "form", "start", "width", "pivot"), r)])
                         for r in rows]).cast(kind)

    intervals = F.array(*[literal(rows) for rows in per_group])
    x = F.col("x")
    rows = data.withColumn("iv", F.get(F.filter(F.get(intervals, F.col("g")), lambda i: (x >= i.lo) & (x <= i.hi)), F.lit(0)))
    rows = rows.where(F.col("iv").isNotNull())
    if listed:
        at = x
    else:
        form = F.col("iv.form")
        at = (F.when(form == 0, F.least(F.floor((x - F.col("iv.start")) / F.col("iv.width")), F.lit(BUCKETS - 1)))
              .when(form == 1, (x > F.col("iv.pivot")).cast("long"))
              .otherwise(F.when(x == float("-inf"), 0).when(x == float("inf"), 2).otherwise(1)))
    return (rows.groupBy(F.col("iv.k").alias("k"), at.alias("b"))
            .agg(*_summary()).collect())


def _square(v: float) -> float:
    return v * v


def weighted_stats(table: DataFrame, value: Column, weight: Column | None = None, group: Column | None = None,
                   n_groups: int = 1, probs: list[float] = (), sums: dict[str, Column] | None = None) -> list[GroupStats]:
    """Statistics of groups 0..n_groups-1 (``group`` is their number; rows of
    another number or NULL take no part). Quantiles interpolate linearly between
    the closest ranks, each row standing for ``weight`` equal ones. ``sums``
    are summed over all rows of the group, whatever their value."""
    if n_groups > MAX_GROUPS:
        raise ValueError(f"{n_groups} groups, at most {MAX_GROUPS} in one call")
    sums = sums or {}
    x = value.cast("double")
    data = table.select((group if group is not None else F.lit(0)).cast("int").alias("g"),
                        F.when(~F.isnan(x), x).alias("x"),
                        (weight if weight is not None else F.lit(1)).cast("long").alias("w"),
                        *[c.alias(f"s_{k}") for k, c in sums.items()])
    data = data.where(F.col("g").between(0, n_groups - 1))
    b = _octave(F.col("x"))
    d = F.col("x") - _centre(F.col("b"))
    first = (data.withColumn("b", F.when(F.col("x").isNotNull() & (F.col("w") > 0), b)).groupBy("g", "b")
             .agg(*_summary(), F.sum(F.col("w") * F.col("x")).alias("s1"), F.sum(F.col("w") * d).alias("d1"),
                  F.sum(F.col("w") * d * d).alias("d2"), *[F.sum(f"s_{k}").alias(f"s_{k}") for k in sums])
             .collect())
    out = [GroupStats(sums={k: None for k in sums}) for _ in range(n_groups)]
    found: dict[tuple[int, int], float] = {}
    buckets: list[list] = [[] for _ in range(n_groups)]
    for r in first:
        st = out[r["g"]]
        for k in sums:
            if r[f"s_{k}"] is not None:
                st.sums[k] = (st.sums[k] or 0) + r[f"s_{k}"]
        if r["b"] is not None:
            buckets[r["g"]].append(r)
    opened: list[_Open] = []
    close: dict[int, float] = {}        # groups whose values lie too close together for the sums of squares
    for g, rows in enumerate(buckets):
        if not rows:
            continue
        rows.sort(key=lambda r: r["b"])
        st = out[g]
        st.n = sum(r["w"] for r in rows)
        st.lo, st.hi = rows[0]["mn"], rows[-1]["mx"]
        st.mean = math.fsum(r["s1"] for r in rows) / st.n if not (math.isinf(st.lo) or math.isinf(st.hi)) else st.lo + st.hi
        if st.n > 1:
            # within a bucket around its own mean, between buckets around the whole mean
            within = sum(max(r["d2"] - r["d1"] * r["d1"] / r["w"], 0.0) for r in rows if r["mn"] != r["mx"])
            between = sum(r["w"] * _square(r["s1"] / r["w"] - st.mean) for r in rows)
            st.std = math.sqrt((within + between) / (st.n - 1)) if st.lo != st.hi else 0.0
            if st.lo != st.hi and within + between < _LOST * sum(r["d2"] for r in rows):
                close[g] = st.mean
        wanted = sorted({int(f((st.n - 1) * p)) for p in probs for f in (math.floor, math.ceil)})
        opened += _located(g, wanted, rows, 0, found)
    if close:
        means = F.create_map(*[F.lit(v) for pair in close.items() for v in pair])
        off = F.col("x") - F.element_at(means, F.col("g"))
        for r in (data.where(F.col("g").isin(*close)).groupBy("g").agg(F.sum(F.col("w") * off * off).alias("d2"))
                  .collect()):
            out[r["g"]].std = math.sqrt(r["d2"] / (out[r["g"]].n - 1))
    while opened:
        listed = sum(iv.rows for iv in opened) <= FINAL_ROWS
        parts: list[list] = [[] for _ in opened]
        for r in _refine(data, opened, n_groups, listed):
            parts[r["k"]].append(r)
        after = []
        for iv, rows in zip(opened, parts):
            rows.sort(key=lambda r: r["b"])
            after += _located(iv.group, iv.ranks, rows, iv.below, found)
        opened = after
    for g, st in enumerate(out):
        for p in probs:
            if not st.n:
                st.quantiles.append(None)
                continue
            h = (st.n - 1) * p
            a, z = found[g, math.floor(h)], found[g, math.ceil(h)]
            st.quantiles.append(a if a == z else _lerp(a, z, h - math.floor(h)))
    return out


def _located(group: int, ranks: list[int], rows: list, below: int, found: dict) -> list[_Open]:
    """Ranks whose bucket holds one value, or two rows, are found; the others open their bucket."""
    opened, at = [], iter(ranks)
    rank = next(at, None)
    for r in rows:
        mine = []
        while rank is not None and rank < below + r["w"]:
            if r["mn"] == r["mx"] or r["rows"] == 2:
                found[group, rank] = float(r["mn"] if r["mn"] == r["mx"] or rank < below + r["w_mn"] else r["mx"])
            else:
                mine.append(rank)
            rank = next(at, None)
        if mine:
            opened.append(_Open(group, float(r["mn"]), float(r["mx"]), below, r["rows"], mine))
        below += r["w"]
    return opened
