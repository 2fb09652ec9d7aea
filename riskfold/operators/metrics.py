"""Model evaluation as queries over a score table ``(id, y, p)``.

Threshold metrics (precision/recall/F1, confusion matrix, the 16-point
sweep) are conditional sums in a single aggregation pass: no join, no sort.
Ranking metrics (ROC-AUC, step-wise average precision, ROC and PR curves)
reduce rows to one per distinct score and use ``running_totals_with_sums``.

Rows without a label or without a score (NULL, or a NaN score) take no part
in any of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SWEEP_THRESHOLDS
from ..session import materialize
from .prefix import grouped_running_totals, running_totals_with_sums

#: Scores that a task of ``packed_ranking`` sorts at once.
BLOCK_VALUES = 4_000_000


def evaluated(scores: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """The rows that have both a label and a score."""
    return scores.where(F.col(y).isNotNull() & F.col(p).isNotNull()
                        & ~F.isnan(F.col(p).cast("double")))


def _safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _counts_at(y: Column, p: Column, t: float, tag: str = "") -> list[Column]:
    pred = p >= F.lit(float(t))
    pos = y == 1
    return [F.sum((pred & pos).cast("long")).alias(f"tp{tag}"),
            F.sum((pred & ~pos).cast("long")).alias(f"fp{tag}"),
            F.sum((~pred & ~pos).cast("long")).alias(f"tn{tag}"),
            F.sum((~pred & pos).cast("long")).alias(f"fn{tag}")]


def _prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    return {"precision": _safe_div(tp, tp + fp),
            "recall": _safe_div(tp, tp + fn),
            "f1": _safe_div(2 * tp, 2 * tp + fp + fn)}


def confusion_matrix(scores: DataFrame, threshold: float, y: str = "y",
                     p: str = "p") -> DataFrame:
    """One row: tp, fp, tn, fn at ``p >= threshold``."""
    return evaluated(scores, y, p).agg(*_counts_at(F.col(y), F.col(p), threshold))


def prf_at_threshold(scores: DataFrame, threshold: float, y: str = "y",
                     p: str = "p") -> DataFrame:
    """Precision, recall, F1 with zero_division=0 (one row)."""
    cm = confusion_matrix(scores, threshold, y, p)
    m = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return cm.select(F.lit(float(threshold)).alias("threshold"),
                     m["precision"].alias("precision"), m["recall"].alias("recall"),
                     m["f1"].alias("f1"))


def confusion_pct(scores: DataFrame, threshold: float, y: str = "y", p: str = "p") -> DataFrame:
    cm = confusion_matrix(scores, threshold, y, p)
    total = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return (cm.select(F.expr("stack(4, 'TN', tn, 'FP', fp, 'FN', fn, 'TP', tp) AS (cell, n)"),
                      total.alias("_total"))
            .select("cell", "n", (F.col("n") * 100.0 / F.col("_total")).alias("pct")))


def threshold_sweep(scores: DataFrame, thresholds=SWEEP_THRESHOLDS, y: str = "y",
                    p: str = "p") -> DataFrame:
    """Metrics at each threshold, rounded to 5 digits (threshold shown
    rounded to 2). All thresholds are evaluated in one aggregation pass."""
    yc, pc = F.col(y), F.col(p)
    aggs = []
    for i, t in enumerate(thresholds):
        aggs += _counts_at(yc, pc, t, f"_{i}")
    wide = evaluated(scores, y, p).agg(*aggs)
    parts = ", ".join(f"{round(t, 2)}D, tp_{i}, fp_{i}, fn_{i}" for i, t in enumerate(thresholds))
    long = wide.selectExpr(f"stack({len(thresholds)}, {parts}) AS (threshold, tp, fp, fn)")
    m = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return long.select("threshold", F.round(m["f1"], 5).alias("f1"),
                       F.round(m["precision"], 5).alias("precision"),
                       F.round(m["recall"], 5).alias("recall"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """First threshold (ascending) with the highest rounded F1."""
    return sweep.orderBy(F.col("f1").desc(), F.col("threshold").asc()).limit(1)


def score_groups(scores: DataFrame, y: str = "y", p: str = "p",
                 with_totals: bool = False):
    """One row per distinct score with running totals from the top score
    down: n, pos, neg and their cumulative forms (and, with ``with_totals``,
    the grand totals, known without another pass)."""
    g = evaluated(scores, y, p).groupBy(F.col(p).alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("pos"))
    # running totals read their input more than once (count, range sample,
    # ranges): the per-score table is written once instead of re-aggregated
    g = materialize(g.withColumn("neg", F.col("n") - F.col("pos")), "score-groups")
    out, sums = running_totals_with_sums(g, "score", ["n", "pos", "neg"], descending=True)
    return (out, sums) if with_totals else out


def auc_roc(scores: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Tie-aware ROC-AUC: sum over score groups of neg * (pos above + pos/2),
    divided by P * N."""
    g = score_groups(scores, y, p)
    term = F.col("neg") * (F.col("cum_pos") - F.col("pos") + F.col("pos") / 2.0)
    s = g.agg(F.sum(term).alias("s"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return s.select(F.try_divide(F.col("s"), F.col("P").cast("double") * F.col("N")).alias("auc_roc"))


def average_precision(scores: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Step-wise AP: sum over score groups of (recall step) x precision."""
    g = score_groups(scores, y, p)
    term = F.col("pos") * F.col("cum_pos") / F.col("cum_n")
    s = g.agg(F.sum(term).alias("s"), F.sum("pos").alias("P"))
    return s.select(F.try_divide(F.col("s"), F.col("P")).alias("average_precision"))


def grouped_ranking(scores: DataFrame, by: str, y: str = "y", p: str = "p") -> DataFrame:
    """ROC-AUC and step-wise AP of many score columns at once: one row per group
    ``by`` (an iteration, a permuted feature) from one grouped running total."""
    g = evaluated(scores, y, p).where(F.col(by).isNotNull()).groupBy(by, F.col(p).alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("pos"))
    g = grouped_running_totals(materialize(g, "score-groups"), by, "score", ["n", "pos"], descending=True)
    neg = F.col("n") - F.col("pos")
    s = g.groupBy(by).agg(F.sum(neg * (F.col("cum_pos") - F.col("pos") + F.col("pos") / 2.0)).alias("a"),
                          F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")).alias("b"),
                          F.sum("pos").alias("P"), F.sum(neg).alias("N"))
    return s.select(by, F.try_divide("a", F.col("P").cast("double") * F.col("N")).alias("auc_roc"),
                    F.try_divide("b", F.col("P").cast("double")).alias("average_precision"))


def _score_blocks(names: Sequence[int], bounds: np.ndarray):
    """(y, scores) rows as blocks (group, range, rows, positives, and the block's
    distinct scores with their counts, ascending)."""
    schema = pa.schema([("_by", pa.int32()), ("_rng", pa.int32()), ("n", pa.int64()), ("pos", pa.int64()),
                        ("scores", pa.binary()), ("ns", pa.binary()), ("poss", pa.binary())])

    def block(y: np.ndarray, scores: np.ndarray) -> Iterator[tuple]:
        for k, name in enumerate(names):
            held = ~np.isnan(scores[:, k])
            s = scores[held, k]
            order = np.argsort(s)
            s, pos = s[order], y[held][order]
            first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]][:len(s)])
            ends = np.r_[first[1:], len(s)]
            before = np.r_[0, np.cumsum(pos)]
            one, n, pos = s[first], ends - first, before[ends] - before[first]
            cuts = np.r_[0, np.searchsorted(one, bounds[k]), len(one)]     # a bound belongs to the range above it
            for r in range(len(cuts) - 1):
                at = slice(cuts[r], cuts[r + 1])
                if cuts[r] < cuts[r + 1]:
                    yield (name, r, int(n[at].sum()), int(pos[at].sum()),
                           one[at].tobytes(), n[at].tobytes(), pos[at].tobytes())

    def packed(ys: list, scores: list) -> pa.RecordBatch:
        rows = list(block(np.concatenate(ys), np.concatenate(scores)))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)],
                                          schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ys, scores = [], []
        for b in batches:
            ys.append(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            scores.append(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(b), len(names)))
            if sum(map(len, ys)) * len(names) >= BLOCK_VALUES:
                yield packed(ys, scores)
                ys, scores = [], []
        if ys:
            yield packed(ys, scores)
    return run


def _range_terms():
    """The terms of AUC and AP of one (group, range), from the top score down. Local
    functions go to the workers by value: they need not have this package."""
    def run(blocks: pd.DataFrame) -> pd.DataFrame:
        s, n, pos = (np.concatenate([np.frombuffer(b, t) for b in blocks[c]])
                     for c, t in (("scores", np.float64), ("ns", np.int64), ("poss", np.int64)))
        order = np.argsort(-s)
        s, n, pos = s[order], n[order], pos[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        n, pos = np.add.reduceat(n, first), np.add.reduceat(pos, first)
        above_n, above_pos = (int(blocks[c].iloc[0]) for c in ("_above_n", "_above_pos"))
        cum_n, cum_pos, neg = np.cumsum(n) + above_n, np.cumsum(pos) + above_pos, n - pos
        return pd.DataFrame({"_by": blocks["_by"].iloc[:1], "a": [float(np.sum(neg * (cum_pos - pos + pos / 2.0)))],
                             "b": [float(np.sum(pos * (cum_pos / cum_n)))], "P": [int(pos.sum())], "N": [int(neg.sum())]})
    return run


def packed_ranking(scores: DataFrame, by: str, names: Sequence[int], ranges: int = 1,
                   sample: DataFrame | None = None, y: str = "y", p: str = "p") -> DataFrame:
    """``grouped_ranking`` of rows that hold the scores of all groups ``names`` as one
    array: tasks sort them a block at a time, so blocks of distinct scores are
    shuffled and not a row a score. A group is dealt over ``ranges`` ranges of its
    scores, which a ``sample`` of the rows cuts evenly; it changes no result."""
    names = [int(k) for k in names]
    held = scores.where(F.col(y).isNotNull() & F.col(p).isNotNull()).select(F.col(y).cast("long"), F.col(p).cast("array<double>"))
    bounds = np.empty((len(names), 0))
    if ranges > 1:
        some = [r[0] for r in sample.where(F.col(p).isNotNull()).select(F.col(p).cast("array<double>")).collect()]
        if some:
            cuts = np.nanquantile(np.array(some), np.arange(1, ranges) / ranges, axis=0, method="lower")
            bounds = np.nan_to_num(cuts.T)
    blocks = held.mapInArrow(_score_blocks(names, bounds), "_by int, _rng int, n long, pos long, scores binary, "
                                                           "ns binary, poss binary")
    if ranges > 1:
        blocks = materialize(blocks, "score-blocks")
        above = Window.partitionBy("_by").orderBy(F.col("_rng").desc()).rowsBetween(Window.unboundedPreceding, -1)
        off = (blocks.groupBy("_by", "_rng").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
               .select("_by", "_rng", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"_above_{c}") for c in ("n", "pos")]))
        blocks = blocks.join(off, ["_by", "_rng"])
    else:
        blocks = blocks.withColumns({f"_above_{c}": F.lit(0).cast("long") for c in ("n", "pos")})
    s = (blocks.groupBy("_by", "_rng").applyInPandas(_range_terms(), "_by int, a double, b double, P long, N long")
         .groupBy("_by").agg(*[F.sum(c).alias(c) for c in ("a", "b", "P", "N")]))
    return s.select(F.col("_by").alias(by), F.try_divide("a", F.col("P").cast("double") * F.col("N")).alias("auc_roc"),
                    F.try_divide("b", F.col("P").cast("double")).alias("average_precision"))


def roc_points(scores: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(threshold, fpr, tpr) per distinct score plus the origin (threshold
    NULL); collinear points are kept."""
    g, tot = score_groups(scores, y, p, with_totals=True)
    P, N = tot["pos"], tot["neg"]
    pts = g.select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("cum_neg").cast("double"), F.lit(float(N))).alias("fpr"),
        F.try_divide(F.col("cum_pos").cast("double"), F.lit(float(P))).alias("tpr"))
    origin = scores.sparkSession.createDataFrame([(None, 0.0, 0.0)],
                                                 "threshold double, fpr double, tpr double")
    return pts.unionByName(origin)


def pr_points(scores: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(threshold, precision, recall) from the top score down to the first
    score reaching full recall, plus the end point (recall 0, precision 1)."""
    g, tot = score_groups(scores, y, p, with_totals=True)
    P = tot["pos"]
    pts = (g.where(F.col("cum_pos") - F.col("pos") < F.lit(P))
           .select(F.col("score").alias("threshold"),
                   (F.col("cum_pos") / F.col("cum_n")).alias("precision"),
                   F.try_divide(F.col("cum_pos").cast("double"), F.lit(float(P))).alias("recall")))
    end = scores.sparkSession.createDataFrame([(None, 1.0, 0.0)],
                                              "threshold double, precision double, recall double")
    return pts.unionByName(end)


def nearest_pr_point(scores: DataFrame, threshold: float, y: str = "y", p: str = "p") -> DataFrame:
    """The PR point whose threshold is closest to ``threshold`` (lower
    threshold on ties)."""
    pts = pr_points(scores, y, p).where(F.col("threshold").isNotNull())
    return pts.orderBy(F.abs(F.col("threshold") - F.lit(float(threshold))),
                       F.col("threshold")).limit(1)


def score_summary(scores: DataFrame, p: str = "p") -> DataFrame:
    return scores.agg(F.min(p).alias("min_score"), F.max(p).alias("max_score"),
                      F.avg(p).alias("mean_score"))


def _round_half_up(x: float, digits: int) -> float:
    """Spark's ``round`` on a double: HALF_UP on the shortest decimal form."""
    from decimal import ROUND_HALF_UP, Decimal
    return float(Decimal(repr(float(x))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def eval_report(scores: DataFrame, y: str = "y", p: str = "p",
                thresholds=SWEEP_THRESHOLDS) -> DataFrame:
    """One row: AUC, AP, best sweep threshold and the metrics re-computed at
    that (rounded) threshold, confusion counts, rows and base rate; rounded
    to 5 digits like the reference report.

    Two passes over the scores: one aggregation yields the confusion counts
    at every sweep threshold and at its rounded value (the best threshold is
    then chosen from that bounded row), plus rows and base rate; AUC and AP
    come from one aggregation over the per-score running totals."""
    yc, pc = F.col(y), F.col(p)
    rounded = [round(t, 2) for t in thresholds]
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(yc.cast("double")).alias("r")]
    for i, t in enumerate(thresholds):
        aggs += _counts_at(yc, pc, t, f"_{i}") + _counts_at(yc, pc, rounded[i], f"_r{i}")
    wide = evaluated(scores, y, p).agg(*aggs).first()

    def div(a, b):
        return a / b if b else 0.0

    def f1(tag):
        tp, fp, fn = (int(wide[f"{k}{tag}"] or 0) for k in ("tp", "fp", "fn"))
        return div(2 * tp, 2 * tp + fp + fn)

    # first threshold with the highest 5-digit F1 (same rule as the sweep)
    best = max(range(len(thresholds)),
               key=lambda i: (_round_half_up(f1(f"_{i}"), 5), -i))
    t = rounded[best]
    tp, fp, tn, fn = (int(wide[f"{k}_r{best}"] or 0) for k in ("tp", "fp", "tn", "fn"))
    g = score_groups(scores, y, p)
    ranks = g.agg(
        F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") + F.col("pos") / 2.0)).alias("a"),
        F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")).alias("b"),
        F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    P, N = ranks["P"] or 0, ranks["N"] or 0
    auc = ranks["a"] / (P * N) if P and N else None
    ap = ranks["b"] / P if P else None
    row = (auc, ap, div(2 * tp, 2 * tp + fp + fn), div(tp, tp + fp), div(tp, tp + fn), t,
           tp, fp, tn, fn, int(wide["n"]), wide["r"])
    raw = scores.sparkSession.createDataFrame([row], (
        "auc_roc double, auprc double, f1 double, precision double, recall double, "
        "threshold_used double, tp long, fp long, tn long, fn long, val_rows long, "
        "fraud_rate_val double"))
    five = ["auc_roc", "auprc", "f1", "precision", "recall", "fraud_rate_val"]
    return raw.withColumns({c: F.round(c, 5) for c in five})


def class_weight(df: DataFrame, target: str = "isFraud") -> DataFrame:
    """neg / pos = (1 - p) / p of the target."""
    return df.agg(F.try_divide(F.sum((1 - F.col(target)).cast("double")),
                               F.sum(F.col(target).cast("double"))).alias("class_weight"))
