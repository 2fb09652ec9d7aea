"""Registered queries, part 3: evaluation metrics over the fixture scores."""

from __future__ import annotations

from ..config import SWEEP_THRESHOLDS
from ..operators import metrics as M
from ..sources.fixtures import duckdb_prefix
from .fixture import fixture

Q: dict = {}


def reg(key, fn, sql, floats=()):
    Q[key] = (fn, sql, list(floats))


def _scores(spark, sf):
    return fixture(spark, sf).scores


# oracle building blocks: per-score groups with running totals from the top
_GROUPS = """g AS (SELECT p, CAST(count(*) AS BIGINT) AS n, CAST(sum(y) AS BIGINT) AS pos,
  CAST(count(*) - sum(y) AS BIGINT) AS neg FROM scores GROUP BY p),
c AS (SELECT *,
  CAST(sum(n) OVER w AS DOUBLE) AS cum_n, CAST(sum(pos) OVER w AS DOUBLE) AS cum_pos,
  CAST(sum(neg) OVER w AS DOUBLE) AS cum_neg
  FROM g WINDOW w AS (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
tot AS (SELECT CAST(sum(pos) AS DOUBLE) AS tot_pos, CAST(sum(neg) AS DOUBLE) AS tot_neg FROM g),
th AS (SELECT * FROM (VALUES {values}) t(i, t)),
cm AS (SELECT th.i, th.t,
  CAST(sum(CASE WHEN p >= th.t AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN p >= th.t AND y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN p < th.t AND y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
  CAST(sum(CASE WHEN p < th.t AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn
  FROM th, scores GROUP BY th.i, th.t),
sweep AS (SELECT round(t, 2) AS threshold,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 5) AS f1,
  round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / CAST(tp + fp AS DOUBLE) END, 5) AS precision,
  round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / CAST(tp + fn AS DOUBLE) END, 5) AS recall
  FROM cm),
best AS (SELECT threshold FROM sweep ORDER BY f1 DESC, threshold ASC LIMIT 1),
bcm AS (SELECT
  CAST(sum(CASE WHEN p >= b.threshold AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN p >= b.threshold AND y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN p < b.threshold AND y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
  CAST(sum(CASE WHEN p < b.threshold AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn
  FROM scores, best b),
auc AS (SELECT sum(neg * (cum_pos - pos + pos / 2.0)) / (max(tot.tot_pos) * max(tot.tot_neg)) AS v
  FROM c, tot),
ap AS (SELECT sum(pos * cum_pos / cum_n) / max(tot.tot_pos) AS v FROM c, tot),
pr AS (SELECT p AS threshold, cum_pos / cum_n AS precision, cum_pos / tot.tot_pos AS recall
  FROM c, tot WHERE cum_pos - pos < tot.tot_pos)"""


def msql(body: str, thresholds=SWEEP_THRESHOLDS, fixed=None) -> str:
    ts = fixed if fixed is not None else thresholds
    values = ", ".join(f"({i}, CAST('{t!r}' AS DOUBLE))" for i, t in enumerate(ts))
    return duckdb_prefix(_GROUPS.format(values=values)) + body


reg("auc_roc", lambda s, sf: M.auc_roc(_scores(s, sf)), msql("SELECT v AS auc_roc FROM auc"),
    ["auc_roc"])
reg("average_precision", lambda s, sf: M.average_precision(_scores(s, sf)),
    msql("SELECT v AS average_precision FROM ap"), ["average_precision"])
reg("prf_at_threshold", lambda s, sf: M.prf_at_threshold(_scores(s, sf), 0.5),
    msql("""SELECT t AS threshold,
  CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / CAST(tp + fp AS DOUBLE) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / CAST(tp + fn AS DOUBLE) END AS recall,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1
FROM cm""", fixed=[0.5]), ["precision", "recall", "f1"])
reg("confusion_matrix", lambda s, sf: M.confusion_matrix(_scores(s, sf), 0.5),
    msql("SELECT tp, fp, tn, fn FROM cm", fixed=[0.5]))
reg("confusion_pct", lambda s, sf: M.confusion_pct(_scores(s, sf), 0.5),
    msql("""SELECT cell, n, n * 100.0 / (tp + fp + tn + fn) AS pct FROM (
  SELECT 'TN' AS cell, tn AS n, * FROM cm UNION ALL SELECT 'FP', fp, * FROM cm
  UNION ALL SELECT 'FN', fn, * FROM cm UNION ALL SELECT 'TP', tp, * FROM cm) x""",
         fixed=[0.5]), ["pct"])
reg("threshold_sweep", lambda s, sf: M.threshold_sweep(_scores(s, sf)),
    msql("SELECT threshold, f1, precision, recall FROM sweep"),
    ["threshold", "f1", "precision", "recall"])
reg("best_threshold", lambda s, sf: M.best_threshold(M.threshold_sweep(_scores(s, sf))),
    msql("SELECT threshold, f1, precision, recall FROM sweep ORDER BY f1 DESC, threshold "
         "LIMIT 1"), ["threshold", "f1", "precision", "recall"])
reg("roc_points", lambda s, sf: M.roc_points(_scores(s, sf)),
    msql("""SELECT p AS threshold, cum_neg / tot.tot_neg AS fpr, cum_pos / tot.tot_pos AS tpr FROM c, tot
UNION ALL SELECT CAST(NULL AS DOUBLE), 0.0, 0.0"""), ["threshold", "fpr", "tpr"])
reg("pr_points", lambda s, sf: M.pr_points(_scores(s, sf)),
    msql("SELECT threshold, precision, recall FROM pr\nUNION ALL SELECT CAST(NULL AS DOUBLE), "
         "1.0, 0.0"), ["threshold", "precision", "recall"])


def _nearest(spark, sf):
    sc = _scores(spark, sf)
    best = M.best_threshold(M.threshold_sweep(sc)).first()["threshold"]
    return M.nearest_pr_point(sc, best)


reg("nearest_pr_point", _nearest, msql("""SELECT pr.threshold, pr.precision, pr.recall
FROM pr, best ORDER BY abs(pr.threshold - best.threshold), pr.threshold LIMIT 1"""),
    ["threshold", "precision", "recall"])
reg("score_summary", lambda s, sf: M.score_summary(_scores(s, sf)),
    msql("SELECT min(p) AS min_score, max(p) AS max_score, avg(p) AS mean_score FROM scores"),
    ["min_score", "max_score", "mean_score"])
reg("eval_report", lambda s, sf: M.eval_report(_scores(s, sf)), msql("""SELECT
  round((SELECT v FROM auc), 5) AS auc_roc, round((SELECT v FROM ap), 5) AS auprc,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 5) AS f1,
  round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / CAST(tp + fp AS DOUBLE) END, 5) AS precision,
  round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / CAST(tp + fn AS DOUBLE) END, 5) AS recall,
  (SELECT threshold FROM best) AS threshold_used, tp, fp, tn, fn,
  (SELECT count(*) FROM scores) AS val_rows,
  round((SELECT avg(y) FROM scores), 5) AS fraud_rate_val
FROM bcm"""), ["auc_roc", "auprc", "f1", "precision", "recall", "threshold_used",
               "fraud_rate_val"])
reg("class_weight", lambda s, sf: M.class_weight(fixture(s, sf).train),
    duckdb_prefix() + "SELECT sum(1 - isFraud) / CAST(sum(isFraud) AS DOUBLE) AS class_weight "
    "FROM train", ["class_weight"])


# ---- staged margins: the ranking metrics of every iteration ------------------------------
#: Margins of eight stages over the val rows: each stage adds a number that follows
#: from the row, as a tree's leaf would.
_STAGES = """stage AS (SELECT TransactionID AS id, isFraud AS y, i AS iteration,
  CAST(((TransactionID * 13 + k * (7 + i)) % 50) + isFraud * (i % 4) * 8 AS BIGINT) AS step
  FROM {base} CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6), (7), (8)) t(i) WHERE split = 'val'),
margins AS (SELECT id, y, iteration,
  CAST(sum(step) OVER (PARTITION BY id ORDER BY iteration) AS DOUBLE) / 100 AS margin FROM stage)"""


def _staged(spark, sf):
    margins = spark.sql("WITH " + _STAGES.format(base="{base}") + " SELECT * FROM margins", base=fixture(spark, sf).base)
    return M.grouped_ranking(margins, "iteration", p="margin")


reg("staged_auc", _staged, duckdb_prefix(_STAGES.format(base="base") + """,
sg AS (SELECT iteration, margin, count(*) AS n, sum(y) AS pos FROM margins GROUP BY iteration, margin),
sc AS (SELECT *, n - pos AS neg, sum(n) OVER w AS cum_n, sum(pos) OVER w AS cum_pos FROM sg
  WINDOW w AS (PARTITION BY iteration ORDER BY margin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")
    + "SELECT iteration, sum(neg * (cum_pos - pos + pos / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS auc_roc, "
      "sum(pos * CAST(cum_pos AS DOUBLE) / cum_n) / sum(pos) AS average_precision FROM sc GROUP BY iteration",
    ["auc_roc", "average_precision"])
