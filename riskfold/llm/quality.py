"""Operator 10: a regularised quadratic discriminant over document statistics.

Each text is reduced to ``FEATURES`` transformed statistics in one vectorised
pass over its bytes, written once per call. The fit is exact over all labelled
training rows: per class a count, a sum and a cross-product matrix (bounded:
two classes x d x d numbers), aggregated by Spark, from which the class means
and shrunken covariances follow. Their Cholesky factors are computed once and
reused for every row: a score is the logistic of the difference of the two
Mahalanobis log densities plus the log prior odds.

Defined results: a null text is empty; empty texts have all-zero statistics
and are scored like any other. Null labels and labels other than 0 and 1 are
not used; of several labels for one doc_id each counts. Without training rows of
one class every score is the share of label 1 (0.5 without any). An empty table
gives no rows. Only the text enters a score.
"""

from __future__ import annotations

from dataclasses import dataclass

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _WS, materialize, release, releasing, ship_code, text_chunks, word_table

THRESHOLD = 0.3
#: Shrinkage of a class covariance towards its diagonal, and a ridge on that.
SHRINK, RIDGE = 0.1, 1e-3
FEATURES = ("log_bytes", "log_words", "word_mean", "word_sd", "upper", "digit", "space_run", "newline",
            "stop", "comma", "pipe", "symbol", "bang", "other_punct", "high", "unique_words",
            "top_word", "repeat_next", "long_words", "line_repeat", "alpha_words")


def _lut(chars: str) -> np.ndarray:
    x = np.zeros(256, np.float64)
    x[[ord(c) for c in chars]] = 1
    return x


_CLASSES = {
    "upper": _lut("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digit": _lut("0123456789"), "newline": _lut("\n"),
    "stop": _lut("."), "comma": _lut(","), "pipe": _lut("|<>{}[]\\"), "symbol": _lut("#$%&*@^~=_+/"),
    "bang": _lut("!?"), "other_punct": _lut("\"'();:-`"),
}


def _per_row(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[off[1:]] - total[off[:-1]]


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(rows, features) of the texts in ``data``; shares by square root, sizes by log."""
    n = len(off) - 1
    size = np.diff(off).astype(float)
    starts, ends, rows, h = word_table(data, off)
    words = np.bincount(rows, minlength=n).astype(float)
    length = (ends - starts).astype(float)
    w1, b1 = np.maximum(words, 1), np.maximum(size, 1)
    mean = np.bincount(rows, length, n) / w1
    sd = np.sqrt(np.maximum(np.bincount(rows, length ** 2, n) / w1 - mean ** 2, 0))
    out = {"log_bytes": np.log1p(size), "log_words": np.log1p(words), "word_mean": np.log1p(mean),
           "word_sd": np.log1p(sd), "long_words": np.sqrt(np.bincount(rows, length > 20, n) / w1)}
    for k, lut in _CLASSES.items():
        out[k] = np.sqrt(_per_row(lut[data], off) / b1)
    out["high"] = np.sqrt(_per_row((data >= 128).astype(float), off) / b1)
    blank = _WS[data].astype(float)
    run = blank.copy()
    run[1:] *= blank[:-1]
    out["space_run"] = np.sqrt(_per_row(run, off) / b1)
    # words by (row, hash): distinct share and the share of the commonest
    order = np.lexsort((h, rows))
    r, x = rows[order], h[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (x[1:] != x[:-1])
    at = np.flatnonzero(new)
    out["unique_words"] = np.bincount(r[at], minlength=n) / w1
    top = np.zeros(n)
    if len(at):
        np.maximum.at(top, r[at], np.diff(np.append(at, len(r))).astype(float))
    out["top_word"] = np.sqrt(top / w1)
    same = np.zeros(len(rows), bool)
    same[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
    out["repeat_next"] = np.sqrt(np.bincount(rows, same, n) / w1)
    # lines: a line's key is the sum of its words' hashes with their places
    nl = _per_line_repeat(data, off, starts, rows, h, n)
    out["line_repeat"] = nl
    letters = ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122)) | (data >= 128)
    inside = np.concatenate([[0.0], np.cumsum(letters.astype(float))])
    pure = (inside[ends] - inside[starts]) >= length - 1
    out["alpha_words"] = np.bincount(rows, pure, n) / w1
    return np.stack([out[k] for k in FEATURES], 1)


def _per_line_repeat(data, off, starts, rows, h, n):
    """Square root of the share of a text's lines that repeat an earlier one."""
    if not len(starts):
        return np.zeros(n)
    line = np.cumsum(data == 10)[starts] + rows       # never falls, changes with each text
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(new)
    place = np.arange(len(line)) - np.repeat(at, np.diff(np.append(at, len(line))))
    key = np.add.reduceat(h * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)), at)
    r = rows[at]
    order = np.lexsort((key, r))
    rr, kk = r[order], key[order]
    rep = np.zeros(len(rr), bool)
    rep[1:] = (rr[1:] == rr[:-1]) & (kk[1:] == kk[:-1])
    return np.sqrt(np.bincount(rr, rep, n) / np.maximum(np.bincount(rr, minlength=n), 1))


@dataclass(frozen=True)
class Model:
    """Class means and the inverse Cholesky factors of their covariances."""
    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_odds: float
    share: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.means):
            return np.full(len(x), self.share)
        dens = []
        for m, f, d in zip(self.means, self.factors, self.log_dets):
            z = (x - m) @ f.T
            dens.append(-0.5 * (z * z).sum(1) - 0.5 * d)
        diff = np.clip(dens[1] - dens[0] + self.log_odds, -60, 60)
        return 1 / (1 + np.exp(-diff))


def fit_model(stats: DataFrame, shrink: float = SHRINK) -> Model:
    """Fit on rows (label int, x array<double>) by one aggregation of bounded
    size: per task and class a count, a sum and a cross-product matrix."""
    d = len(FEATURES)

    def partial(batches):
        total = {}
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, d)
            y = b.column(0).to_numpy()
            for c in (0, 1):
                z = x[y == c]
                if len(z):
                    n, s, q = total.get(c, (0, 0.0, 0.0))
                    total[c] = (n + len(z), s + z.sum(0), q + z.T @ z)
        if total:
            yield pa.record_batch([pa.array(list(total), pa.int32()),
                                   pa.array([v[0] for v in total.values()], pa.int64()),
                                   pa.array([np.concatenate([v[1], v[2].ravel()]) for v in total.values()],
                                            pa.list_(pa.float64()))], names=["label", "n", "m"])

    parts = stats.filter("label in (0, 1)").select("label", "x").mapInArrow(partial, "label int, n long, m array<double>")
    # one row per class and position of the matrix: (d + d^2) x 2 rows
    sums = (parts.select("label", "n", F.posexplode("m").alias("k", "v"))
            .groupBy("label", "k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect())
    acc = {c: (0, np.zeros(d + d * d)) for c in (0, 1)}
    for r in sums:
        acc[r.label] = (r.n, acc[r.label][1])
        acc[r.label][1][r.k] = r.v
    n0, n1 = acc[0][0], acc[1][0]
    if not n0 or not n1:
        share = 0.5 if n0 + n1 == 0 else n1 / (n0 + n1)
        return Model(np.zeros((0, d)), np.zeros((0, d, d)), np.zeros(0), 0.0, share)
    mean = {c: acc[c][1][:d] / acc[c][0] for c in (0, 1)}
    cov = {c: acc[c][1][d:].reshape(d, d) / acc[c][0] - np.outer(mean[c], mean[c]) for c in (0, 1)}
    pooled = (n0 * cov[0] + n1 * cov[1]) / (n0 + n1)
    means, factors, dets = [], [], []
    for c in (0, 1):
        s = (1 - shrink) * cov[c] + shrink * np.diag(np.diag(pooled)) + RIDGE * np.eye(d)
        low = np.linalg.cholesky((s + s.T) / 2)
        means.append(mean[c])
        factors.append(np.linalg.inv(low))
        dets.append(2 * np.log(np.diag(low)).sum())
    return Model(np.array(means), np.array(factors), np.array(dets), float(np.log(n1 / n0)), n1 / (n0 + n1))


def document_statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns and x, the statistics of the whole text."""
    ship_code(docs.sparkSession)
    d = len(FEATURES)
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("_op10_text"))

    def run(batches):
        for b in batches:
            for a, data, off in text_chunks(b.column(len(keep))):
                x = statistics(data, off)
                lists = pa.ListArray.from_arrays(np.arange(0, d * len(x) + 1, d, dtype=np.int32), x.ravel())
                yield pa.record_batch([*[b.column(k).slice(a, len(x)) for k in range(len(keep))], lists],
                                      names=[*keep, "x"])

    schema = src.select(*[F.col(f"`{c}`") for c in keep], F.lit(None).cast("array<double>").alias("x")).schema
    return src.mapInArrow(releasing(run), schema)


def held_out(id_col):
    """crc32 of the id as text, mod 5, is 0 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted, one row per document."""
    ids = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    stats = materialize(document_statistics(ids, ["doc_id"]), "op10-statistics")
    marks = labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("label"))
    model = fit_model(stats.filter(~held_out(F.col("doc_id"))).join(marks, "doc_id"))
    return score_statistics(stats, model)


def score_statistics(stats: DataFrame, model: Model) -> DataFrame:
    d = len(FEATURES)

    def run(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, d)
            s = model.score(x)
            yield pa.record_batch([b.column(0), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))],
                                  names=["doc_id", "score", "predicted"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    return (stats.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"))


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier predicts 1, all columns as they
    are: the texts alone pass the scorer once more, nothing is shuffled."""
    ids = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    marks = labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("label"))
    stats = materialize(document_statistics(ids, ["doc_id"]), "op10-statistics")
    model = fit_model(stats.filter(~held_out(F.col("doc_id"))).join(marks, "doc_id"))

    @F.arrow_udf("boolean")
    def accepted(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            keep = np.zeros(len(t), bool)
            for a, data, off in text_chunks(t):
                keep[a:a + len(off) - 1] = model.score(statistics(data, off)) >= THRESHOLD
            yield pa.array(keep)
        release()

    return docs.filter(accepted(F.col(f"`{text_col}`").cast("string")))
