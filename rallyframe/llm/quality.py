"""Operator 4: document quality by a regularised quadratic discriminant.

Each text becomes a vector of transformed statistics (lengths, character classes, repetition of words
and lines, compressibility).  Each class has its mean and a covariance shrunk towards the pooled one
and towards a multiple of the identity; the score is the difference of the classes' log densities,
from Mahalanobis distances through Cholesky factors computed once, put through a logistic curve that
maps it to a probability.  How much to shrink and the curve are chosen on folds of the training rows.

All labelled rows outside the held-out part are learned from: tasks send on sums of moments only.

Defined cases: null and empty texts have the statistics of an empty text and get its score; repeated
rows are scored each; without labels of both classes every score is the share of label 1 (0.0 without
labels).
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.llm.common import id_text, materialise, parts_of
from rallyframe.llm.words import LOWER, held_out, logistic, training_labels

THRESHOLD = 0.7
FOLDS = 5
#: (towards the pooled covariance, towards the identity)
SHRINKAGES = tuple((a, b) for a in (0.02, 0.1, 0.3, 0.6, 1.0) for b in (0.01, 0.1))
#: Log-density differences are gathered in so many bins, for the choice and the curve.
BINS, WIDEST = 2000, 200.0

NAMES = (
    "log_chars", "log_words", "word_length", "symbols", "upper", "digits", "distinct_words", "repeated_next",
    "distinct_lines", "compressed", "short_words", "bars", "stops", "marks_at_ends", "line_length", "top_word",
)
D = len(NAMES)

_CLASS = np.zeros((256, 5))
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = (
        33 <= _b < 127 and not _c.isalnum() and _c not in ".,;:'\"-()?!|",
        65 <= _b < 91,
        48 <= _b < 58,
        _c == "|",
        _c in ".?",
    )


def statistics(text: str) -> list[float]:
    """The statistics of one text, each transformed to a bounded or logarithmic scale."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * D
    n = len(raw)
    symbols, upper, digits, bars, stops = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS
    words = raw.translate(LOWER).split()
    m = max(1, len(words))
    kinds = set(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    next_same = sum(map(bytes.__eq__, words, words[1:]))
    short = sum(len(w) <= 3 for w in words)
    ends = sum(w[-1:] in b"!*%$#&" for w in words)
    top = max(Counter(words).values(), default=0)
    return [
        np.log1p(n),
        np.log1p(len(words)),
        np.log1p((n - m) / m),
        np.sqrt(symbols / n),
        np.sqrt(upper / n),
        np.sqrt(digits / n),
        np.log(max(1, len(kinds))) / np.log(m) if m > 1 else 1.0,
        np.sqrt(next_same / m),
        len(set(lines)) / k,
        len(zlib.compress(raw, 1)) / (n + 16),
        short / m,
        np.sqrt(bars / n),
        np.sqrt(stops / m),
        np.sqrt(ends / m),
        np.log1p(m / k),
        top / m,
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, x (array of ``NAMES``) for every row; no shuffle."""

    def run(batches):
        for b in parts_of(batches, 1):
            rows = [statistics(t) for t in b.column(1).to_pylist()]
            flat = np.nan_to_num(np.array(rows, np.float64).reshape(-1))
            x = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, D), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), x], ["doc_id", "x"])

    return id_text(docs).mapInArrow(run, "doc_id long, x array<double>")


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, D)


def _moments(known: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """(label, fold) -> count, sums and products; summed in tasks, then by Spark: FOLDS * 2 * (1 + D + D * D) rows."""

    def run(batches):
        total: dict = {}
        for b in batches:
            x, label, fold = _matrix(b.column(0)), b.column(1).to_numpy(), b.column(2).to_numpy()
            for c in (0, 1):
                for f in range(FOLDS):
                    part = x[(label == c) & (fold == f)]
                    if len(part):
                        total[c, f] = total.get((c, f), 0) + np.concatenate([[len(part)], part.sum(0), (part.T @ part).ravel()])
        size = 1 + D + D * D
        keys = list(total)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat([c for c, _ in keys], size).astype(np.int32)),
                pa.array(np.repeat([f for _, f in keys], size).astype(np.int32)),
                pa.array(np.tile(np.arange(size), len(keys)).astype(np.int32)),
                pa.array(np.concatenate([total[k] for k in keys]) if keys else np.zeros(0)),
            ],
            ["label", "fold", "k", "v"],
        )

    sums = known.select("x", "label", "fold").mapInArrow(run, "label int, fold int, k int, v double")
    out: dict = {}
    for r in sums.groupBy("label", "fold", "k").agg(F.sum("v").alias("v")).collect():
        out.setdefault((r["label"], r["fold"]), np.zeros(1 + D + D * D))[r["k"]] = r["v"]
    return out


class Discriminant:
    """Class means and the Cholesky factors of their shrunk covariances."""

    def __init__(self, by_class: list[np.ndarray], shrink: tuple[float, float]):
        n = np.array([m[0] for m in by_class])
        means = [m[1 : 1 + D] / m[0] for m in by_class]
        covs = [m[1 + D :].reshape(D, D) / m[0] - np.outer(u, u) for m, u in zip(by_class, means)]
        pooled = (n[0] * covs[0] + n[1] * covs[1]) / n.sum()
        scale = np.sqrt(np.maximum(np.diag(pooled), 1e-8))
        a, b = shrink
        self.scale, self.prior, self.parts = scale, float(np.log(n[1] / n[0])), []
        pooled_z = pooled / np.outer(scale, scale)
        for u, c in zip(means, covs):
            z = (1 - a) * c / np.outer(scale, scale) + a * pooled_z
            z = (1 - b) * z + b * max(np.trace(z) / D, 1e-3) * np.eye(D)
            factor = np.linalg.cholesky(z)
            self.parts.append((u / scale, np.linalg.inv(factor), float(np.log(np.diag(factor)).sum())))

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 less that of class 0, with the log odds of the classes."""
        z = x / self.scale
        logs = [-0.5 * (((z - u) @ inverse.T) ** 2).sum(1) - half for u, inverse, half in self.parts]
        return logs[1] - logs[0] + self.prior


def _curve(middle: np.ndarray, n0: np.ndarray, n1: np.ndarray, steps: int = 60) -> tuple[float, float, float]:
    """Slope and shift of the logistic curve for binned differences, and its mean log loss (Newton's method)."""
    t = np.sign(middle) * np.log1p(np.abs(middle))
    w = np.array([1.0, 0.0])
    x = np.stack([t, np.ones_like(t)], 1)
    n = n0 + n1
    for _ in range(steps):
        p = logistic(x @ w)
        grad = x.T @ (n * p - n1) + 1e-3 * w
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hess, grad), -1, 1)
    p = np.clip(logistic(x @ w), 1e-9, 1 - 1e-9)
    return float(w[0]), float(w[1]), float(-(n1 * np.log(p) + n0 * np.log(1 - p)).sum() / max(1, n.sum()))


class Scorer:
    def __init__(self, model: Discriminant | None, slope: float, shift: float):
        self.model, self.slope, self.shift = model, slope, shift

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.model is None:
            return np.full(len(x), self.shift)
        d = self.model.difference(x)
        return logistic(self.slope * np.sign(d) * np.log1p(np.abs(d)) + self.shift)


def train_scorer(stats: DataFrame, labels: DataFrame, column: str = "quality") -> Scorer:
    spark = stats.sparkSession
    known = stats.join(training_labels(labels, column), "doc_id").select("doc_id", "x", "label", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))
    known = materialise(known, "quality-train")
    moments = _moments(known)
    whole = [sum((m for (c, _), m in moments.items() if c == k), np.zeros(1 + D + D * D)) for k in (0, 1)]
    if min(whole[0][0], whole[1][0]) < 2:
        return Scorer(None, 0.0, float(whole[1][0] / max(1.0, whole[0][0] + whole[1][0])))

    def without(fold: int) -> list[np.ndarray]:
        left = [whole[k] - moments.get((k, fold), 0) for k in (0, 1)]
        return left if min(m[0] for m in left) >= 2 else whole

    models = [[Discriminant(without(f), s) for f in range(FOLDS)] for s in SHRINKAGES]
    sent = spark.sparkContext.broadcast(models)

    def run(batches):
        total = np.zeros((len(SHRINKAGES), 2, BINS), np.int64)
        for b in batches:
            x, label, fold = _matrix(b.column(0)), b.column(1).to_numpy(), b.column(2).to_numpy()
            for k, by_fold in enumerate(sent.value):
                for f in range(FOLDS):
                    mine = fold == f
                    d = np.clip(by_fold[f].difference(x[mine]), -WIDEST, WIDEST - 1e-9)
                    at = ((d + WIDEST) / (2 * WIDEST) * BINS).astype(np.int64)
                    np.add.at(total[k], (label[mine], at), 1)
        k, c, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32)) for v in (k, c, at)] + [pa.array(total[k, c, at])], ["k", "label", "bin", "n"])

    hist = np.zeros((len(SHRINKAGES), 2, BINS))
    for r in known.select("x", "label", "fold").mapInArrow(run, "k int, label int, bin int, n long").groupBy("k", "label", "bin").agg(F.sum("n").alias("n")).collect():
        hist[r["k"], r["label"], r["bin"]] = r["n"]
    middle = (np.arange(BINS) + 0.5) / BINS * 2 * WIDEST - WIDEST
    curves = [_curve(middle, h[0], h[1]) for h in hist]
    best = min(range(len(curves)), key=lambda k: curves[k][2])
    return Scorer(Discriminant(whole, SHRINKAGES[best]), *curves[best][:2])


def quality(docs: DataFrame, labels: DataFrame, column: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; the texts are read once and never shuffled."""
    stats = materialise(document_statistics(docs), "quality-stats")
    scorer = docs.sparkSession.sparkContext.broadcast(train_scorer(stats, labels, column))

    def run(batches):
        for b in batches:
            s = scorer.value.score(_matrix(b.column(1))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = stats.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
