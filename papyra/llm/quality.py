"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

One pass turns each whole text into ``STATISTICS`` (square roots of shares, logs of sizes). The fit sums, for each class, the
labelled training rows' statistics and their products inside Spark (a few numbers per class reach the driver) and shrinks
each class covariance towards the pooled one and its diagonal. Its Cholesky factor is computed once and cached in the model.
A score is the posterior of label 1: the logistic of the difference of the two Gaussian log densities, each half the negated
squared Mahalanobis distance (a product with the cached factor's inverse) less the factor's log determinant, plus the log prior.

Training rows: all labelled rows whose crc32(doc_id as text) mod 5 is not 0. Labels, lang, source and doc_id are never inputs.

Edges: null text counts as empty and has all its counts 0; label rows that are null, or repeat a document, or lack one, drop
out of the fit or weigh as often as they occur; with fewer than two training rows of one of the classes every score is the share
of label 1 among the training rows (1 without any); several documents with the same doc_id each get their row.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.llm.shared import small_batches, table, written

#: Byte classes that are counted: upper case, digits, bars, exclamation marks, other symbols, sentence marks.
_CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"|", b"!", b"#$%&*@^~+=<>_\\/[]{}", b".,;:?")
_CLASS_OF = np.zeros(256, dtype=np.uint8)
for _i, _c in enumerate(_CLASSES, 1):
    _CLASS_OF[list(_c)] = _i
STATISTICS = ("log_bytes", "upper", "digits", "bars", "exclamations", "symbols", "marks", "log_word", "distinct", "repeats", "line_repeats", "other")
FOLDS, SHRINK, RIDGE, THRESHOLD = 5, 0.2, 0.02, 0.3


def statistics(text: str | None) -> list[float]:
    b = (text or "").encode()
    n = len(b)
    counts = np.bincount(_CLASS_OF[np.frombuffer(b, dtype=np.uint8)], minlength=7)[1:7].tolist() if n else [0] * 6
    words, lines = b.split(), b.split(b"\n")
    w = len(words)
    shares = [math.sqrt(c / n) if n else 0.0 for c in counts]
    repeats = sum(map(operator.eq, words, words[1:]))
    other = n - len(b.translate(None, bytes(range(128, 256))))
    return [
        math.log1p(n), *shares, math.log1p(n / w) if w else 0.0, math.sqrt(len(set(words)) / w) if w else 0.0,
        math.sqrt(repeats / w) if w else 0.0, math.sqrt(1 - len(set(lines)) / len(lines)), math.sqrt(other / n) if n else 0.0,
    ]


@dataclass(frozen=True)
class Discriminant:
    """Per class: mean, inverse of the Cholesky factor, log determinant and log prior; without both classes a constant."""

    means: tuple[np.ndarray, ...]
    factors: tuple[np.ndarray, ...]
    offsets: tuple[float, ...]
    constant: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        log = [o - 0.5 * np.square((x - m) @ f.T).sum(axis=1) for m, f, o in zip(self.means, self.factors, self.offsets)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def solve(sums: dict[int, tuple[int, np.ndarray, np.ndarray]], shrink: float = SHRINK, ridge: float = RIDGE) -> Discriminant:
    """From class -> (rows, sum of x, sum of x xT)."""
    total = sum(n for n, _, _ in sums.values())
    if any(sums.get(k, (0,))[0] < 2 for k in (0, 1)):
        return Discriminant((), (), (), sums[1][0] / total if 1 in sums else float(not total))
    means = {k: s / n for k, (n, s, _) in sums.items()}
    cov = {k: p / n - np.outer(means[k], means[k]) for k, (n, _, p) in sums.items()}
    pooled = sum(sums[k][0] / total * cov[k] for k in (0, 1))
    scale = np.diag(pooled) + 1e-6
    factors, offsets = [], []
    for k in (0, 1):
        c = (1 - shrink) * cov[k] + shrink * (0.5 * pooled + 0.5 * np.diag(scale)) + ridge * np.diag(scale)
        chol = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(chol))
        offsets.append(math.log(sums[k][0] / total) - float(np.log(np.diag(chol)).sum()))
    return Discriminant(tuple(means[k] for k in (0, 1)), tuple(factors), tuple(offsets))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _statistics(text: pa.Array) -> pa.Array:
    return pa.array([statistics(t) for t in text.to_pylist()], pa.list_(pa.float64()))


def with_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, x) for each row."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(key).alias("k"), _statistics(text).alias("x"))


def held_out(key: str, folds: int = FOLDS):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == 0, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame, folds: int = FOLDS) -> Discriminant:
    """Sums of all training rows, made on the executors. stats: (k, x); labels: (doc_id, quality)."""
    y = labels.select(F.col("doc_id").alias("k"), F.col("quality").alias("y")).filter("y in (0, 1)")
    rows = stats.filter(~held_out("k", folds)).join(y, "k").select("y", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list] = {}
        for b in batches:
            y, x = np.asarray(b.column(0)), np.array(b.column(1).to_pylist(), dtype=float).reshape(b.num_rows, -1)
            for k in np.unique(y).tolist():
                z = x[y == k]
                n, s, p = got.get(k, (0, 0, 0))
                got[k] = [n + len(z), s + z.sum(axis=0), p + z.T @ z]
        if got:
            rows = [{"y": k, "n": n, "s": s.tolist(), "p": p.ravel().tolist()} for k, (n, s, p) in got.items()]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("y", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.float64())), ("p", pa.list_(pa.float64()))]))

    parts = rows.mapInArrow(run, "y int, n long, s array<double>, p array<double>")
    at = parts.select("y", "n", F.posexplode(F.concat("s", "p")).alias("i", "v")).groupBy("y", "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    sums: dict[int, dict[int, tuple]] = {}
    for r in at.collect():  # two classes, d + d*d numbers each
        sums.setdefault(r.y, {})[r.i] = (r.n, r.v)
    d = len(STATISTICS)
    out = {}
    for k, v in sums.items():
        flat = np.array([v[i][1] for i in range(d + d * d)])
        out[k] = (v[0][0], flat[:d], flat[d:].reshape(d, d))
    return solve(out)


def score_of(x, model: Discriminant):
    """A column of scores from a column of statistics."""

    @F.arrow_udf(T.DoubleType())
    def score(x: pa.Array) -> pa.Array:
        return pa.array(model.scores(np.array(x.to_pylist(), dtype=float).reshape(len(x), len(STATISTICS))))

    return score(x)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = written(with_statistics(table(spark, sf_dir, "documents")), "quality")
    model = fit(stats, table(spark, sf_dir, "labels"))
    scored = stats.select(F.col("k").alias("doc_id"), held_out("k").alias("held_out"), score_of("x", model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier, fitted on their labelled part, doesn't reject."""
    model = fit(with_statistics(docs.filter(~held_out("doc_id"))), labels)
    return docs.filter(score_of(_statistics("text"), model) >= threshold)
