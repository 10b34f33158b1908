"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

One pass over the texts gives a short row of statistics per document. Class sums and
cross products are added up on the executors; 2 x (1 + d + d^2) numbers reach the
driver. There each class covariance is shrunk towards the pooled diagonal and
factored once (Cholesky); the factors are cached in the model. A document's score is
the logistic of the difference of both log-densities (Mahalanobis distance and
log-determinant) plus the log-odds of the classes.

Defined cases: a null text is an empty one; empty texts have all statistics zero and
a score; rows with equal ids are scored one by one, and a document with several
labels counts once for each; null labels are ignored; if a class has no labelled
row the score is the share of class 1, or 0.5 without any; only the id and text
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidymeter.llm.text import utf8
from tidymeter.session import materialize

SHRINK = 0.1
FLOOR = 1e-2  # least variance of a statistic, in units of its transformed scale
THRESHOLD = 0.3

STATISTICS = [
    "log_words", "word_length", "loud_marks", "symbols", "capitals", "distinct", "repeats",
    "stops", "commas", "digits", "line_words", "line_ends", "repeated_lines", "non_ascii",
]

_UPPER = bytes(range(0x41, 0x5B))
_LETTERS = _UPPER + bytes(range(0x61, 0x7B))
_HIGH = bytes(range(0x80, 0x100))


def _count(raw: bytes, chars: bytes) -> int:
    return len(raw) - len(raw.translate(None, chars))


def statistics(raw: bytes | None) -> list[float]:
    """The transformed statistics of one text, in the order of STATISTICS."""
    raw = raw or b""
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, size = len(words), len(raw)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    letters = _count(raw, _LETTERS)
    share = [
        sum(map(len, words)) / n / 10,
        _count(raw, b"!?") / n,
        _count(raw, b"#*$%&|<>") / n,
        _count(raw, _UPPER) / max(letters, 1),
        len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        raw.count(b".") / n,
        raw.count(b",") / n,
        _count(raw, b"0123456789") / size,
    ]
    ends = sum(x.rstrip()[-1:] in b".!?\"':;)" for x in lines) / len(lines)
    return [
        np.log1p(n), *np.sqrt(share), np.log1p(n / len(lines)), ends,
        np.sqrt(1 - len(set(lines)) / len(lines)), np.sqrt(_count(raw, _HIGH) / size),
    ]


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the statistics of every row."""
    slim = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(raw) for raw in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(x, pa.list_(pa.float64()))], names=["id", "x"])

    schema = T.StructType([slim.schema["id"], T.StructField("x", T.ArrayType(T.DoubleType()))])
    return slim.mapInArrow(run, schema)


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors, log-determinants and log-odds; empty when a class is missing."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    logdets: list[float]
    log_odds: float
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        densities = []
        for mean, factor, logdet in zip(self.means, self.factors, self.logdets):
            z = (x - mean) @ factor.T
            densities.append(-0.5 * ((z * z).sum(axis=1) + logdet))
        return 1 / (1 + np.exp(-np.clip(densities[1] - densities[0] + self.log_odds, -700, 700)))


def fit(labelled: DataFrame, shrink: float = SHRINK) -> Discriminant:
    """Discriminant of a table (label 0 or 1, x)."""
    d = len(STATISTICS)
    terms = F.concat(
        F.array(F.lit(1.0)), F.col("x"),
        F.flatten(F.transform("x", lambda a: F.transform("x", lambda b: a * b))),
    )
    rows = (
        labelled.filter("label IN (0, 1)")
        .select("label", F.posexplode(terms).alias("at", "value"))
        .groupBy("label", "at").agg(F.sum("value").alias("value"))
        .collect()  # at most 2 x (1 + d + d^2)
    )
    sums = np.zeros((2, 1 + d + d * d))
    for r in rows:
        sums[int(r["label"]), r["at"]] = r["value"]
    n = sums[:, 0]
    if n.min() == 0:
        return Discriminant([], [], [], 0.0, float(n[1] / n.sum()) if n.sum() else 0.5)
    means = [s[1 : 1 + d] / s[0] for s in sums]
    covariances = [s[1 + d :].reshape(d, d) / s[0] - np.outer(m, m) for s, m in zip(sums, means)]
    pooled = sum(c * k for c, k in zip(covariances, n)) / n.sum()
    target = np.diag(np.maximum(np.diag(pooled), FLOOR))
    factors, logdets = [], []
    for c in covariances:
        low = np.linalg.cholesky((1 - shrink) * c + shrink * target)
        factors.append(np.linalg.inv(low))
        logdets.append(float(2 * np.log(np.diag(low)).sum()))
    return Discriminant(means, factors, logdets, float(np.log(n[1] / n[0])))


def scored(x: DataFrame, model: Discriminant) -> DataFrame:
    """(id, score) of a table (id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array(batch.column("x").to_pylist(), float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.score(values))], names=["id", "score"])

    return x.mapInArrow(run, T.StructType([x.schema["id"], T.StructField("score", T.DoubleType())]))


def classify(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", shrink: float = SHRINK
) -> DataFrame:
    """Per row of ``df``: id and score, learned from ``labels`` (id, label)."""
    x = materialize(measured(df, id_col, text_col), "statistics")
    known = labels.select(F.col(f"`{id_col}`").alias("id"), "label")
    model = fit(x.join(known, "id").select("label", "x"), shrink)
    return scored(x, model).withColumnRenamed("id", id_col)
