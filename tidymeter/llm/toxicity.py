"""Toxicity by a classifier chain over toxicity categories.

Categories are judged one after another by logistic models on the presence of
selected words and word beginnings; each model also sees the log-odds that the
earlier models gave. Those inputs are out-of-fold while training: every earlier
category is predicted for a training row by a model that has not seen the row (nor
its copies, since folds follow the text).

Words and beginnings are selected by their counts over all labelled rows, which are
added up on the executors: the best over all categories, and the best of each
category, so that a rare one keeps its own. The models are fitted on a sample of at
most ``MAX_ROWS`` labelled rows; the features of a row reach the driver. Scoring
is one pass over whole texts without a shuffle.

Defined cases: a null or empty text has no features and gets the base rate; an empty
table gives no rows; null labels are ignored; a category that has only one class in
the sample is constant; rows with equal ids are scored one by one; only the id and
text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidymeter.llm.bloom import bloom_filter, in_bloom
from tidymeter.llm.text import by_bytes, utf8
from tidymeter.session import materialize

FEATURES = 400  # over all categories
OWN_FEATURES = 100  # of each category besides
MAX_ROWS = 12_000
FOLDS = 3
BEGINNINGS = (4, 5, 6)  # bytes
MIN_ROWS = 4
RIDGE = 1e-4
LEAST_SPREAD = 0.02
STEPS = 250

# Separators of words for this operator: ASCII other than letters, digits and the apostrophe.
_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 or c == 0x27 else 0x20
    for c in range(256)
)


def features_of(raw: bytes | None) -> set[bytes]:
    """Distinct words, and their beginnings marked by a closing asterisk."""
    words = set(raw.translate(_TABLE).split()) if raw else set()
    return words | {w[:k] + b"*" for w in words for k in BEGINNINGS if len(w) > k}


@dataclass
class Chain:
    """Weights of each category: bias, features, then the earlier categories' log-odds."""

    names: list[str]
    vocabulary: dict[bytes, int]
    weights: list[np.ndarray]

    def present(self, raw: bytes | None) -> list[int]:
        words = set(raw.translate(_TABLE).split()) if raw else ()
        get, found = self.vocabulary.get, []
        for w in words:
            if (i := get(w)) is not None:
                found.append(i)
            for k in BEGINNINGS:
                if len(w) > k and (i := get(w[:k] + b"*")) is not None:
                    found.append(i)
        return found

    def log_odds(self, texts: list[bytes | None]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.vocabulary)))
        for row, raw in enumerate(texts):
            x[row, self.present(raw)] = 1.0
        return _walk(x, self.weights)


def _walk(x: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(x), len(weights)))
    d = x.shape[1]
    for j, w in enumerate(weights):
        out[:, j] = _bounded(w[0] + x @ w[1 : 1 + d] + out[:, :j] @ w[1 + d :])
    return out


def _bounded(z: np.ndarray) -> np.ndarray:
    return np.clip(z, -12, 12)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by accelerated gradient steps; the bias comes first and is not shrunk.

    Columns are scaled to unit spread while fitting, so that rare words move as fast as frequent ones.
    """
    n, kind = len(y), x.dtype.type
    rate = (y.sum() + 0.5) / (n + 1)
    w = np.zeros(x.shape[1] + 1, x.dtype)
    w[0] = np.log(rate / (1 - rate))
    if y.min() == y.max():
        return w
    scale = 1 / np.maximum(x.std(axis=0), kind(LEAST_SPREAD))
    x1 = np.concatenate((np.ones((n, 1), x.dtype), x * scale), axis=1)
    step = kind(4 / (np.linalg.eigvalsh(x1.T @ x1 / n)[-1] + 4 * RIDGE))
    shrink = np.full(len(w), RIDGE, x.dtype)
    shrink[0] = 0
    ahead, pace = w.copy(), 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x1 @ ahead, -30, 30)))
        new = ahead - step * (x1.T @ (p - y) / kind(n) + shrink * ahead)
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = new + kind((pace - 1) / faster) * (new - w)
        w, pace = new, faster
    w[1:] *= scale
    return w


def fit_chain(x: np.ndarray, y: np.ndarray, folds: np.ndarray) -> list[np.ndarray]:
    """Weights per category; the columns of ``y`` are the categories in chain order."""
    weights, earlier = [], np.zeros((len(x), 0), np.float32)
    for j in range(y.shape[1]):
        own = np.concatenate((x, earlier), axis=1)
        weights.append(_logistic(own, y[:, j]))
        unseen = np.zeros(len(x), np.float32)
        for f in np.unique(folds):
            out = folds == f
            w = _logistic(own[~out], y[~out, j]) if (~out).any() else weights[-1]
            unseen[out] = _bounded(w[0] + own[out] @ w[1:])
        earlier = np.concatenate((earlier, unseen[:, None]), axis=1)
    return weights


def _select(labelled: DataFrame, names: list[str], most: int, own: int = OWN_FEATURES) -> list[bytes]:
    """The features whose presence says most about any category, and about each (G statistic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch):
                found = [list(features_of(raw)) for raw in utf8(part.column("text"))]
                at = pa.array(np.repeat(np.arange(len(found)), list(map(len, found))))
                flat = pa.array([f for own in found for f in own], pa.binary())
                yield pa.RecordBatch.from_arrays([flat, *(part.column(c).take(at) for c in names)], names=["feature", *names])

    schema = "feature binary, " + ", ".join(f"{c} int" for c in names)
    counts = labelled.select("text", *names).mapInArrow(run, schema).groupBy("feature").agg(
        F.count("*").alias("n"), *[F.sum(c).alias(c) for c in names]
    ).filter(F.col("n") >= MIN_ROWS)
    totals = labelled.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in names]).first()
    scores = []
    for c in names:
        # Log-likelihood ratio of the feature's rows, against the category's share.
        base = (totals[c] or 0) / max(totals["n"], 1)
        if 0 < base < 1:
            p = (F.col(c) + base) / (F.col("n") + 1)
            scores.append(F.col(c) * F.log(p / base) + (F.col("n") - F.col(c)) * F.log((1 - p) / (1 - base)))
    if not scores:
        return []
    marks = [s.alias(f"s{k}") for k, s in enumerate(scores)]
    overall = F.greatest(*scores) if len(scores) > 1 else scores[0]
    rated = materialize(counts.select("feature", overall.alias("s"), *marks), "features")
    found = [(c, most if c == "s" else own) for c in rated.columns[1:]]
    best = [rated.orderBy(F.desc(c), "feature").limit(n).collect() for c, n in found]
    return list(dict.fromkeys(bytes(r["feature"]) for rows in best for r in rows))


def _among(slim: DataFrame, known: DataFrame) -> DataFrame:
    """The rows whose id may be labelled, so that other texts are not shuffled for the join."""
    shared = slim.sparkSession.sparkContext.broadcast(bloom_filter(known.select(F.xxhash64("id"))))  # its size is bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bloom(batch.column("key"), shared.value))).select(["id", "text"])

    return slim.select(F.xxhash64("id").alias("key"), "id", "text").mapInArrow(run, slim.schema)


def train(
    df: DataFrame,
    labels: DataFrame,
    categories: dict[str, str],
    id_col: str = "doc_id",
    text_col: str = "text",
    features: int = FEATURES,
    max_rows: int = MAX_ROWS,
) -> Chain:
    """A chain over ``categories`` (name: condition on the columns of ``labels``), in their order."""
    names = list(categories)
    marks = [F.when(F.expr(rule), 1).otherwise(0).cast("int").alias(f"y{k}") for k, rule in enumerate(categories.values())]
    known = labels.select(F.col(f"`{id_col}`").alias("id"), *marks)
    columns = [f"y{k}" for k in range(len(names))]
    slim = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    chosen = _select(_among(slim, known).join(known, "id").select("text", *columns), columns, features)
    total = known.count()
    if total > max_rows:
        share = F.lit(int(max_rows / total * 0.97 * 2**32))
        known = known.filter(F.pmod(F.xxhash64("id"), F.lit(2**32)) < share).limit(max_rows)
    # The sample has at most max_rows narrow rows, so it may be broadcast.
    sample = materialize(slim.join(F.broadcast(known), "id").select("text", *columns), "labelled")
    vocabulary = {f: i for i, f in enumerate(chosen)}
    chain = Chain(names, vocabulary, [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column("text"))
            found = [np.array(chain.present(t), "<i4").tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.binary()), batch.column("fold"), *(batch.column(c) for c in columns)],
                names=["found", "fold", *columns],
            )

    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold")
    schema = "found binary, fold int, " + ", ".join(f"{c} int" for c in columns)
    rows = sample.select("text", fold, *columns).mapInArrow(run, schema).collect()  # at most max_rows
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["found"], "<i4")] = 1.0
    if not len(rows):
        return Chain(names, vocabulary, [np.zeros(1 + len(vocabulary) + j) for j in range(len(names))])
    chain.weights = fit_chain(x, np.array([[r[c] for c in columns] for r in rows], np.float32), np.array([r["fold"] for r in rows]))
    return chain


def score(df: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and one probability per category, in chain order."""
    slim = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column("text"))
            parts = [chain.log_odds(texts[i : i + 1000]) for i in range(0, len(texts), 1000)]
            odds = np.concatenate([np.zeros((0, len(chain.names))), *parts])
            p = 1 / (1 + np.exp(-odds))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(p[:, j]) for j in range(p.shape[1]))],
                names=["id", *(f"p{j}" for j in range(p.shape[1]))],
            )

    schema = T.StructType(
        [slim.schema["id"], *(T.StructField(f"p{j}", T.DoubleType()) for j in range(len(chain.names)))]
    )
    done = slim.mapInArrow(run, schema)
    return done.select(F.col("id").alias(id_col), *[F.col(f"p{j}").alias(n) for j, n in enumerate(chain.names)])
