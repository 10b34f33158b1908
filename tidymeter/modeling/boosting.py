"""Gradient boosted trees for many fits side by side.

The rows of one target are quantised once, one byte per value, and shared with the
executors; every fit (a fold held out, a trial's parameters) is a task of its own, so
that hundreds of fits of a cross-validation or a search are one Spark job. This holds
up to ``MAX_CELLS`` values per target, which is checked. Of a larger target Spark adds
up the rows alike in all bins, and the fits share up to ``MAX_FOLDED`` such sums; one
with still more is trained row-parallel by MLlib, one fit after another, on all its rows.

A tree splits level by level on histograms of the residuals. Gains and leaf values are
those of second-order boosting on squared error with an L2 term of ``RIDGE``.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, functions as F

from tidymeter.session import materialize

MAX_CELLS = 1_000_000
# Rows from which those alike in all bins are folded on the driver.
FOLD_ROWS = 20_000
# Counts and sums of a folded target, and the random blocks of rows they are kept by.
MAX_FOLDED = 4_000_000
BLOCKS = 20
MAX_BINS = 32
RIDGE = 1.0
SEED = 42
_KEYS_AT_ONCE = 1 << 21


@dataclass(frozen=True)
class TreeParams:
    n_estimators: int = 500
    max_depth: int = 5
    learning_rate: float = 0.03
    subsample: float = 0.8
    colsample_bytree: float = 0.8
    min_child_weight: float = 1.0

    @staticmethod
    def of(tp) -> TreeParams:
        """The tree parameters among those of a training."""
        return TreeParams(**{f: getattr(tp, f) for f in TreeParams.__dataclass_fields__})


@dataclass(frozen=True)
class Fit:
    """Trains on the rows whose ``fold`` is known and not ``held_out``, and predicts the held-out rows.

    Without a fold column it trains on all rows, predicts them and keeps the model.
    """

    run: str
    params: TreeParams
    fold: str | None = None
    held_out: int = -1


class Trees:
    """Complete binary trees: ``feature`` and ``cut`` per inner node, ``value`` per leaf; x > cut goes right."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, value: np.ndarray, gains: np.ndarray):
        self.base, self.feature, self.cut, self.value, self.gains = base, feature, cut, value, gains

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not x.size:
            return np.full(len(x), self.base)
        # Rows between the same thresholds of every feature are predicted once.
        codes = np.zeros(x.shape, np.uint8)
        for j in np.unique(self.feature):
            cuts = np.unique(self.cut[self.feature == j])
            codes[:, j] = np.searchsorted(cuts, x[:, j], side="left")
        first, which = _distinct(codes, places=True)
        return self._predict(x[first])[which]

    def _predict(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        depth = int(np.log2(self.value.shape[1]))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - (2**depth - 1)]
        return out

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, base=self.base, feature=self.feature, cut=self.cut, value=self.value, gains=self.gains)
        return out.getvalue()

    @staticmethod
    def load(raw: bytes) -> Trees:
        found = np.load(io.BytesIO(raw))
        return Trees(float(found["base"]), *(found[n] for n in ("feature", "cut", "value", "gains")))


class Quantised:
    """The rows of a target: labels, fold columns, and per value the number of its bin.

    Rows alike in all their bins get the same splits and predictions. Where they are
    many, a tree grows on the cells, the distinct rows of bins, with the count and the
    residuals of the rows it draws in each; else every row is a cell.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, folds: dict[str, np.ndarray]):
        self.y, self.folds = y, folds
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, MAX_BINS + 1)[1:-1], method="lower")) if len(c) else c for c in x.T]
        self.edges = _thresholds(edges)
        bins = np.empty(x.shape, np.uint8)
        for j, own in enumerate(edges):
            bins[:, j] = np.searchsorted(own, x[:, j], side="left")
        self.cells, self.cell = bins, np.arange(len(bins))
        if len(bins) >= FOLD_ROWS:
            cells, cell = _distinct(bins)
            if 2 * len(cells) <= len(bins):
                self.cells, self.cell = cells, cell

    def boost(self, fit: Fit) -> tuple[np.ndarray, np.ndarray, Trees]:
        """(predicted rows, predictions, model)."""
        p, fold = fit.params, self.folds.get(fit.fold)
        train = np.arange(len(self.y)) if fold is None else np.flatnonzero((fold >= 0) & (fold != fit.held_out))
        test = train if fold is None else np.flatnonzero(fold == fit.held_out)
        m = len(train)
        base = float(self.y[train].mean()) if m else 0.0
        cell, size = self.cell[train], len(self.cells)
        alone = size == len(self.y)
        y = self.y[train] if alone else self.y[train] - base

        def draw(rng):
            if p.subsample >= 1:
                return np.bincount(cell, minlength=size).astype(float), np.bincount(cell, weights=y, minlength=size)
            bag = rng.random(m) < p.subsample
            return np.bincount(cell, weights=bag, minlength=size), np.bincount(cell, weights=y * bag, minlength=size)

        score, trees = _boosted(self.cells, self.edges, base, fit, draw if m else None, base if alone else 0.0)
        return test, score[self.cell[test]], trees


class Folded:
    """Counts, label sums and spreads of the rows alike in all bins, per fold and block of rows.

    It grows with the cells, not with the rows. A tree draws whole blocks, each a
    random ``1 / BLOCKS`` of the rows. A spread is the sum of squares around the own mean.
    """

    def __init__(self, cells: np.ndarray, edges: list[np.ndarray], cell, fold, block, n, total, spread=0.0):
        self.cells, self.edges = cells, _thresholds(edges)
        self.cell, self.fold, self.block, self.n, self.total = cell, fold, block, n, total
        self.spread = np.broadcast_to(spread, np.shape(n))

    def boost(self, fit: Fit) -> Trees:
        return self.grow(fit)[1]

    def grow(self, fit: Fit) -> tuple[np.ndarray, Trees]:
        """(prediction of every cell, model)."""
        p, size = fit.params, len(self.cells)
        train = np.flatnonzero((self.fold >= 0) & (self.fold != fit.held_out)) if fit.fold else np.arange(len(self.n))
        m = self.n[train].sum()
        base = float(self.total[train].sum() / m) if m else 0.0
        place = self.block[train].astype(np.int64) * size + self.cell[train]
        count = np.bincount(place, weights=self.n[train], minlength=BLOCKS * size).reshape(BLOCKS, size)
        y = np.bincount(place, weights=self.total[train] - self.n[train] * base, minlength=BLOCKS * size).reshape(BLOCKS, size)
        whole = count.sum(axis=0), y.sum(axis=0)

        def draw(rng):
            if p.subsample >= 1:
                return whole
            bag = rng.permutation(BLOCKS)[: max(1, round(BLOCKS * p.subsample))]
            return count[bag].sum(axis=0), y[bag].sum(axis=0)

        return _boosted(self.cells, self.edges, base, fit, draw if m else None)

    def score(self, fit: Fit) -> tuple[float | None, int]:
        """(R2, rows) of the held-out rows: those of a cell share a prediction, so their sums give the exact errors."""
        predicted, _ = self.grow(fit)
        test = np.flatnonzero(self.fold == fit.held_out)
        n, mean = self.n[test], self.total[test] / self.n[test]
        rows = n.sum()
        if not rows:
            return None, 0
        centre = self.total[test].sum() / rows
        error = (self.spread[test] + n * (mean - predicted[self.cell[test]]) ** 2).sum()
        around = (self.spread[test] + n * (mean - centre) ** 2).sum()
        # What rounding leaves of a constant label is no variance.
        flat = around <= 1e-24 * rows * centre * centre
        return None if flat else float(1.0 - error / around), int(rows)


def _thresholds(edges: list[np.ndarray]) -> np.ndarray:
    """Threshold of every bin in use; behind the last, none."""
    out = np.full((len(edges), max(map(len, edges), default=0) + 2), np.inf)
    for j, own in enumerate(edges):
        out[j, : len(own)] = own
    return out


def _distinct(rows: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows or the place of each, which of them each row is) of a matrix of bytes."""
    if not rows.size:
        return rows[:1], np.zeros(len(rows), np.intp)
    flat = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1] * rows.dtype.itemsize))).ravel()
    _, first, which = np.unique(flat, return_index=True, return_inverse=True)
    return first if places else rows[first], which


def _boosted(cells: np.ndarray, edges: np.ndarray, base: float, fit: Fit, draw, start: float = 0.0) -> tuple[np.ndarray, Trees]:
    """(prediction of every cell, model); ``draw`` gives a tree's rows and their label sums per cell, less ``base - start``."""
    p, d, width = fit.params, cells.shape[1], edges.shape[1] - 1
    rng = np.random.default_rng([SEED, zlib.crc32(fit.run.encode()), fit.held_out + 1])
    score, leaves = np.full(len(cells), start), 2**p.max_depth
    feature = np.zeros((p.n_estimators, leaves - 1), np.int32)
    cut = np.full((p.n_estimators, leaves - 1), width, np.int32)
    value = np.zeros((p.n_estimators, leaves))
    gains = np.zeros(d)
    chosen, bins = max(1, round(d * p.colsample_bytree)), cells.astype(np.intp)
    flat, begin = bins.ravel(), np.arange(len(cells)) * d
    for t in range(p.n_estimators if draw and d else 0):
        count, rest = draw(rng)
        bag = np.flatnonzero(count)
        columns = np.sort(rng.permutation(d)[:chosen]) if chosen < d else np.arange(d)
        own = np.ascontiguousarray(bins[bag][:, columns])
        tree = _Level(own, rest[bag] - count[bag] * score[bag], count[bag], width, p.min_child_weight)
        place = np.zeros(len(cells), np.intp)
        for level in range(p.max_depth):
            name, at, gain = tree.split(place.take(bag), 1 << level)
            if not gain.any():
                place <<= p.max_depth - level
                break
            name = columns[name]
            gains += np.bincount(name, weights=gain, minlength=d)
            first = (1 << level) - 1
            feature[t, first : first + len(name)], cut[t, first : first + len(name)] = name, at
            place = 2 * place + (flat.take(begin + name.take(place)) > at.take(place))
        node = place.take(bag)
        held = np.bincount(node, weights=tree.count, minlength=leaves)
        value[t] = p.learning_rate * np.bincount(node, weights=tree.rest, minlength=leaves) / (held + RIDGE)
        score += value[t].take(place)
    return score + (base - start), Trees(base, feature, edges[feature, cut] if d else cut, value, gains)


class _Level:
    """Best splits of the nodes of one level of a tree, by histograms of the residuals over the bins."""

    def __init__(self, bins: np.ndarray, rest: np.ndarray, count: np.ndarray, width: int, least: float):
        self.bins, self.rest, self.count, self.width, self.least = bins, rest, count, width, least
        self.keys: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def split(self, node: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(column, bin, gain) of every node; without a gain the bin is one that keeps all rows left."""
        name, at, best = np.zeros(nodes, np.intp), np.full(nodes, self.width), np.zeros(nodes)
        columns = self.bins.shape[1]
        step = max(1, _KEYS_AT_ONCE // (nodes * self.width))
        count = np.bincount(node, weights=self.count, minlength=nodes)[:, None, None]
        total = np.bincount(node, weights=self.rest, minlength=nodes)[:, None, None]
        whole = total * total / (count + RIDGE)
        for start in range(0, columns, step):
            some = min(step, columns - start)
            own, rows, weights = self._flat(start, some)
            shape = (nodes, some, self.width)
            keys = ((node * (some * self.width))[:, None] + own).ravel()
            n = np.bincount(keys, weights=rows, minlength=nodes * some * self.width).reshape(shape).cumsum(axis=2)
            g = np.bincount(keys, weights=weights, minlength=nodes * some * self.width).reshape(shape).cumsum(axis=2)
            gain = g * g / (n + RIDGE) + (total - g) ** 2 / (count - n + RIDGE) - whole
            gain[(n < self.least) | (count - n < self.least)] = 0
            flat = gain.reshape(nodes, -1)
            top = flat.argmax(axis=1)
            found = flat[np.arange(nodes), top]
            better = found > np.maximum(best, 1e-12)
            best[better], name[better], at[better] = found[better], start + top[better] // self.width, top[better] % self.width
        return name, at, best

    def _flat(self, start: int, some: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Histogram places of the cells in some columns of node 0, their rows and residuals; kept where one pass holds all columns."""
        if some in self.keys:
            return self.keys[some]
        own = np.ascontiguousarray(self.bins[:, start : start + some] + np.arange(some) * self.width)
        found = own, np.repeat(self.count, some), np.repeat(self.rest, some)
        if some == self.bins.shape[1]:
            self.keys[some] = found
        return found


def fits_whole(rows: DataFrame) -> bool:
    """Whether the values of ``rows`` are within ``MAX_CELLS``."""
    first = rows.select(F.size(vector_to_array("x")).alias("d")).first()
    return rows.count() * max(first["d"] if first else 0, 1) <= MAX_CELLS


def quantised(rows: DataFrame, folds: list[str] = (), label: str = "y") -> Quantised | None:
    """The table of ``rows`` (vector ``x``, label, fold columns), or None above ``MAX_CELLS`` values."""
    first = rows.select(F.size(vector_to_array("x")).alias("d")).first()
    width = first["d"] if first else 0
    n = rows.count()
    if n * max(width, 1) > MAX_CELLS:
        return None
    marks = [F.coalesce(F.col(c), F.lit(-1)).cast("int").alias(c) for c in folds]
    got = rows.select(vector_to_array("x").alias("x"), F.col(label).cast("double").alias("y"), *marks).toArrow()
    # Tasks may deliver rows in any order; sorted, equal tables give equal fits.
    x = np.array(got.column("x").combine_chunks().flatten(), float).reshape(n, width)
    y = np.array(got.column("y"), float)
    marked = {c: np.array(got.column(c), np.int64) for c in folds}
    order = np.lexsort([*marked.values(), y, *x.T]) if width else np.argsort(y)
    return Quantised(x[order], y[order], {c: v[order] for c, v in marked.items()})


@dataclass(frozen=True)
class Binned:
    """The rows of a target with the bins of their values (``cell``), written once for all sums of them."""

    rows: DataFrame
    edges: list[np.ndarray]

    def sums(self, fold: str | None) -> DataFrame:
        """Rows alike in all bins, added up per fold and block."""
        mark = F.col(fold) if fold else F.lit(0)
        return materialize(
            self.rows.groupBy("cell", mark.cast("byte").alias("fold"), "block")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("total"), (F.var_pop("y") * F.count("y")).alias("spread")),
            "folded",
        )

    def folded(self, folds: list[str | None]) -> list[Folded] | None:
        """The sums by each of the fold columns; None above ``MAX_FOLDED`` sums in all."""
        tables = [self.sums(f) for f in folds]
        if sum(t.count() for t in tables) > MAX_FOLDED:
            return None
        return [self._local(t.toArrow()) for t in tables]

    def _local(self, got: pa.Table) -> Folded:
        raw = np.frombuffer(b"".join(got.column("cell").to_pylist()), np.uint8).reshape(-1, len(self.edges))
        cells, cell = _distinct(raw)
        order = np.lexsort((got.column("block"), got.column("fold"), cell))
        parts = [cell.astype(np.int32), *[np.array(got.column(c)) for c in ("fold", "block")]]
        parts += [np.array(got.column(c), float) for c in ("n", "total", "spread")]
        return Folded(cells, self.edges, *[v[order] for v in parts])


def binned(rows: DataFrame, folds: list[str] = (), subsample: float = 0.0, label: str = "y") -> Binned | None:
    """The bins of ``rows``, their random blocks and fold columns; the thresholds are approximate quantiles."""
    flat = rows.select(
        vector_to_array("x").alias("x"), F.col(label).cast("double").alias("y"),
        F.pmod(F.xxhash64(*[c for c in rows.columns if c != "x"], vector_to_array("x")), F.lit(BLOCKS if subsample < 1 else 1)).cast("byte").alias("block"),
        *[F.coalesce(F.col(c), F.lit(-1)).cast("int").alias(f"fold{i}") for i, c in enumerate(folds)],
    )
    first = flat.select(F.size("x").alias("d")).first()
    width = first["d"] if first else 0
    if not width:
        return None
    steps = [i / MAX_BINS for i in range(1, MAX_BINS)]
    cuts = flat.agg(*[F.percentile_approx(F.get("x", F.lit(j)), steps, 10_000).alias(f"c{j}") for j in range(width)]).first()
    edges = [np.unique(np.array(cuts[f"c{j}"], float)) for j in range(width)]
    kept = ["block", "y", *[f"fold{i}" for i in range(len(folds))]]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").flatten(), float).reshape(batch.num_rows, width)
            bins = np.empty(x.shape, np.uint8)
            for j, own in enumerate(edges):
                bins[:, j] = np.searchsorted(own, x[:, j], side="left")
            cells = pa.Array.from_buffers(pa.binary(width), len(bins), [None, pa.py_buffer(bins)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([cells, *[batch.column(c) for c in kept]], names=["cell", *kept])

    marks = "".join(f", fold{i} int" for i in range(len(folds)))
    found = flat.mapInArrow(place, f"cell binary, block byte, y double{marks}")
    return Binned(materialize(found.withColumnsRenamed({f"fold{i}": c for i, c in enumerate(folds)}), "binned"), edges)


def folded(rows: DataFrame, fold: str | None, subsample: float, label: str = "y") -> Folded | None:
    """The sums of ``rows`` by bins, fold and block, added up by Spark; None above ``MAX_FOLDED`` sums."""
    found = binned(rows, [fold] if fold else [], subsample, label)
    tables = found and found.folded([fold])
    return tables[0] if tables else None


def folded_scores(spark, tables: dict[str, Folded], fits: list[Fit]) -> DataFrame:
    """(run, fold, r2, n) of the held-out rows of every fit, one task each; ``tables`` holds the sums by fold column."""
    shared = spark.sparkContext.broadcast((tables, fits))  # at most MAX_FOLDED sums

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, fits = shared.value
        for batch in batches:
            for k in batch.column("id").to_pylist():
                r2, n = tables[fits[k].fold].score(fits[k])
                if n:
                    columns = [pa.array([fits[k].run]), pa.array([fits[k].held_out], pa.int32()), pa.array([r2], pa.float64()), pa.array([n], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["run", "fold", "r2", "n"])

    found = spark.range(0, len(fits), 1, max(1, len(fits))).mapInArrow(work, "run string, fold int, r2 double, n long")
    return materialize(found, "fold-scores")


def folded_models(spark, table: Folded, fits: list[Fit]) -> list[Trees]:
    """The model of every fit, one task each."""
    shared = spark.sparkContext.broadcast((table, fits))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, fits = shared.value
        for batch in batches:
            for k in batch.column("id").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([table.boost(fits[k]).dump()], pa.binary())], names=["id", "model"])

    found = spark.range(0, len(fits), 1, max(1, len(fits))).mapInArrow(work, "id long, model binary").collect()
    return [Trees.load(r["model"]) for r in sorted(found, key=lambda r: r["id"])]


SCHEMA = "run string, fold int, y double, prediction double, model binary"


def run_fits(rows: DataFrame, table: Quantised, fits: list[Fit]) -> DataFrame:
    """(run, fold, y, prediction, model): the predictions of every fit, one task each; ``model`` is set on one row of a fit of all rows."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((table, fits))  # at most MAX_CELLS bytes

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, fits = shared.value
        for batch in batches:
            for k in batch.column("id").to_pylist():
                at, predicted, model = table.boost(fits[k])
                n = len(at)
                whole = fits[k].fold is None
                columns = [
                    pa.array([fits[k].run] * n, pa.string()), pa.array(np.full(n, fits[k].held_out), pa.int32()),
                    pa.array(table.y[at]), pa.array(predicted), pa.array([None] * n, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["run", "fold", "y", "prediction", "model"])
                if whole:
                    one = [[fits[k].run], [None], [None], [None], [model.dump()]]
                    kinds = [pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(one, kinds)], names=["run", "fold", "y", "prediction", "model"])

    return spark.range(0, len(fits), 1, max(1, len(fits))).mapInArrow(work, SCHEMA)


class QuantisedTrees:
    """Estimator on a vector column ``x`` and a label; ``fit`` gives a ``QuantisedModel`` or MLlib's beyond the bound."""

    def __init__(self, params: TreeParams, label: str = "y", features: str = "x"):
        self.params, self.label, self.features = params, label, features

    def getMaxIter(self) -> int:
        return self.params.n_estimators

    def by_rows(self) -> GBTRegressor:
        """MLlib's estimator with the same parameters: every fit is spread over the rows."""
        p = self.params
        return GBTRegressor(
            featuresCol=self.features, labelCol=self.label, maxIter=p.n_estimators, maxDepth=p.max_depth, stepSize=p.learning_rate,
            subsamplingRate=p.subsample, featureSubsetStrategy=str(p.colsample_bytree), minInstancesPerNode=max(1, int(p.min_child_weight)),
            seed=SEED, cacheNodeIds=True, checkpointInterval=10,
        )

    def fit(self, rows: DataFrame):
        named = rows.withColumnRenamed(self.features, "x") if self.features != "x" else rows
        table = quantised(named, label=self.label)
        if table is None:
            sums = folded(named, None, self.params.subsample, self.label)
            if sums is None:
                return self.by_rows().fit(rows)
            return QuantisedModel(folded_models(rows.sparkSession, sums, [Fit("model", self.params)])[0], self.features)
        raw = run_fits(rows, table, [Fit("model", self.params)]).where("model IS NOT NULL").first()["model"]
        return QuantisedModel(Trees.load(raw), self.features)

    def out_of_fold(self, rows: DataFrame, n_folds: int, fold: str) -> DataFrame | None:
        """(fold, y, prediction) of every row by the model of the other folds, or None beyond the bound."""
        table = quantised(rows, [fold], self.label)
        fits = [Fit("cv", self.params, fold, f) for f in range(n_folds)]
        if table is None:
            sums = folded(rows, fold, self.params.subsample, self.label)
            return sums and self._held_out(rows, folded_models(rows.sparkSession, sums, fits), fold)
        return materialize(run_fits(rows, table, fits).select("fold", "y", "prediction"), "out-of-fold")


    def _held_out(self, rows: DataFrame, models: list[Trees], fold: str) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(models)

        @F.pandas_udf("double")
        def predict(x: pd.Series, held: pd.Series) -> pd.Series:
            out, held = np.full(len(x), np.nan), held.to_numpy()
            for f in np.unique(held):
                some = np.flatnonzero(held == f)
                out[some] = shared.value[f].predict(np.stack(x.to_numpy()[some]))
            return pd.Series(out)

        known = rows.where(F.col(fold).between(0, len(models) - 1))
        return materialize(
            known.select(
                F.col(fold).cast("int").alias("fold"), F.col(self.label).cast("double").alias("y"),
                predict(vector_to_array("x"), F.col(fold).cast("int")).alias("prediction"),
            ),
            "out-of-fold",
        )

    def fold_scores(self, rows: DataFrame, folds: dict[str, int]) -> DataFrame | None:
        """(run, fold, r2, n) per fold column (``run``) of a target beyond the bound; else None, as beyond its sums.

        The scores come from the sums, with no prediction per row.
        """
        if fits_whole(rows):
            return None
        found = binned(rows, list(folds), self.params.subsample, self.label)
        parts = []
        for name, n in folds.items():
            tables = found and found.folded([name])
            if not tables:
                return None
            # The drawn blocks of a fit follow its run, the same for every fold column.
            fits = [Fit("cv", self.params, name, f) for f in range(n)]
            parts.append(folded_scores(rows.sparkSession, {name: tables[0]}, fits).withColumn("run", F.lit(name)))
        return reduce(DataFrame.unionByName, parts)


class QuantisedModel:
    """Trained trees with the interface of a regression model of MLlib."""

    def __init__(self, trees: Trees, features: str = "x"):
        self.trees, self.features = trees, features

    @property
    def featureImportances(self):
        from pyspark.ml.linalg import DenseVector

        total = self.trees.gains.sum()
        return DenseVector(self.trees.gains / total if total > 0 else self.trees.gains)

    def transform(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self.trees)

        @F.pandas_udf("double")
        def predict(x: pd.Series) -> pd.Series:
            return pd.Series(shared.value.predict(np.stack(x.to_numpy())) if len(x) else [], dtype="float64")

        return df.withColumn("prediction", predict(vector_to_array(self.features)))
