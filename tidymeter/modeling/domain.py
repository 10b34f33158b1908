"""Applicability domain: exact k-nearest-neighbour distances without all-pairs work.

Equal points fold into one with a weight. Pivots cut the training points into
cells, and the distance to its pivot cuts a cell into rings of at most
``RING_POINTS`` points, as many as the data need. The triangle inequality bounds
every query's k-th distance and rules out cells and rings, so a query meets only
rings that can hold a neighbour. A task has the points of one ring and at most some
``RING_QUERIES`` of the queries that meet its cell; it keeps the k nearest of each, and
only these are shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidymeter.operators import ranks
from tidymeter.session import materialize

RING_POINTS = 4_000
RING_QUERIES = 20_000
MAX_PIVOTS = 2_048


def clean_vector(columns: list[str]) -> Column:
    """Feature vector as array of double, gaps as 0."""
    return F.array(*[F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns])


def distinct_points(df: DataFrame, vector: str = "v") -> DataFrame:
    """(v, weight): equal vectors combined before the shuffle."""
    return df.groupBy(vector).agg(F.count(F.lit(1)).alias("weight"))


def _pivots(points: DataFrame, vector: str) -> np.ndarray:
    """About sqrt(n) deterministic sample points, never more than the fixed limit."""
    n = points.count()
    count = max(1, min(MAX_PIVOTS, int(n**0.5)))
    rows = points.orderBy(F.md5(F.to_json(vector))).limit(count).select(vector).collect()
    return np.array([r[0] for r in rows], dtype=float)


def _to_pivots(vectors: pd.Series, pivots: np.ndarray) -> np.ndarray:
    """Distances of a batch of vectors to every pivot, in slices of bounded memory."""
    x = np.stack(vectors.to_numpy()) if len(vectors) else np.empty((0, pivots.shape[1]))
    out = np.empty((len(x), len(pivots)))
    step = max(1, 4_000_000 // max(1, pivots.size))
    for i in range(0, len(x), step):
        part = x[i : i + step, None, :] - pivots[None, :, :]
        out[i : i + step] = np.sqrt((part * part).sum(axis=2))
    return out


def knn(queries: DataFrame, train: DataFrame, k: int, exclude_self: bool, vector: str = "v") -> DataFrame:
    """Mean distance of each distinct query vector to its k nearest training rows.

    ``train``: (v, weight) of distinct points. With ``exclude_self`` the queries
    are the training points, and one row of the own weight does not count.
    """
    pivots = _pivots(train, vector)

    @F.pandas_udf("cell int, radius double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        d = _to_pivots(vectors, pivots)
        cell = d.argmin(axis=1) if len(d) else np.empty(0, dtype=int)
        return pd.DataFrame({"cell": cell, "radius": d[np.arange(len(d)), cell]})

    cells = materialize(
        train.select(vector, "weight", nearest(vector).alias("c")).select(
            vector, "weight", "c.cell", "c.radius"
        ),
        "cells",
    )
    need = k + 1 if exclude_self else k
    inner = (
        cells.withColumn("_rn", F.row_number().over(W.partitionBy("cell").orderBy("radius", vector)))
        .where(F.col("_rn") <= need)
        .groupBy("cell")
        .agg(F.array_sort(F.collect_list(F.struct("radius", "weight"))).alias("near"))
    )
    sizes = cells.groupBy("cell").agg(F.max("radius").alias("reach"))
    summary = {r["cell"]: r for r in sizes.join(inner, "cell").collect()}  # one row per pivot
    reach = np.full(len(pivots), -np.inf)
    kth = np.full(len(pivots), np.inf)
    for c, r in summary.items():
        reach[c] = r["reach"]
        seen = 0
        for radius, weight in r["near"]:
            seen += weight
            if seen >= need:
                kth[c] = radius
                break

    @F.pandas_udf("array<struct<cell:int,low:double,high:double>>")
    def reachable(vectors: pd.Series) -> pd.Series:
        d = _to_pivots(vectors, pivots)
        bound = (d + kth[None, :]).min(axis=1, keepdims=True) * (1 + 1e-12) + 1e-12
        out = []
        for row, b in zip(d, bound[:, 0]):
            own = np.flatnonzero(row - reach <= b)
            out.append(list(zip(own.tolist(), (row[own] - b).tolist(), (row[own] + b).tolist())))
        return pd.Series(out)

    placed = ranks.running_total(cells, ["cell"], ["radius", vector], F.lit(1), "_upto")
    ringed = materialize(
        placed.select("cell", F.floor((F.col("_upto") - 1) / RING_POINTS).alias("ring"), vector, "weight", "radius"), "rings"
    )
    rings = ringed.groupBy("cell", "ring").agg(F.min("radius").alias("inside"), F.max("radius").alias("outside"))
    asked = materialize(queries.select(vector).withColumn("_q", F.monotonically_increasing_id()), "queries")
    probes = materialize(
        asked.select("_q", vector, F.inline(reachable(vector))).join(rings, "cell")
        .where((F.col("inside") <= F.col("high")) & (F.col("outside") >= F.col("low"))).select("_q", vector, "cell", "ring"),
        "probes",
    )
    busy = {r["cell"]: r["c"] for r in probes.groupBy("cell").agg(F.count_distinct("_q").alias("c")).collect()}
    sizing = F.array(*[F.lit(-(-busy.get(c, 1) // RING_QUERIES)) for c in range(len(pivots))])
    salts = F.get(sizing, F.col("cell"))
    dealt = probes.withColumn("salt", F.pmod(F.xxhash64("_q"), salts).cast("int"))
    points = ringed.select("cell", "ring", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.col(vector).alias("_p"), "weight")
    by = ["cell", "ring", "salt"]
    found = dealt.groupBy(*by).cogroup(points.groupBy(*by)).applyInPandas(
        _nearest_in_ring(vector, k, exclude_self), "_q long, near array<struct<d:double,weight:bigint>>"
    )
    merged = found.groupBy("_q").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))

    def step(acc: Column, n: Column) -> Column:
        take = F.least(n["weight"], F.lit(k) - acc["n"])
        return F.struct((acc["n"] + take).alias("n"), (acc["sum"] + n["d"] * take).alias("sum"))

    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("sum"))
    mean = F.aggregate("near", none, step, lambda acc: F.try_divide(acc["sum"], acc["n"]))
    return asked.join(merged.select("_q", mean.alias("mean_distance")), "_q").drop("_q")


def _nearest_in_ring(vector: str, k: int, exclude_self: bool):
    """The points of a ring that each query needs for k rows, nearest first; the query's own point counts one row less."""

    def run(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(points):
            return pd.DataFrame({"_q": pd.Series(dtype="int64"), "near": pd.Series(dtype=object)})
        p, weight = np.stack(points["_p"].to_numpy()), points["weight"].to_numpy()
        q, out = np.stack(queries[vector].to_numpy()), []
        most = min(len(p), k + 1)
        step = max(1, 2_000_000 // p.size)
        for i in range(0, len(q), step):
            part = q[i : i + step, None, :] - p[None, :, :]
            d = np.sqrt((part * part).sum(axis=2))
            near = np.argpartition(d, most - 1, axis=1)[:, :most]
            for row, own, at in zip(d, near, range(i, i + len(d))):
                own = own[np.argsort(row[own], kind="stable")]
                left = weight[own].astype(int)
                if exclude_self:
                    left = left - (p[own] == q[at]).all(axis=1)
                out.append([(float(row[j]), int(w)) for j, w in zip(own, left) if w > 0])
        return pd.DataFrame({"_q": queries["_q"], "near": out})

    return run


def fit_domain(
    train: DataFrame, features: list[str], k: int = 5, percentile: float = 95.0, hot_rows: int | None = ranks.HOT_ROWS
) -> tuple[DataFrame, DataFrame]:
    """(training distances, one-row threshold table)."""
    rows = train.withColumn("v", clean_vector(features))
    points = materialize(distinct_points(rows), "points")
    total = points.agg(F.sum("weight")).first()[0]
    near = max(1, min(k, total - 1))
    distances = materialize(
        points.join(knn(points.select("v"), points, near, True), "v", "left"), "domain-distances"
    )
    threshold = weighted_quantile(distances, "mean_distance", "weight", percentile / 100.0)
    return distances, threshold.select(
        F.col("quantile").alias("threshold"), F.lit(near).alias("k"), F.col("n").alias("rows")
    )


def weighted_quantile(df: DataFrame, value: str, weight: str, p: float) -> DataFrame:
    """Interpolated quantile of values that occur ``weight`` times each; one row (n, quantile)."""
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(F.lit(0).alias("_all"), F.col(value).alias("_v"))
        .agg(F.sum(weight).alias("_n"))
    )
    placed = ranks.running_total(counts, ["_all"], ["_v"], F.col("_n"), "_upto")
    total = placed.agg(F.max("_upto")).scalar()
    rank = (total - 1) * F.lit(p)

    def at(position: Column) -> Column:
        hit = (F.col("_upto") - F.col("_n") <= position) & (position < F.col("_upto"))
        return F.max(F.when(hit, F.col("_v")))

    ends = placed.agg(
        F.max("_upto").alias("n"), at(F.floor(rank)).alias("lo"), at(F.ceil(rank)).alias("hi")
    )
    share = (F.col("n") - 1) * F.lit(p)
    part = share - F.floor(share)
    return ends.select("n", (F.col("lo") * (1 - part) + F.col("hi") * part).alias("quantile"))


def in_domain(
    train: DataFrame, new: DataFrame, features: list[str], threshold: float, k: int = 5
) -> DataFrame:
    """New rows with their distance to the training set and whether they are inside."""
    points = materialize(distinct_points(train.withColumn("v", clean_vector(features))), "points")
    rows = new.withColumn("v", clean_vector(features))
    total = points.agg(F.sum("weight")).first()[0]
    found = knn(rows.select("v").distinct(), points, max(1, min(k, total)), False)
    return rows.join(found, "v", "left").drop("v").withColumn(
        "in_domain", F.col("mean_distance") <= threshold
    )
