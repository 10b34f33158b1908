"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a minimum per node with map-side combine and a join back against one
row per node, so that adaptive execution can split a hub. Each round is written to
the shared scratch folder, which cuts the lineage; only a row count and a checksum
reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidymeter.session import discard, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge; the component is its least node.

    Null ends, loops and repeated edges are ignored; no edges give no rows.
    """
    low, high = F.least(a, b).alias("low"), F.greatest(a, b).alias("high")
    clean = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = materialize(clean.select(low, high).distinct(), "edges")
    before = None
    while (state := _state(now)) != before:
        before, last = state, now
        now = materialize(_small_star(_large_star(last)), "edges")
        discard(last)
    tops = now.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return now.select(F.col("high").alias("node"), F.col("low").alias("component")).union(tops)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the least node around it."""
    both = edges.select(F.col("low").alias("u"), F.col("high").alias("v")).union(
        edges.select(F.col("high").alias("u"), F.col("low").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.filter("v > u").join(least, "u")
    return moved.select(F.col("m").alias("low"), F.col("v").alias("high")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of them."""
    least = edges.groupBy("high").agg(F.min("low").alias("m"))
    moved = edges.join(least, "high").filter("low <> m")
    moved = moved.select(F.col("m").alias("low"), F.col("low").alias("high"))
    own = least.select(F.col("m").alias("low"), "high")
    return moved.union(own).distinct()
