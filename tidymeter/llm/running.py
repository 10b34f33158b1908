"""Running totals inside each key in a total order, without gathering a key in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidymeter.session import materialize


def running_totals(
    df: DataFrame, keys: list[str], order: list[Column], amount: Column, out: str, about: DataFrame | None = None
) -> DataFrame:
    """Adds ``out``: the sum of ``amount`` over the rows before, inside each value of ``keys`` (null is a value).

    Rows are range-partitioned by key and order, so that a hot key spreads over
    many ranges. A total per (key, range) says where a range begins, a window goes
    on inside it. ``order`` should tell all rows apart. ``about`` has one row per
    value of ``keys``; its other columns ride on the few totals and are added.
    """
    by = [F.col(k).asc_nulls_first() for k in keys] + order
    ranged = materialize(df.withColumn("_amount", amount).repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "ranged")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*keys, "_part").agg(F.sum("_amount").alias("_total"))
    renamed = [f"_key{i}" for i in range(len(keys))]
    starts = totals.select(
        *[F.col(k).alias(r) for k, r in zip(keys, renamed)], F.col("_part").alias("_range"),
        F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"),
    )
    more = []
    if about is not None:
        more = [c for c in about.columns if c not in keys]
        starts = starts.join(about, _equal(about, keys, renamed)).drop(*keys)
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumn("_inside", F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
    joined = own.join(starts, _equal(own, [*keys, "_part"], [*renamed, "_range"]))
    return joined.select(*df.columns, *more, (F.col("_start") + F.col("_inside")).cast("long").alias(out))


def _equal(left: DataFrame, keys: list[str], others: list[str]) -> Column:
    """A null key equals a null key."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(F.col(o)) for k, o in zip(keys, others)])
