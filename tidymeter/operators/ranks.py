"""Exact order statistics and ranks that survive hot groups.

A group may hold a third of all rows. Ordinary groups are aggregated in one
task each; groups above ``hot_rows`` take the chunked route: rows are range
partitioned by (group, order), so that a hot group spreads over many
tasks, and a running total over its chunks (at most one per partition) turns
positions inside a chunk into positions inside the group.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidymeter.session import cut_lineage

HOT_ROWS = 100_000


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on equal keys where null equals null; the key columns of ``left`` stay."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__{k}")
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"__{k}" for k in keys])


def hot_groups(df: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    """Keys (and size) of the groups above the limit, counted with map-side combine."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > hot_rows)


def size_guard(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> int | None:
    """None when no group of these coarse keys is hot, else the limit.

    Groups by more columns are never larger than groups by fewer, so one cheap
    count over the raw key column can spare the finer checks downstream.
    """
    return None if hot_groups(df, keys, hot_rows).isEmpty() else hot_rows


def _ordered(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def running_total(
    df: DataFrame, keys: list[str], order: list[Column | str], weight: Column, name: str
) -> DataFrame:
    """Inclusive running sum of ``weight`` in each group, spread over range chunks.

    ``order`` must be total within a group. The range partitioned rows are
    checkpointed, so both uses below read the same chunks.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort = [F.col(k).asc_nulls_first() for k in keys] + [_ordered(c) for c in order]
    chunked = cut_lineage(
        df.withColumn("_w", weight)
        .repartitionByRange(parts, *sort)
        .withColumn("_chunk", F.spark_partition_id())
    )
    before = (
        chunked.groupBy(*keys, "_chunk")
        .agg(F.sum("_w").alias("_total"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_total").over(
                    W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("_total")
    )
    inside = F.sum("_w").over(
        W.partitionBy(*keys, "_chunk")
        .orderBy(*[_ordered(c) for c in order])
        .rowsBetween(W.unboundedPreceding, 0)
    )
    return (
        null_safe_join(chunked, before, [*keys, "_chunk"], "inner")
        .withColumn(name, inside + F.col("_before"))
        .drop("_w", "_chunk", "_before")
    )


def exact_rank(
    df: DataFrame, keys: list[str], order: list[Column | str], name: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Row number (from 1) within each group; ``order`` must be total.

    Without keys the whole table is one group, which is hot by nature.
    """
    if keys and hot_groups(df, keys, hot_rows).isEmpty():
        return df.withColumn(
            name, F.row_number().over(W.partitionBy(*keys).orderBy(*[_ordered(c) for c in order]))
        )
    if not keys:
        flat = df.withColumn("_all", F.lit(0))
        return running_total(flat, ["_all"], order, F.lit(1), name).drop("_all")
    return running_total(df, keys, order, F.lit(1), name)


def hash_rank(
    df: DataFrame,
    keys: list[str],
    digest: Column,
    tie: list[str],
    name: str,
    digits: int = 4,
    total: str | None = None,
) -> DataFrame:
    """Row number (from 1) by a hexadecimal digest, without any hot task.

    A digest is uniform, so its leading digits cut every group into even
    buckets; bucket totals give the offset of each bucket. ``total`` names an
    extra column with the size of the group, which the same totals give.
    """
    work = df.withColumn("_digest", digest).withColumn("_bucket", F.substring("_digest", 1, digits))
    offsets = (
        work.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_n").over(
                    W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .withColumn("_total", F.sum("_n").over(W.partitionBy(*keys)))
        .drop("_n")
    )
    inside = F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy("_digest", *tie))
    return (
        null_safe_join(work, offsets, [*keys, "_bucket"], "inner")
        .withColumn(name, inside + F.col("_before"))
        .withColumns({total: F.col("_total")} if total else {})
        .drop("_digest", "_bucket", "_before", "_total")
    )


# --- order statistics -------------------------------------------------------------------

Rank = Callable[[Column], Column]


def median_rank(n: Column) -> Column:
    return (n - 1) / F.lit(2.0)


def quantile_rank(p: float) -> Rank:
    return lambda n: (n - 1) * F.lit(float(p))


def upper_median_rank(n: Column) -> Column:
    return F.floor(n / 2).cast("double")


def lower_half_rank(n: Column) -> Column:
    """Median position of the lower half (the middle value belongs to neither half)."""
    return (F.floor(n / 2) - 1) / F.lit(2.0)


def upper_half_rank(n: Column) -> Column:
    return n - F.floor(n / 2) + (F.floor(n / 2) - 1) / F.lit(2.0)


def _between(low: Column, high: Column, rank: Column) -> Column:
    share = rank - F.floor(rank)
    return F.when(share == 0, low).otherwise(low * (F.lit(1.0) - share) + high * share)


def order_stats(
    df: DataFrame,
    keys: list[str],
    value: str,
    ranks: dict[str, Rank],
    extra: dict[str, Column] | None = None,
    hot_rows: int | None = HOT_ROWS,
    keep_values: str | None = None,
) -> DataFrame:
    """Exact interpolated order statistics per group, plus plain aggregates.

    ``hot_rows=None`` states that the caller has bounded the groups (``size_guard``).

    ``ranks`` maps an output name to a function from the group size to a
    zero-based fractional position; null values are not counted, and a group
    without any value has n = 0. Output: keys, ``n``, the statistics and
    ``extra``. ``keep_values`` names an extra array column
    with the sorted values, null for groups above ``hot_rows``.
    """
    extra = extra or {}
    work, flat = df, not keys
    if flat:
        work, keys = work.withColumn("_all", F.lit(0)), ["_all"]
    hot, any_hot = None, False
    if hot_rows is not None:
        hot = hot_groups(work.where(F.col(value).isNotNull()), keys, hot_rows)
        any_hot = not hot.isEmpty()
    cold = null_safe_join(work, hot, keys, "left_anti") if any_hot else work

    arrays = cold.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.sort_array(F.collect_list(value)).alias("_values"),
        *[c.alias(name) for name, c in extra.items()],
    )

    def at(position: Column) -> Column:
        return F.get("_values", position.cast("int"))

    picked = [
        _between(at(F.floor(r(F.col("n")))), at(F.ceil(r(F.col("n")))), r(F.col("n"))).alias(name)
        for name, r in ranks.items()
    ]
    kept = [F.col("_values").alias(keep_values)] if keep_values else []
    out = arrays.select(*keys, "n", *picked, *extra, *kept)

    if any_hot:
        rows = null_safe_join(work, hot, keys, "inner").drop("_size")
        counts = (
            rows.where(F.col(value).isNotNull())
            .groupBy(*keys, value)
            .agg(F.count(F.lit(1)).alias("_n"))
        )
        placed = null_safe_join(
            running_total(counts, keys, [value], F.col("_n"), "_upto"), hot, keys, "inner"
        )

        def pick(position: Column) -> Column:
            hit = (F.col("_upto") - F.col("_n") <= position) & (position < F.col("_upto"))
            return F.max(F.when(hit, F.col(value)))

        n = F.col("_size")
        ends = placed.groupBy(*keys, F.col("_size").alias("n")).agg(
            *[pick(F.floor(r(n))).alias(f"_lo_{i}") for i, r in enumerate(ranks.values())],
            *[pick(F.ceil(r(n))).alias(f"_hi_{i}") for i, r in enumerate(ranks.values())],
        )
        plain = [c.alias(name) for name, c in extra.items()]
        spread = [
            _between(F.col(f"_lo_{i}"), F.col(f"_hi_{i}"), r(F.col("n"))).alias(name)
            for i, (name, r) in enumerate(ranks.items())
        ]
        stats = ends.select(*keys, "n", *spread)
        if plain:
            stats = null_safe_join(stats, rows.groupBy(*keys).agg(*plain), keys, "inner")
        if keep_values:
            stats = stats.withColumn(keep_values, F.lit(None).cast(out.schema[keep_values].dataType))
        out = out.unionByName(stats.select(out.columns))
    return out.drop("_all") if flat else out
