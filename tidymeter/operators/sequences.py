"""Round-robin interleaving and canonical cyclic sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidymeter.functions.text import as_col
from tidymeter.operators import ranks


def interleave(
    df: DataFrame,
    group: str,
    sort_key: str,
    ordinal: str,
    group_order: str | None = None,
    hot_rows: int = ranks.HOT_ROWS,
) -> DataFrame:
    """Round-robin over the groups, each sorted by a numeric key (null counts as 0).

    ``round`` is the position inside the group; the rows are ordered by round,
    then by group.
    """
    number = F.coalesce(F.col(sort_key).cast("string").try_cast("double"), F.lit(0.0))
    ranked = ranks.exact_rank(
        df.withColumn("_sort", number), [group], ["_sort", ordinal], "round", hot_rows
    )
    return ranked.drop("_sort").orderBy("round", group_order or group)


def rotations(c: Column) -> Column:
    n = F.size(c)
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.concat(F.slice(c, i + 1, n - i), F.slice(c, F.lit(1), i)),
    )


def canonical_cycle(c) -> Column:
    """Smallest rotation of a sequence and of its reversal."""
    c = as_col(c)
    return F.when(F.size(c) == 0, c).otherwise(
        F.array_min(F.concat(rotations(c), rotations(F.reverse(c))))
    )


def has_forbidden_neighbours(c, forbidden: list[tuple[str, str]]) -> Column:
    """Whether any two cyclic neighbours form one of the unordered pairs."""
    c = as_col(c)
    n = F.size(c)
    pairs = F.array(*[F.concat(F.lit(x), F.lit("|"), F.lit(y)) for a, b in forbidden for x, y in {(a, b), (b, a)}])
    hit = F.exists(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.array_contains(
            pairs, F.concat(F.get(c, i), F.lit("|"), F.get(c, (i + 1) % n))
        ),
    )
    return F.when(n < 2, F.lit(False)).otherwise(hit)


def max_cyclic_run(c, item: str) -> Column:
    """Longest run of one item around the cycle."""
    c = as_col(c)
    best = F.aggregate(
        F.concat(c, c),
        F.struct(F.lit(0).alias("run"), F.lit(0).alias("best")),
        lambda a, x: F.struct(
            F.when(x == item, a["run"] + 1).otherwise(F.lit(0)).alias("run"),
            F.greatest(a["best"], F.when(x == item, a["run"] + 1).otherwise(F.lit(0))).alias("best"),
        ),
        lambda a: a["best"],
    )
    return F.least(best, F.size(c))


def canonical_cycles(df: DataFrame, col: str) -> DataFrame:
    """Distinct canonical cycles with how many input sequences fold into each."""
    return (
        df.select(canonical_cycle(col).alias(col))
        .groupBy(col)
        .agg(F.count(F.lit(1)).alias("sequences"))
    )
