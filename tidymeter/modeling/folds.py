"""Fold assignment without hot tasks: random, grouped, repeated grouped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidymeter.operators.ranks import hash_rank, null_safe_join


def digest(*parts) -> Column:
    """Seeded uniform digest of a key; any engine can reproduce it."""
    return F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.col(p).cast("string") for p in parts]))


def fold_count(n: Column, max_folds: int, min_folds: int = 2) -> Column:
    return F.least(F.lit(max_folds), F.greatest(F.lit(min_folds), F.floor(n / 10)))


def random_folds(
    df: DataFrame, key: str, target: list[str] | None = None, max_folds: int = 5, seed: int = 42
) -> DataFrame:
    """Balanced shuffled folds per target; fold sizes differ by at most one."""
    rows = df if target else df.withColumn("_one", F.lit(0))
    ranked = hash_rank(rows, target or ["_one"], digest(key, F.lit(str(seed))), [key], "_rank", total="_n")
    folds = ranked.withColumn("fold", ((F.col("_rank") - 1) % fold_count(F.col("_n"), max_folds)).cast("int"))
    return folds.drop("_rank", "_n", "_one")


def _segments(sizes: list[tuple[int, int]], folds: int) -> list[tuple[int, int, list[int]]]:
    """Where the largest-first assignment sends the groups of each size.

    ``sizes``: (size, how many groups), largest first. Equal groups always go to
    the lightest fold, so folds enter the rotation as the others catch up with
    them; each returned (size, first rank, rotation) is one such stretch.
    """
    loads = [0] * folds
    out: list[tuple[int, int, list[int]]] = []
    for size, count in sizes:
        base = min(loads)
        lag = [((load - base) // size, (load - base) % size, i) for i, load in enumerate(loads)]
        starts = sorted({a for a, _, _ in lag})
        placed = 0
        for at, level in enumerate(starts):
            turn = [i for a, r, i in sorted(lag, key=lambda x: (x[1], x[2])) if a <= level]
            out.append((size, placed, turn))
            last = at + 1 == len(starts)
            room = count - placed if last else (starts[at + 1] - level) * len(turn)
            take = min(room, count - placed)
            for j, i in enumerate(turn):
                loads[i] += size * (take // len(turn) + (1 if j < take % len(turn) else 0))
            placed += take
            if placed >= count:
                break
    return out


def group_folds(
    df: DataFrame, group: str, max_folds: int = 5, min_folds: int = 3, folds: int | None = None
) -> DataFrame:
    """Whole groups into folds, largest first, each to the lightest fold.

    Only the histogram of group sizes is walked on the driver: n rows have at
    most sqrt(2 n) different group sizes. The groups get their place in their
    size class by a distributed rank.
    """
    spark = df.sparkSession
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    histogram = [
        (r["_size"], r["c"])
        for r in sizes.groupBy("_size").agg(F.count(F.lit(1)).alias("c"))
        .orderBy(F.desc("_size")).collect()
    ]
    rows = sum(s * c for s, c in histogram)
    groups = sum(c for _, c in histogram)
    k = folds or min(max_folds, max(min_folds, rows // 10), groups)
    if k < 2:
        return df.withColumn("fold", F.lit(0))
    plan = spark.createDataFrame(_segments(histogram, k), "_size long, _first long, _turn array<int>")
    stretches = plan.groupBy("_size").agg(
        F.array_sort(F.collect_list(F.struct("_first", "_turn"))).alias("_parts")
    )
    placed = hash_rank(sizes, ["_size"], digest(group), [group], "_rank").join(stretches, "_size")
    at = F.col("_rank") - 1
    part = F.try_element_at(F.filter("_parts", lambda p: p["_first"] <= at), F.lit(-1))
    assigned = placed.withColumn("_part", part).select(
        group,
        F.get("_part._turn", ((at - F.col("_part._first")) % F.size("_part._turn")).cast("int")).alias("fold"),
    )
    return null_safe_join(df, assigned, [group], "inner")


def repeated_group_folds(df: DataFrame, group: str, folds: int, repeats: int) -> DataFrame:
    """One row per (row, repeat): in every repeat the groups are shuffled anew over the folds.

    Rows without a group form a group of their own.
    """
    groups = df.select(group).distinct().withColumn(
        "repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
    )
    ranked = hash_rank(groups, ["repeat"], digest("repeat", group), [group], "_rank")
    table = ranked.select(group, "repeat", ((F.col("_rank") - 1) % folds).cast("int").alias("fold"))
    return null_safe_join(df, table, [group], "inner")
