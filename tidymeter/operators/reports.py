"""Diagnostics and the aggregates behind plots and text reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidymeter import dictionaries as D
from tidymeter.functions import text as X
from tidymeter.operators import ranks


def _number(name: str) -> Column:
    return X.number_or_null(F.col(f"`{name}`").cast("string"))


def _family(spark, names: list[str]) -> dict[str, str]:
    """Family of every column name, by the same expression that classifies rows."""
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    return {r[0]: r[1] for r in frame.select("name", X.classify_column("name")).collect()}


def column_coverage(df: DataFrame) -> DataFrame:
    """Share of parseable numbers per column, with the column family.

    One pass with one counter per column; nothing is unpivoted.
    """
    names = df.columns
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(_number(c)).alias(f"filled_{i}") for i, c in enumerate(names)],
    )
    entries = [
        F.struct(F.lit(c).alias("column"), F.col(f"filled_{i}").alias("filled"))
        for i, c in enumerate(names)
    ]
    flat = counts.select("rows", F.inline(F.array(*entries)))
    return flat.select(
        "column", X.classify_column("column").alias("category"), "filled", "rows",
        F.try_divide(F.col("filled"), F.col("rows")).alias("coverage"),
    )


def category_summary(
    coverage: DataFrame, target_min: float = 0.05, feature_min: float = 0.10
) -> DataFrame:
    """Columns, usable columns and coverage range per family; input is one row per column."""
    floor = F.when(F.startswith("category", F.lit("target")), F.lit(target_min)).otherwise(
        F.lit(feature_min)
    )
    usable = F.col("coverage") >= floor
    listed = F.when(usable, F.struct((-F.col("coverage")).alias("rank"), F.col("column")))
    stats = ranks.order_stats(
        coverage.where(F.col("category") != "identity"),
        ["category"],
        "coverage",
        {"upper_median": ranks.upper_median_rank},
        {
            "usable": F.count_if(usable),
            "min_coverage": F.min("coverage"),
            "max_coverage": F.max("coverage"),
            "usable_columns": F.array_join(
                F.transform(F.array_sort(F.collect_list(listed)), lambda s: s["column"]), ";"
            ),
        },
    )
    return stats.withColumnRenamed("n", "columns")


def _filled(names: list[str]) -> Column:
    flags = [_number(c).isNotNull().cast("int") for c in names]
    return reduce(lambda a, b: a + b, flags) if flags else F.lit(0)


def row_completeness(df: DataFrame, features: list[str] | None = None, sparse_below: float = 0.3) -> DataFrame:
    """Mean filled share of the feature columns, and the rows below the threshold."""
    if features is None:
        families = _family(df.sparkSession, df.columns)
        features = [c for c in df.columns if families[c] == "feature"]
    share = _filled(features) / F.lit(float(max(1, len(features))))
    return df.select(share.alias("share")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("share").alias("mean_completeness"),
        F.count_if(F.col("share") < sparse_below).alias("sparse_rows"),
        F.avg((F.col("share") < sparse_below).cast("int")).alias("sparse_share"),
    )


def target_multiplicity(
    df: DataFrame, targets: list[str] | None = None, thresholds: tuple[int, ...] = (1, 2, 5, 10, 20)
) -> DataFrame:
    """Rows with at least k target values, for every k."""
    if targets is None:
        families = _family(df.sparkSession, df.columns)
        targets = [c for c in df.columns if families[c].startswith("target")]
    counts = df.select(_filled(targets).alias("values"))
    totals = counts.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("values") >= k).alias(f"at_least_{k}") for k in thresholds],
    )
    entries = [
        F.struct(F.lit(k).alias("threshold"), F.col(f"at_least_{k}").alias("rows"))
        for k in thresholds
    ]
    return totals.select("total", F.inline(F.array(*entries))).select(
        "threshold", "rows", F.try_divide(F.col("rows"), F.col("total")).alias("share")
    )


def recommend_targets(
    coverage: DataFrame, family: str = "target_antimicrobial", min_coverage: float = 0.05
) -> DataFrame:
    """Targets of one family above the coverage threshold, best covered first."""
    keep = (F.col("category") == family) & (F.col("coverage") >= min_coverage)
    return coverage.where(keep).select("column", "filled", "coverage").orderBy(
        F.desc("coverage"), "column"
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count")).orderBy(col)


def histogram(df: DataFrame, col: str, bins: int = 24) -> DataFrame:
    """Equal-width bins over [min, max] with their counts; empty bins are listed."""
    values = df.select(_number(col).alias("v")).where("v is not null")
    flat = F.col("lo") == F.col("hi")
    ends = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).select(
        F.struct(
            F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
            F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
        )
    ).scalar()
    place = F.floor((F.col("v") - ends["lo"]) * F.lit(float(bins)) / (ends["hi"] - ends["lo"]))
    counts = (
        values.select(F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # The frame takes its ends from the same scalar, so the column is read for the ends and for the counts only.
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), ends.alias("e"))
    width = (F.col("e.hi") - F.col("e.lo")) / bins
    return frame.where("e.lo is not null").join(counts, "bin", "left").select(
        "bin",
        (F.col("e.lo") + F.col("bin") * width).alias("low"),
        (F.col("e.lo") + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("n", F.lit(0)).alias("count"),
    )


def column_median(df: DataFrame, col: str, hot_rows: int | None = ranks.HOT_ROWS) -> DataFrame:
    """The median drawn into a histogram."""
    values = df.select(_number(col).alias("v"))
    return ranks.order_stats(values, [], "v", {"median": ranks.median_rank}, hot_rows=hot_rows)


def scatter(df: DataFrame, x: str, y: str, c: str | None = None) -> DataFrame:
    """Numeric x, y and colour columns; rows lacking x or y are left out."""
    picked = [_number(x).alias("x"), _number(y).alias("y")]
    picked.append((_number(c) if c else F.lit(None).cast("double")).alias("color"))
    return df.select(*picked).where("x is not null and y is not null")


def top_coverage(
    df: DataFrame, entity: str = "CID", prop: str = "StandardPropertyName", top: int = 15
) -> DataFrame:
    return (
        df.groupBy(prop)
        .agg(F.countDistinct(entity).alias("entities"))
        .orderBy(F.desc("entities"), prop)
        .limit(top)
    )


def availability(df: DataFrame, found: str, hits: str) -> DataFrame:
    """Total rows, rows found, rows with at least one literature hit."""
    yes = F.lower(F.col(found).cast("string")).isin("true", "1")
    matched = F.coalesce(F.col(hits).cast("string").try_cast("double"), F.lit(0.0)) > 0
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(yes).alias("found"),
        F.count_if(matched).alias("with_hits"),
    )


def box_stats(
    df: DataFrame,
    prop: str = "StandardPropertyName",
    value: str = "NumericValue",
    top: int = 6,
    hot_rows: int | None = ranks.HOT_ROWS,
) -> DataFrame:
    """Quartiles and 1.5-IQR whiskers of the most frequent properties."""
    frequent = (
        df.where(F.col(prop).isNotNull())
        .groupBy(prop)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .orderBy(F.desc("_rows"), prop)
        .limit(top)
        .select(prop)
    )
    rows = df.join(frequent, prop, "left_semi").where(F.col(value).isNotNull()).select(prop, value)
    stats = ranks.order_stats(
        rows,
        [prop],
        value,
        {
            "q1": ranks.quantile_rank(0.25),
            "median": ranks.median_rank,
            "q3": ranks.quantile_rank(0.75),
        },
        {"min": F.min(value), "max": F.max(value)},
        hot_rows,
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    fences = (
        rows.join(stats, prop)
        .groupBy(prop)
        .agg(
            F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )
    return stats.join(fences, prop)


def leaderboard(report: DataFrame, top: int = 20) -> DataFrame:
    """Best targets by cross-validated score, with band and over-fit gap."""
    score = F.col("cv_r2_mean")
    band = F.when(score >= 0.5, "good").when(score >= 0.2, "fair").otherwise("poor")
    return (
        report.orderBy(score.desc_nulls_last(), "target")
        .limit(top)
        .select(
            "target", "n_samples", "cv_r2_mean", "train_r2", band.alias("band"),
            (F.col("train_r2") - score).alias("gap"),
        )
    )


def leakage_grid(results: DataFrame, methods: list[str]) -> DataFrame:
    """Random minus grouped score, block by method."""
    gap = F.col("cv_r2_random") - F.col("cv_r2_grouped")
    return results.withColumn("gap", gap).groupBy("block").pivot("method", methods).agg(F.first("gap"))


def relevance_matrix(
    scores: DataFrame, methods: list[str], prefer: str = "with_block", top: int = 15
) -> DataFrame:
    """Scores of the top features by method, missing as 0; the preferred block if there is one."""
    has_preferred = scores.agg(F.bool_or(F.col("block") == prefer)).scalar()
    rows = scores.where((F.col("block") == prefer) | ~F.coalesce(has_preferred, F.lit(False)))
    best = (
        rows.groupBy("feature")
        .agg(F.max("score").alias("best"))
        .orderBy(F.desc("best"), "feature")
        .limit(top)
    )
    wide = (
        rows.join(best, "feature", "left_semi")
        .groupBy("feature")
        .pivot("method", methods)
        .agg(F.max("score"))
    )
    return wide.fillna(0.0, methods).join(best, "feature")


def top_importance(importance: DataFrame, k: int = 15) -> DataFrame:
    """The k most important features of every target."""
    w = W.partitionBy("target").orderBy(F.desc("importance"), "feature")
    return importance.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def scaling(df: DataFrame, group: str, threads: str = "threads", seconds: str = "seconds") -> DataFrame:
    """Speed-up against the smallest run of a group, the ideal, and the fastest run."""
    base = df.groupBy(group).agg(
        F.min(threads).alias("_threads"),
        F.min_by(seconds, threads).alias("_seconds"),
        F.min_by(threads, F.struct(seconds, threads)).alias("_best"),
    )
    return df.join(base, group).select(
        group, threads, seconds,
        F.try_divide(F.col("_seconds"), F.col(seconds)).alias("speedup"),
        F.try_divide(F.col(threads), F.col("_threads")).alias("ideal"),
        (F.col(threads) == F.col("_best")).alias("optimal"),
    )


def best_config_run(df: DataFrame, group: str) -> DataFrame:
    """Fastest successful configuration by total time.

    Without one: fastest by total time, else by partial time, of any row.
    """
    others = [c for c in df.columns if c != group]
    row = F.struct(*others)
    usable = F.col("success") & F.col("total_seconds").isNotNull()
    any_time = F.coalesce("total_seconds", "partial_seconds", F.lit(float("inf")))
    best = F.coalesce(
        F.min_by(row, F.when(usable, F.struct("total_seconds", "config"))),
        F.min_by(row, F.struct(any_time, F.col("config"))),
    )
    return df.groupBy(group).agg(best.alias("_row")).select(group, "_row.*")


def job_state(status) -> Column:
    """Status word -> done, failed or running."""
    word = F.lower(F.coalesce(X.as_col(status), F.lit("")))
    return (
        F.when(word.isin(D.DONE_STATUSES), F.lit("done"))
        .when(word.isin(D.FAILED_STATUSES), F.lit("failed"))
        .otherwise(F.lit("running"))
    )


def batch_status(df: DataFrame, total: int | None = None, status: str = "status", updated: str = "updated") -> DataFrame:
    """Done, failed, running and queued counts, throughput per hour and time left in seconds."""
    state = job_state(status)
    seconds = F.unix_micros(F.col(updated).cast("timestamp")) / F.lit(1e6)
    counts = df.agg(
        F.count_if(state == "done").alias("done"),
        F.count_if(state == "failed").alias("failed"),
        F.count_if(state == "running").alias("running"),
        F.count(F.lit(1)).alias("seen"),
        (F.max(seconds) - F.min(seconds)).alias("span"),
    )
    return status_rates(counts, total)


def status_rates(counts: DataFrame, total: int | None) -> DataFrame:
    """Rates from the counters done, failed, running, seen and span."""
    whole = F.lit(total).cast("bigint") if total is not None else F.col("seen")
    rate = F.when((F.col("done") >= 1) & (F.col("span") > 0), F.col("done") / F.col("span"))
    left = F.greatest(F.lit(0), whole - F.col("done") - F.col("failed"))
    return counts.select(
        "done", "failed", "running",
        F.greatest(F.lit(0), whole - F.col("done") - F.col("failed") - F.col("running")).alias("queued"),
        (rate * 3600.0).alias("per_hour"),
        F.try_divide(left, rate).alias("eta_seconds"),
    )


def timing_summary(df: DataFrame, seconds: str = "seconds", entities: str | None = None) -> DataFrame:
    """Entries, total seconds, and entities (or entries) per second."""
    count = F.countDistinct(entities) if entities else F.count(F.lit(1))
    return df.agg(
        F.count(F.lit(1)).alias("entries"), F.sum(seconds).alias("total_seconds"),
        count.alias("entities"),
    ).withColumn(
        "per_second",
        F.when(F.col("total_seconds") > 0, F.col("entities") / F.col("total_seconds")).otherwise(0.0),
    )


def batch_summary(df: DataFrame, success: str = "success") -> DataFrame:
    return df.agg(
        F.count_if(F.col(success)).alias("succeeded"),
        F.count_if(~F.coalesce(F.col(success), F.lit(False))).alias("failed"),
    )


SUMMARY_COLUMNS = ["cid", "success", "energy_ha", "temp_K", "zpe_kcal", "th_kcal", "ts_cal_K", "error_msg"]


def batch_table(df: DataFrame) -> DataFrame:
    """The per-job table written next to the counts."""
    return df.select(*SUMMARY_COLUMNS)


def completed_counts(df: DataFrame, state: str = "state", success: str = "success") -> DataFrame:
    return df.groupBy(state).agg(F.count_if(F.col(success)).alias("completed"))


def preview(df: DataFrame, n: int, ordinal: str = "ordinal") -> DataFrame:
    """The first n rows as text, nulls shown blank."""
    head = df.orderBy(ordinal).limit(n)
    return head.select(
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns]
    )
