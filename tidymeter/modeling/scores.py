"""Scores from predictions: cross-validated R2, dual evaluation, intervals, scramble control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidymeter.modeling.folds import digest
from tidymeter.operators import ranks


def r2(y: str = "y", p: str = "prediction") -> Column:
    """1 - SSE/SST as one aggregate; null for a constant target."""
    error = F.sum(F.pow(F.col(y) - F.col(p), 2))
    return F.lit(1.0) - F.try_divide(error, F.regr_syy(F.col(y), F.col(y)))


def fold_scores(preds: DataFrame, by: list[str] | None = None, y: str = "y", p: str = "prediction") -> DataFrame:
    return preds.groupBy(*(by or []), "fold").agg(r2(y, p).alias("r2"), F.count(F.lit(1)).alias("n"))


def cv_r2(preds: DataFrame, by: list[str] | None = None, y: str = "y", p: str = "prediction") -> DataFrame:
    """Mean and population standard deviation of the fold scores."""
    return mean_scores(fold_scores(preds, by, y, p), by)


def mean_scores(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean and population standard deviation of ``fold_scores``."""
    return scores.groupBy(*(by or [])).agg(
        F.avg("r2").alias("cv_r2_mean"), F.stddev_pop("r2").alias("cv_r2_std"),
        F.count(F.lit(1)).alias("cv_folds"),
    )


def only_row(df: DataFrame) -> Column:
    """The single row of a table as a struct column (a scalar subquery, no join)."""
    return df.select(F.struct(*df.columns)).scalar()


def evaluation(
    random: DataFrame | None, grouped: DataFrame | None, counts: DataFrame, min_samples: int = 50
) -> DataFrame:
    """One row with both scores; the grouped one is primary when there is one.

    ``counts``: one row with n_samples and n_groups; the scores are rows of ``cv_r2``.
    """
    def fields(df: DataFrame | None, name: str) -> dict[str, Column]:
        row = only_row(df) if df is not None else None

        def field(c: str, kind: str) -> Column:
            return (row[c] if row is not None else F.lit(None)).cast(kind)

        return {
            f"cv_r2_{name}": field("cv_r2_mean", "double"),
            f"cv_r2_{name}_std": field("cv_r2_std", "double"),
            f"_folds_{name}": field("cv_folds", "bigint"),
        }

    one = counts.withColumns(fields(random, "random") | fields(grouped, "grouped"))
    use_grouped = F.col("cv_r2_grouped").isNotNull()
    reliable = (F.col("n_samples") >= min_samples) & (F.col("n_groups") >= 5)
    note = F.concat(
        F.lit("low data (n="), F.col("n_samples").cast("string"), F.lit(", groups="),
        F.col("n_groups").cast("string"), F.lit(")"),
    )
    return one.select(
        "n_samples", "n_groups", "cv_r2_random", "cv_r2_random_std", "cv_r2_grouped", "cv_r2_grouped_std",
        F.coalesce("_folds_grouped", "_folds_random").alias("cv_folds"),
        F.coalesce("cv_r2_grouped", "cv_r2_random").alias("cv_r2_mean"),
        F.when(use_grouped, F.col("cv_r2_grouped_std")).otherwise(F.col("cv_r2_random_std")).alias("cv_r2_std"),
        F.when(use_grouped, "grouped").otherwise("random").alias("cv_method"),
        reliable.alias("reliable"), F.when(reliable, "").otherwise(note).alias("reliability_note"),
    )


def conformal(
    preds: DataFrame, alpha: float = 0.2, y: str = "y", p: str = "prediction",
    hot_rows: int | None = ranks.HOT_ROWS,
) -> DataFrame:
    """(1 - alpha) quantile of the absolute out-of-fold residuals."""
    rows = preds.select(F.abs(F.col(y) - F.col(p)).alias("residual"))
    stats = ranks.order_stats(
        rows, [], "residual", {"halfwidth": ranks.quantile_rank(1.0 - alpha)}, hot_rows=hot_rows
    )
    return stats.withColumn("level", F.lit(1.0 - alpha))


def scrambled(df: DataFrame, key: str, y: str = "y", seed: int = 0) -> DataFrame:
    """The same rows with y permuted: two shuffled rankings of the rows are matched."""
    base = df.withColumn("_one", F.lit(0))
    place = ranks.hash_rank(base, ["_one"], digest(key), [key], "_rank").drop(y)
    donor = ranks.hash_rank(
        base.select("_one", key, y), ["_one"], digest(key, F.lit(str(seed))), [key], "_rank"
    ).select("_rank", y)
    return place.join(donor, "_rank").drop("_rank", "_one")


def regression_metrics(preds: DataFrame, y: str = "y", p: str = "prediction") -> DataFrame:
    """In-sample R2, RMSE and MAE."""
    error = F.col(y) - F.col(p)
    return preds.agg(
        r2(y, p).alias("train_r2"), F.sqrt(F.avg(error * error)).alias("train_rmse"),
        F.avg(F.abs(error)).alias("train_mae"),
    )
