"""Bioactivity: feature naming, two-level replicate quality control, wide columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidymeter.functions import numeric as N, text as X
from tidymeter.operators import ranks
from tidymeter.operators.cleaning import drop_censored
from tidymeter.operators.wide import column_names, halves_stats, open_rows, spread
from tidymeter.session import materialize

STATISTICS = ["Median", "Count", "IQR", "RelativeIQR", "Min", "Max", "FoldRange", "AssayCount"]
REVIEW_COLUMNS = [
    "QCLevel", "CID", "FeatureName", "WideColumn", "AssayID", "Count", "Median", "IQR",
    "RelativeIQR", "Min", "Max", "FoldRange", "Values",
]


def entity_guard(activities: DataFrame) -> int | None:
    """Hot limit for the groups below an entity, or None if no entity is hot; entities are trimmed as in the features."""
    return ranks.size_guard(activities.select(X.strip(F.col("CID").cast("string")).alias("CID")), ["CID"])


def activity_features(df: DataFrame, legacy: bool = False) -> DataFrame:
    """(CID, FeatureName, AssayID, value) of every usable activity row.

    A parseable log activity wins; otherwise a positive raw value is taken.
    ``legacy`` skips a row whose log activity is present but unparseable.
    """
    def text(c: str):
        return X.strip(F.coalesce(F.col(c).cast("string"), F.lit("")))

    raw_log = F.col("pChemblValue").cast("string")
    log_value = X.number_or_null(raw_log)
    plain = X.number_or_null(F.col("Value").cast("string"))
    positive = F.when(plain > 0, plain)
    if legacy:
        positive = F.when(F.coalesce(raw_log, F.lit("")) == "", positive)
    label = X.collapse_ws(
        F.coalesce(F.nullif(text("TargetName"), F.lit("")), F.nullif(text("Target"), F.lit("")),
                   F.lit("Unchecked"))
    )
    kind = F.when(log_value.isNotNull(), F.lit("pActivity")).otherwise(text("ActivityType"))
    feature = F.concat(text("Source"), F.lit(":"), kind, F.lit(" ["), label, F.lit("]"))
    assay = X.strip(F.coalesce(F.nullif(F.col("AssayID").cast("string"), F.lit("")), F.lit("NO_ASSAY")))
    return (
        drop_censored(df)
        .select(
            X.strip(F.col("CID").cast("string")).alias("CID"),
            feature.alias("FeatureName"),
            assay.alias("AssayID"),
            F.coalesce(log_value, positive).alias("value"),
        )
        .where(F.col("value").isNotNull())
    )


def _qc(stats: DataFrame, threshold: float) -> DataFrame:
    ratio = N.relative_iqr("iqr", "median")
    return stats.withColumns(
        {
            "relative_iqr": ratio,
            "fold_range": N.fold_range("min", "max"),
            "rejected": (F.col("n") >= 3) & (ratio > threshold),
        }
    )


def assay_level(features: DataFrame, threshold: float = 2.0, hot_rows: int | None = ranks.HOT_ROWS) -> DataFrame:
    """Replicates collapsed per (entity, feature, assay), with the reject flag."""
    stats = halves_stats(
        features, ["CID", "FeatureName", "AssayID"], "value", hot_rows, keep_values="values"
    )
    return _qc(stats, threshold)


def assay_qc(assays: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(passing, rejected) assay groups."""
    return assays.where(~F.col("rejected")), assays.where(F.col("rejected"))


def target_level(
    passing: DataFrame, threshold: float = 2.0, hot_rows: int | None = ranks.HOT_ROWS
) -> DataFrame:
    """Median of the assay medians per (entity, feature), with the reject flag."""
    medians = passing.select("CID", "FeatureName", F.col("median").alias("value"))
    stats = halves_stats(medians, ["CID", "FeatureName"], "value", hot_rows, keep_values="values")
    return _qc(stats, threshold)


def activity_long(targets: DataFrame) -> DataFrame:
    """The eight statistics of every accepted (entity, feature), long form."""
    return targets.where(~F.col("rejected")).select(
        "CID", "FeatureName",
        F.col("median").alias("Median"), F.col("n").alias("Count"), F.col("iqr").alias("IQR"),
        F.col("relative_iqr").alias("RelativeIQR"), F.col("min").alias("Min"),
        F.col("max").alias("Max"), F.col("fold_range").alias("FoldRange"),
        F.col("n").alias("AssayCount"),
    )


def activity_wide(targets: DataFrame) -> DataFrame:
    """One row per entity, eight columns per feature; the pivot comes last."""
    rows = materialize(activity_long(targets), "activity-long")
    names = column_names(rows, "FeatureName")
    if not names:
        return rows.select("CID").where(F.lit(False))
    return spread(rows, ["CID"], "FeatureName", names, STATISTICS)


def activity_open(targets: DataFrame) -> DataFrame:
    """``activity_wide`` with one map per entity, for any number of features: feature -> the eight statistics."""
    return open_rows(activity_long(targets), ["CID"], "FeatureName", STATISTICS)


def _review(rejected: DataFrame, level: str) -> DataFrame:
    assay = F.col("AssayID") if "AssayID" in rejected.columns else F.lit("")
    return rejected.select(
        F.lit(level).alias("QCLevel"), "CID", "FeatureName",
        F.concat(F.col("FeatureName"), F.lit("_Median")).alias("WideColumn"),
        assay.alias("AssayID"), F.col("n").alias("Count"), F.col("median").alias("Median"),
        F.col("iqr").alias("IQR"), F.col("relative_iqr").alias("RelativeIQR"),
        F.col("min").alias("Min"), F.col("max").alias("Max"),
        F.col("fold_range").alias("FoldRange"),
        F.array_join(F.transform("values", lambda v: v.cast("string")), ";").alias("Values"),
    )


def qc_review(assays: DataFrame, targets: DataFrame) -> DataFrame:
    """Rejected groups of both levels, one row each.

    Values lists the sorted values; for a group above the hot limit it is null
    and ``qc_values`` has the values, one row each.
    """
    return _review(assays.where(F.col("rejected")), "ASSAY").unionByName(
        _review(targets.where(F.col("rejected")), "TARGET")
    )


def qc_values(features: DataFrame, assays: DataFrame, targets: DataFrame) -> DataFrame:
    """Every value of every rejected group in long form, whatever the group size."""
    bad_assays = assays.where(F.col("rejected")).select("CID", "FeatureName", "AssayID")
    bad_targets = targets.where(F.col("rejected")).select("CID", "FeatureName")
    first = features.join(bad_assays, ["CID", "FeatureName", "AssayID"], "left_semi")
    second = (
        assays.where(~F.col("rejected"))
        .select("CID", "FeatureName", "AssayID", F.col("median").alias("value"))
        .join(bad_targets, ["CID", "FeatureName"], "left_semi")
    )
    columns = ["CID", "FeatureName", "AssayID", "value"]
    return (
        first.select(F.lit("ASSAY").alias("QCLevel"), *columns)
        .unionByName(second.select(F.lit("TARGET").alias("QCLevel"), *columns))
        .groupBy("QCLevel", *columns)
        .agg(F.count(F.lit(1)).alias("times"))
    )


def merge_activity(wide: DataFrame, activity: DataFrame) -> DataFrame:
    """Left join on the entity; entities known only by activity are dropped."""
    clash = [c for c in activity.columns if c != "CID" and c in wide.columns]
    return wide.drop(*[f"{c}" for c in clash]).join(activity, "CID", "left")
