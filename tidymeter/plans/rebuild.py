"""Wide tables from saved long tables: raw pivot, activity merge, values only."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidymeter.operators import activity as A, wide as W
from tidymeter.operators.ranks import size_guard


def activity_columns(activities: DataFrame, threshold: float = 2.0, legacy: bool = False) -> DataFrame:
    """Wide activity columns after both quality levels."""
    guard = A.entity_guard(activities)
    assays = A.assay_level(A.activity_features(activities, legacy), threshold, guard)
    passing, _ = A.assay_qc(assays)
    return A.activity_wide(A.target_level(passing, threshold, guard))


def merged_wide(long: DataFrame, activities: DataFrame, threshold: float = 2.0) -> DataFrame:
    wide = W.pivot_raw(long, hot_rows=size_guard(long, ["CID"]))
    return A.merge_activity(wide, activity_columns(activities, threshold))


def rebuild_wide(long: DataFrame, activities: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Recovery from the two long tables by the older merge rules, values only."""
    wide = W.pivot_raw(long, hot_rows=size_guard(long, ["CID"]))
    activity = activity_columns(activities, threshold, legacy=True)
    return W.values_only(A.merge_activity(wide, activity))
