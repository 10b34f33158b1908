"""The cleaning job: raw long rows in, six tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidymeter.operators import cleaning as C, wide as W
from tidymeter.operators.ranks import size_guard
from tidymeter.session import materialize


def clean_rows(raw: DataFrame, legacy: bool = False) -> DataFrame:
    """Filtered, standardised, converted and plausible rows, before any aggregation."""
    kept = C.drop_garbage(C.drop_categories(C.drop_artifacts(raw)))
    named = C.require_name(C.standardize(kept, legacy))
    return C.apply_bounds(C.require_value(C.to_canonical(named)))


def clean(
    raw: DataFrame, min_coverage: float = 0.005, ordinal: str = "ordinal", legacy: bool = False
) -> dict[str, DataFrame]:
    """cleaned, summary, ml, sparse, rare and report tables.

    ``cleaned`` has one row per (entity, property). Summaries and wide tables
    aggregate the replicates themselves; ``legacy=True`` aggregates the already
    collapsed rows, so that every count is 1. ``sparse`` is a long summary at any
    size, since rare names can outnumber the columns of a table. The plausible rows are written to
    the shared scratch folder once, because six outputs read them.
    """
    rows = materialize(clean_rows(raw, legacy), "clean-rows")
    guard = size_guard(rows, ["CID"])
    cleaned = C.dedup_measurements(rows, ordinal, hot_rows=guard)
    base = materialize(cleaned, "cleaned") if legacy else rows
    frequent, sparse = frequent_and_sparse(base, min_coverage)
    return {
        "rows": rows,
        "cleaned": cleaned,
        "summary": C.summarize(base, hot_rows=guard),
        "ml": W.pivot_ml(frequent, hot_rows=guard),
        "sparse": C.summarize(sparse, hot_rows=guard),
        "rare": C.rare_properties(base, min_coverage),
        "report": C.cleaning_report(raw, base, min_coverage),
    }


def frequent_and_sparse(df: DataFrame, min_coverage: float) -> tuple[DataFrame, DataFrame]:
    """Rows of the frequent and of the sparse properties; every row is in one of the two."""
    split = C.split_by_coverage(df, min_coverage).select("StandardPropertyName", "frequent")
    tagged = df.join(split, "StandardPropertyName", "left")
    return (
        tagged.where(F.col("frequent")).drop("frequent"),
        tagged.where(~F.coalesce("frequent", F.lit(False))).drop("frequent"),
    )
