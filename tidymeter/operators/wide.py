"""Long to wide: pivots whose columns come from the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidymeter import dictionaries as D
from tidymeter.functions import text as X
from tidymeter.operators import ranks
from tidymeter.session import materialize


def column_names(df: DataFrame, name: str, order: str | None = None) -> list[str]:
    """Distinct values of a label column, as the column list of a pivot.

    Column names are metadata, but they come from data: more of them than
    ``spark.sql.pivotMaxValues`` is an error, never a silent cut.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    first = F.min(order) if order else F.min(name)
    rows = (
        df.where(F.col(name).isNotNull())
        .groupBy(name)
        .agg(first.alias("_first"))
        .orderBy("_first", name)
        .limit(limit + 1)
        .collect()
    )
    if len(rows) > limit:
        raise ValueError(f"more than {limit} columns; keep the long form or raise the limit")
    return [r[0] for r in rows]


def preferred_order(names: list[str], order: list[str] | None = None) -> list[str]:
    known = order if order is not None else D.WIDE_ORDER
    return [p for p in known if p in names] + [p for p in names if p not in known]


def spread(df: DataFrame, keys: list[str], label: str, names: list[str], stats: list[str]) -> DataFrame:
    """Pivot a table that has one row per (keys, label); columns are label_stat."""
    return df.groupBy(*keys).pivot(label, names).agg(*[F.first(s).alias(s) for s in stats])


def _select(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in names])


def open_rows(df: DataFrame, keys: list[str], label: str, stats: list[str], out: str = "values") -> DataFrame:
    """One row per ``keys`` with a map from label to its statistics, for label sets of any size.

    The form beside the pivots: nothing is counted, collected or refused, and a
    reader or a later write picks the columns it wants from the map.
    """
    entry = F.struct(F.col(label), F.struct(*stats))
    return df.where(F.col(label).isNotNull()).groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias(out))


def settled(df: DataFrame, names: list[str], stats: list[str], values: str = "values") -> DataFrame:
    """The columns ``name_stat`` of some labels out of ``open_rows``, in the order given."""
    picked = [F.col(values)[n][s].alias(f"{n}_{s}") for n in names for s in stats]
    return df.select(*[c for c in df.columns if c != values], *picked)


ML_STATS = ["Median", "Count", "IQR"]


def _ml_stats(df: DataFrame, entity: str, prop: str, value: str, hot_rows: int | None) -> DataFrame:
    """Median, Count and interpolated IQR per entity and property."""
    ranked = {"Median": ranks.median_rank, "_q1": ranks.quantile_rank(0.25), "_q3": ranks.quantile_rank(0.75)}
    stats = ranks.order_stats(df, [entity, prop], value, ranked, hot_rows=hot_rows)
    return stats.select(entity, prop, "Median", F.col("n").alias("Count"), (F.col("_q3") - F.col("_q1")).alias("IQR"))


def open_ml(
    df: DataFrame, entity: str = "CID", prop: str = "StandardPropertyName", value: str = "NumericValue",
    hot_rows: int | None = ranks.HOT_ROWS,
) -> DataFrame:
    """``pivot_ml`` as one map per entity: property -> Median, Count, IQR."""
    return open_rows(_ml_stats(df, entity, prop, value, hot_rows), [entity], prop, ML_STATS)


def pivot_ml(
    df: DataFrame,
    include: list[str] | None = None,
    entity: str = "CID",
    prop: str = "StandardPropertyName",
    value: str = "NumericValue",
    hot_rows: int | None = ranks.HOT_ROWS,
) -> DataFrame:
    """One row per entity; Median, Count and interpolated IQR per property.

    The per-property statistics are written once, since the column names and the
    pivot both read them.
    """
    work = df if include is None else df.where(F.col(prop).isin(include))
    stats = _ml_stats(work, entity, prop, value, hot_rows)
    stats = materialize(stats, "property-stats")
    names = preferred_order(column_names(stats, prop))
    if not names:
        return stats.select(entity).where(F.lit(False))
    wide = spread(stats, [entity], prop, names, ML_STATS)
    return _select(wide, [entity] + [f"{p}_{s}" for p in names for s in ML_STATS])


def iqr_of_halves(lower: Column, upper: Column) -> Column:
    """Median-of-halves IQR; 0 for fewer than two values."""
    return F.coalesce(upper - lower, F.lit(0.0))


def halves_stats(
    df: DataFrame,
    keys: list[str],
    value: str,
    hot_rows: int | None = ranks.HOT_ROWS,
    keep_values: str | None = None,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Per group: n, median, median-of-halves IQR, min and max."""
    extra = extra or {}
    stats = ranks.order_stats(
        df,
        keys,
        value,
        {
            "median": ranks.median_rank,
            "_lower": ranks.lower_half_rank,
            "_upper": ranks.upper_half_rank,
        },
        {"min": F.min(value), "max": F.max(value), **extra},
        hot_rows,
        keep_values,
    )
    kept = [*extra, keep_values] if keep_values else [*extra]
    return stats.select(
        *keys, "n", "median", iqr_of_halves(F.col("_lower"), F.col("_upper")).alias("iqr"),
        "min", "max", *kept,
    )


def raw_values(df: DataFrame) -> DataFrame:
    """Column base 'name (unit)' or 'name', and the number without its unit suffix."""
    unit = F.coalesce(F.col("PropertyUnit"), F.lit(""))
    base = F.when(
        unit != "", F.concat(F.col("PropertyName"), F.lit(" ("), unit, F.lit(")"))
    ).otherwise(F.col("PropertyName"))
    value = X.strip_unit_suffix("PropertyValue", unit)
    return df.withColumns({"column_base": base, "number": X.extract_numeric(value, coerce=True)})


def _identity(rows: DataFrame, ordinal: str) -> DataFrame:
    """First non-empty text of every identity field, also from rows without a number."""
    fields = [c for c in D.IDENTITY_COLUMNS if c != "CID"]
    return rows.groupBy("CID").agg(
        *[
            F.coalesce(
                F.min_by(c, F.when(F.col(c) != "", F.col(ordinal))), F.lit("")
            ).alias(c)
            for c in fields
        ]
    )


def _raw_stats(rows: DataFrame, ordinal: str, hot_rows: int | None) -> DataFrame:
    numeric = rows.where(F.col("number").isNotNull())
    return halves_stats(
        numeric, ["CID", "column_base"], "number", hot_rows, extra={"first": F.min(ordinal)}
    ).select(
        "CID", "column_base", F.col("median").alias("Median"), F.col("n").alias("Count"),
        F.col("iqr").alias("IQR"), "first",
    )


def open_raw(
    df: DataFrame, ordinal: str = "ordinal", hot_rows: int | None = ranks.HOT_ROWS
) -> DataFrame:
    """``pivot_raw`` with one map per entity: column base -> Median, Count, IQR."""
    rows = raw_values(df)
    values = open_rows(_raw_stats(rows, ordinal, hot_rows), ["CID"], "column_base", ML_STATS)
    return _identity(rows, ordinal).join(values, "CID").select(*D.IDENTITY_COLUMNS, "values")


def pivot_raw(
    df: DataFrame, ordinal: str = "ordinal", hot_rows: int | None = ranks.HOT_ROWS
) -> DataFrame:
    """Wide table straight from raw long rows.

    Identity fields take the first non-empty text of an entity, also from rows
    without a number; entities without any number are absent.
    """
    rows = raw_values(df)
    identity = _identity(rows, ordinal)
    stats = materialize(_raw_stats(rows, ordinal, hot_rows), "raw-stats")
    names = column_names(stats, "column_base", "first")
    if not names:
        return identity.where(F.lit(False))
    wide = spread(stats, ["CID"], "column_base", names, ML_STATS)
    joined = identity.join(wide, "CID", "inner")
    tail = [f"{p}_{s}" for p in names for s in ML_STATS]
    return _select(joined, D.IDENTITY_COLUMNS + tail)


def values_only(df: DataFrame, suffix: str = "_Median") -> DataFrame:
    """Identity columns plus the medians, renamed without their suffix."""
    ids = [
        F.col(c) if c in df.columns else F.lit("").alias(c) for c in D.IDENTITY_COLUMNS
    ]
    medians = [
        F.col(f"`{c}`").alias(c[: -len(suffix)]) for c in df.columns if c.endswith(suffix)
    ]
    return df.select(*ids, *medians)
