"""Cleaning of long measurement tables: row filters, standardisation, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidymeter import dictionaries as D
from tidymeter.functions import text as X, units as U
from tidymeter.operators import ranks
from tidymeter.session import materialize

CONTENT_COLUMNS = [
    "PropertyName", "PropertyValue", "Reference", "Method", "Comment", "Condition",
    "ReactionEquation", "SourceURL",
]


# --- row filters ------------------------------------------------------------------------


def drop_artifacts(df: DataFrame) -> DataFrame:
    """Drop header words, rows whose name equals their value, and nearly empty rows."""
    name, value = X.strip("PropertyName"), X.strip("PropertyValue")
    filled = reduce(
        lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in CONTENT_COLUMNS]
    )
    artifact = F.coalesce(name.isin(D.ARTIFACT_NAMES), F.lit(False))
    return df.where(~(artifact | name.eqNullSafe(value) | (filled <= 1)))


def drop_categories(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Drop categories that carry no numbers."""
    hit = X.strip("PropertyName").isin(names or D.NON_QUANTITATIVE)
    return df.where(~F.coalesce(hit, F.lit(False)))


def drop_garbage(df: DataFrame) -> DataFrame:
    """Drop prose, links and database references; a null value is kept."""
    value = F.col("PropertyValue")
    prose = "(?i)" + "|".join(D.GARBAGE_PATTERNS)
    hit = value.rlike(prose) | value.rlike("(?i)" + D.URL_PATTERN) | value.rlike(D.DB_REFERENCE_PATTERN)
    return df.where(~F.coalesce(hit, F.lit(False)))


def require_name(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["StandardPropertyName"])


def require_value(df: DataFrame) -> DataFrame:
    """Keep rows with a standard name and a convertible value."""
    return df.dropna(subset=["StandardPropertyName", "NumericValue"])


def apply_bounds(
    df: DataFrame,
    bounds: dict[str, tuple[float, float]] | None = None,
    prop: str = "StandardPropertyName",
    value: str = "NumericValue",
) -> DataFrame:
    """Drop values outside the inclusive range of their property.

    Properties without a range and null values are kept.
    """
    table = {k: (float(v[0]), float(v[1])) for k, v in (bounds or D.PLAUSIBLE_RANGES).items()}
    ranges = X.dictionary(df.sparkSession, table, f"`{prop}`, _low, _high")
    outside = (F.col(value) < F.col("_low")) | (F.col(value) > F.col("_high"))
    joined = df.join(ranges, prop, "left")
    return joined.where(~F.coalesce(outside, F.lit(False))).select(*df.columns)


def drop_censored(df: DataFrame, entity: str = "CID", relation: str = "Relation") -> DataFrame:
    """Drop censored measurements and rows without an id."""
    censored = F.coalesce(X.strip(F.col(relation)).isin(D.CENSORED_RELATIONS), F.lit(False))
    return df.where(X.strip_to_null(F.col(entity).cast("string")).isNotNull() & ~censored)


def drop_mixtures(df: DataFrame, col: str = "SMILES") -> DataFrame:
    """Drop salts and mixtures, whose structure text has a '.'; null counts as unknown and goes."""
    return df.where(~F.contains(F.col(col), F.lit(".")))


# --- standardisation --------------------------------------------------------------------


def normalize_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Trim the text columns; an empty text becomes null and null stays null."""
    chosen = columns or CONTENT_COLUMNS
    return df.withColumns({c: X.strip_to_null(c) for c in chosen})


def standardize_units(df: DataFrame, legacy: bool = False) -> DataFrame:
    return df.withColumn("CleanUnit", U.standard_unit("PropertyUnit", "PropertyValue", legacy))


def standardize(
    df: DataFrame, legacy: bool = False, synonyms: dict[str, str] | None = None
) -> DataFrame:
    """Trimmed texts, standard property name, numeric value and cleaned unit."""
    names = X.dictionary(df.sparkSession, synonyms or D.PROPERTY_SYNONYMS, "_key, _name")
    trimmed = normalize_text(df).withColumn("NumericValue", X.extract_numeric("PropertyValue"))
    named = (
        trimmed.join(names, F.lower("PropertyName") == F.col("_key"), "left")
        .withColumn("StandardPropertyName", F.coalesce("_name", "PropertyName"))
        .drop("_key", "_name")
    )
    return standardize_units(named, legacy)


def to_canonical(df: DataFrame, units=None, conversions=None) -> DataFrame:
    """Convert NumericValue to the canonical unit, named in CanonicalUnit.

    Unmanaged properties and rows without a unit pass through; a unit that
    cannot be converted yields null. Both dictionaries are fixed and broadcast.
    """
    spark = df.sparkSession
    canon = X.dictionary(spark, units or D.CANONICAL_UNITS, "_prop, CanonicalUnit")
    rules = X.dictionary(spark, conversions or D.UNIT_CONVERSIONS, "_from, _to, _divisor, _shift")
    unit = X.strip_to_null("CleanUnit")
    joined = (
        df.join(canon, F.col("StandardPropertyName") == F.col("_prop"), "left")
        .join(rules, (unit == F.col("_from")) & (F.col("CanonicalUnit") == F.col("_to")), "left")
    )
    unchanged = F.col("CanonicalUnit").isNull() | unit.isNull()
    value = F.when(unchanged, F.col("NumericValue")).otherwise(
        F.col("NumericValue") / F.col("_divisor") + F.col("_shift")
    )
    return joined.withColumn("NumericValue", value).select(*df.columns, "CanonicalUnit")


# --- aggregates -------------------------------------------------------------------------


def source_priority(c: str | Column, priority: dict[str, int] | None = None) -> Column:
    table = priority or D.SOURCE_PRIORITY
    return F.coalesce(X.lookup(table, X.as_col(c)), F.lit(D.OTHER_SOURCE_PRIORITY))


def dedup_measurements(
    df: DataFrame,
    ordinal: str = "ordinal",
    priority: dict[str, int] | None = None,
    entity: str = "CID",
    prop: str = "StandardPropertyName",
    hot_rows: int | None = ranks.HOT_ROWS,
) -> DataFrame:
    """One row per (entity, property): referenced first, then best source, then first.

    Its value is the median of the group. Median and representative come from
    the same aggregation, so the table is shuffled once.
    """
    others = [c for c in df.columns if c not in (entity, prop, "NumericValue")]
    order = F.struct(
        F.col("Reference").isNull(), source_priority("Source", priority), F.col(ordinal)
    )
    row = F.min_by(F.struct(*others), order)
    grouped = ranks.order_stats(
        df, [entity, prop], "NumericValue", {"_median": ranks.median_rank}, {"_row": row}, hot_rows
    )
    flat = grouped.select(entity, prop, F.col("_median").alias("NumericValue"), "_row.*")
    return flat.select(*df.columns)


def summarize(
    df: DataFrame,
    entity: str = "CID",
    prop: str = "StandardPropertyName",
    value: str = "NumericValue",
    hot_rows: int | None = ranks.HOT_ROWS,
) -> DataFrame:
    """Count, median, mean, std, min, max and interpolated IQR per (entity, property)."""
    stats = ranks.order_stats(
        df,
        [entity, prop],
        value,
        {
            "median": ranks.median_rank,
            "_q1": ranks.quantile_rank(0.25),
            "_q3": ranks.quantile_rank(0.75),
        },
        {
            "mean": F.avg(value),
            "std": F.stddev_samp(value),
            "min": F.min(value),
            "max": F.max(value),
        },
        hot_rows,
    )
    return stats.select(
        entity, prop, F.col("n").alias("count"), "median", "mean", "std", "min", "max",
        (F.col("_q3") - F.col("_q1")).alias("iqr"),
    )


def property_coverage(
    df: DataFrame, entity: str = "CID", prop: str = "StandardPropertyName"
) -> DataFrame:
    """Distinct entities per property and their share of all entities."""
    total = df.agg(F.countDistinct(entity)).scalar()
    return (
        df.where(F.col(prop).isNotNull())
        .groupBy(prop)
        .agg(F.countDistinct(entity).alias("entities"))
        .withColumn("fraction", F.try_divide(F.col("entities"), total))
    )


def split_by_coverage(
    df: DataFrame,
    min_fraction: float = 0.005,
    entity: str = "CID",
    prop: str = "StandardPropertyName",
) -> DataFrame:
    """Each property with its coverage and whether it is frequent (else sparse)."""
    cover = property_coverage(df, entity, prop)
    return cover.withColumn("frequent", F.col("fraction") >= min_fraction)


def rare_properties(
    df: DataFrame,
    max_fraction: float = 0.005,
    entity: str = "CID",
    prop: str = "StandardPropertyName",
) -> DataFrame:
    """Properties below the coverage threshold, rarest first."""
    cover = property_coverage(df, entity, prop)
    return (
        cover.where(F.col("fraction") < max_fraction)
        .select(
            prop,
            F.col("entities").alias("CompoundCount"),
            F.col("fraction").alias("FractionOfCompounds"),
        )
        .orderBy("FractionOfCompounds", prop)
    )


def cleaning_report(
    raw: DataFrame,
    clean: DataFrame,
    max_rare_fraction: float = 0.005,
    entity: str = "CID",
    raw_prop: str = "PropertyName",
    prop: str = "StandardPropertyName",
    top: int = 50,
    rare_sample: int = 20,
) -> DataFrame:
    """Before/after funnel as a tidy (section, metric, value) table.

    ``clean`` is read once: its rows are counted per entity and property, and all
    figures come from that table.
    """
    before = raw.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(raw_prop).alias("properties")
    )
    counted = materialize(clean.groupBy(entity, prop).agg(F.count(F.lit(1)).alias("_n")), "report-counts")
    after = counted.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.countDistinct(entity).alias("entities"),
        F.countDistinct(prop).alias("properties"),
    )

    def rows_of(df: DataFrame, items: dict[str, Column]) -> DataFrame:
        structs = [
            F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value"))
            for k, v in items.items()
        ]
        return df.select(F.inline(F.array(*structs)))

    funnel = (
        rows_of(
            before,
            {
                "original_rows": F.col("rows"),
                "rows_removed": F.col("rows"),
                "properties_before": F.col("properties"),
            },
        )
        .unionByName(
            rows_of(
                after,
                {
                    "rows_retained": F.col("rows"),
                    "rows_removed": -F.col("rows"),
                    "unique_entities": F.col("entities"),
                    "properties_after": F.col("properties"),
                },
            )
        )
        .groupBy("metric")
        .agg(F.sum("value").alias("value"))
        .select(F.lit("funnel").alias("section"), "metric", "value")
    )
    frequent = (
        counted.where(F.col(prop).isNotNull())
        .groupBy(F.col(prop).alias("metric"))
        .agg(F.sum("_n").cast("double").alias("value"))
        .orderBy(F.desc("value"), "metric")
        .limit(top)
        .select(F.lit("top_properties").alias("section"), "metric", "value")
    )
    rare = materialize(rare_properties(counted, max_rare_fraction, entity, prop), "report-rare")
    rare_count = rows_of(rare.agg(F.count(F.lit(1)).alias("n")), {"rare_properties": F.col("n")})
    sample = rare.orderBy("FractionOfCompounds", prop).limit(rare_sample).select(
        F.lit("rare_sample").alias("section"),
        F.col(prop).alias("metric"),
        F.col("CompoundCount").cast("double").alias("value"),
    )
    return (
        funnel.unionByName(frequent)
        .unionByName(rare_count.select(F.lit("funnel").alias("section"), "metric", "value"))
        .unionByName(sample)
    )
