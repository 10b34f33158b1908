"""Queries of the two-level activity quality control and the recovery job."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidymeter.catalog import inputs  # noqa: F401
from tidymeter.catalog.base import duck, register, view
from tidymeter.catalog.measurements import _RAW_WIDE, raw_long
from tidymeter.operators import activity as A
from tidymeter.plans.rebuild import activity_columns, merged_wide, rebuild_wide
from tidymeter.session import materialize

THRESHOLD = 0.8


def _features_sql(legacy: bool = False) -> str:
    guard = "AND coalesce(pChemblValue, '') = ''" if legacy else ""
    return rf"""SELECT trim(CID) AS CID,
      Source || ':' || CASE WHEN lg IS NOT NULL THEN 'pActivity' ELSE ActivityType END
        || ' [' || regexp_replace(trim(coalesce(nullif(trim(TargetName), ''), nullif(trim(Target), ''), 'Unchecked')), '\s+', ' ', 'g')
        || ']' AS FeatureName, AssayID, value FROM (
      SELECT *, coalesce(lg, CASE WHEN raw > 0 {guard} THEN raw END) AS value FROM (
        SELECT * EXCLUDE (Value), TRY_CAST(nullif(pChemblValue, '') AS DOUBLE) AS lg, TRY_CAST(Value AS DOUBLE) AS raw
        FROM {duck('activities')} WHERE coalesce(Relation, '') NOT IN ('>', '<', '>=', '<=')))
      WHERE value IS NOT NULL"""


def _level(src: str, keys: str, threshold: float = THRESHOLD) -> str:
    return f"""SELECT *, CASE WHEN median <> 0 THEN iqr / abs(median) ELSE 0.0 END AS relative_iqr,
      CASE WHEN min > 0 THEN max / min END AS fold_range,
      n >= 3 AND CASE WHEN median <> 0 THEN iqr / abs(median) ELSE 0.0 END > {threshold} AS rejected FROM (
      SELECT {keys}, l AS vals, len(l) AS n, list_aggregate(l, 'median') AS median,
        CASE WHEN len(l) < 2 THEN 0.0 ELSE list_aggregate(l[(len(l) + 1) // 2 + 1:], 'median')
          - list_aggregate(l[:len(l) // 2], 'median') END AS iqr, l[1] AS min, l[len(l)] AS max
      FROM (SELECT {keys}, list_sort(list(value)) AS l FROM {src} GROUP BY ALL))"""


def _chain(legacy: bool = False, threshold: float = THRESHOLD) -> str:
    return f"""feat AS ({_features_sql(legacy)}),
      assay AS ({_level('feat', 'CID, FeatureName, AssayID', threshold)}),
      med AS (SELECT CID, FeatureName, median AS value FROM assay WHERE NOT rejected),
      target AS ({_level('med', 'CID, FeatureName', threshold)})"""


_STATS = "median,iqr,min,max,relative_iqr,fold_range"


def assays(spark, sf):
    rows = view(spark, sf, "activities")
    return A.assay_level(A.activity_features(rows), THRESHOLD, A.entity_guard(rows))


def targets(spark, sf):
    guard = A.entity_guard(view(spark, sf, "activities"))
    return A.target_level(A.assay_qc(assays(spark, sf))[0], THRESHOLD, guard)


@register("b01_activity_features", _features_sql(), "value")
def b01(spark, sf):
    return A.activity_features(view(spark, sf, "activities"))


@register("b01_activity_features_legacy", _features_sql(legacy=True), "value")
def b01_legacy(spark, sf):
    return A.activity_features(view(spark, sf, "activities"), legacy=True)


@register("b02_assay_level", f"WITH {_chain()} SELECT * EXCLUDE (vals) FROM assay", _STATS)
def b02(spark, sf):
    return assays(spark, sf).drop("values")


@register(
    "b03_assay_qc",
    f"""WITH {_chain()} SELECT CID, FeatureName, AssayID, CASE WHEN rejected THEN 'reject' ELSE 'pass' END AS outcome
    FROM assay""",
)
def b03(spark, sf):
    passing, rejected = A.assay_qc(assays(spark, sf))
    keys = ["CID", "FeatureName", "AssayID"]
    return passing.select(*keys, F.lit("pass").alias("outcome")).unionByName(
        rejected.select(*keys, F.lit("reject").alias("outcome"))
    )


@register("b04_target_level", f"WITH {_chain()} SELECT * EXCLUDE (vals) FROM target", _STATS)
def b04(spark, sf):
    return targets(spark, sf).drop("values")


_EIGHT = """SELECT CID, FeatureName, unnest(['Median','Count','IQR','RelativeIQR','Min','Max','FoldRange','AssayCount']) AS stat,
  unnest([median, n, iqr, relative_iqr, min, max, fold_range, n]) AS value FROM target WHERE NOT rejected"""


def unpivot(wide, ids):
    rest = [c for c in wide.columns if c not in ids]
    flat = wide.select(*ids, *[F.col(f"`{c}`").cast("double").alias(c) for c in rest])
    long = flat.unpivot(ids, [f"`{c}`" for c in rest], "column", "value").where("value is not null")
    return long.select(
        *ids, F.regexp_extract("column", "^(.*)_([A-Za-z]+)$", 1).alias("FeatureName"),
        F.regexp_extract("column", "^(.*)_([A-Za-z]+)$", 2).alias("stat"), "value",
    )


@register(
    "b05_activity_wide",
    f"WITH {_chain()} SELECT * FROM ({_EIGHT}) WHERE value IS NOT NULL",
    "value",
)
def b05(spark, sf):
    return unpivot(A.activity_wide(targets(spark, sf)), ["CID"])


@register("b05_open_wide", f"WITH {_chain()} SELECT * FROM ({_EIGHT}) WHERE value IS NOT NULL", "value")
def b05_open(spark, sf):
    rows = A.activity_open(targets(spark, sf)).select("CID", F.explode("values").alias("FeatureName", "v"))
    stats = F.array(*[F.struct(F.lit(s).alias("stat"), F.col(f"v.{s}").cast("double").alias("value")) for s in A.STATISTICS])
    return rows.select("CID", "FeatureName", F.inline(stats)).where("value IS NOT NULL")


@register(
    "b06_qc_review",
    f"""WITH {_chain()} SELECT QCLevel, CID, FeatureName, FeatureName || '_Median' AS WideColumn, AssayID,
      n AS "Count", median AS "Median", iqr AS "IQR", relative_iqr AS "RelativeIQR", min AS "Min", max AS "Max",
      fold_range AS "FoldRange", list_aggregate(list_transform(vals, lambda v: printf('%.3f', v)), 'string_agg', ';') AS "Values"
    FROM (SELECT 'ASSAY' AS QCLevel, * FROM assay WHERE rejected
      UNION ALL SELECT 'TARGET', CID, FeatureName, '' , * EXCLUDE (CID, FeatureName) FROM target WHERE rejected)""",
    "Median,IQR,RelativeIQR,Min,Max,FoldRange",
)
def b06(spark, sf):
    level = materialize(assays(spark, sf), "assays")
    review = A.qc_review(level, A.target_level(A.assay_qc(level)[0], THRESHOLD))
    shown = F.transform(
        F.split("Values", ";"), lambda v: F.format_string("%.3f", v.cast("double"))
    )
    return review.withColumn("Values", F.array_join(shown, ";"))


@register(
    "b06_qc_values",
    f"""WITH {_chain()} SELECT 'ASSAY' AS QCLevel, CID, FeatureName, AssayID, value, count(*) AS times
      FROM feat SEMI JOIN (SELECT * FROM assay WHERE rejected) USING (CID, FeatureName, AssayID) GROUP BY ALL
    UNION ALL SELECT 'TARGET', CID, FeatureName, AssayID, median, count(*)
      FROM (SELECT * FROM assay WHERE NOT rejected) SEMI JOIN (SELECT * FROM target WHERE rejected) USING (CID, FeatureName)
      GROUP BY ALL""",
    "value",
)
def b06_values(spark, sf):
    features = A.activity_features(view(spark, sf, "activities"))
    level = materialize(assays(spark, sf), "assays")
    return A.qc_values(features, level, A.target_level(A.assay_qc(level)[0], THRESHOLD))


@register(
    "j07_merge_activity",
    f"""WITH {_chain(threshold=2.0)} SELECT c.CID, c_name, FeatureName, stat, value
    FROM (SELECT CAST(c_custkey AS VARCHAR) AS CID, c_name FROM customer) c JOIN ({_EIGHT}) t USING (CID)
    WHERE value IS NOT NULL""",
    "value",
)
def j07(spark, sf):
    wide = view(spark, sf, "wide").select("CID", F.col("PubChemName").alias("c_name"))
    activity = activity_columns(view(spark, sf, "activities"))
    return unpivot(A.merge_activity(wide, activity), ["CID", "c_name"])


@register(
    "j07_merged_wide",
    f"""WITH {_RAW_WIDE}, {_chain(threshold=2.0)}
    SELECT i.CID, InChIKey, PubChemName, PubChem_URL, name, stat, value FROM ident i SEMI JOIN stats USING (CID)
    JOIN (SELECT CID, base AS name, unnest(['Median', 'Count', 'IQR']) AS stat, unnest([med, n::DOUBLE, iqr]) AS value FROM stats
      UNION ALL SELECT CID, FeatureName, stat, value FROM ({_EIGHT})) v USING (CID) WHERE value IS NOT NULL""",
    "value",
)
def j07_merged(spark, sf):
    ids = ["CID", "InChIKey", "PubChemName", "PubChem_URL"]
    wide = merged_wide(raw_long(spark, sf), view(spark, sf, "activities"))
    return unpivot(wide, ids).withColumnRenamed("FeatureName", "name")


@register(
    "w05_rebuild_wide",
    f"""WITH {_RAW_WIDE}, {_chain(legacy=True, threshold=2.0)}
    SELECT i.CID, InChIKey, PubChemName, PubChem_URL, FeatureName, value
    FROM ident i SEMI JOIN stats USING (CID)
    JOIN (SELECT CID, base AS FeatureName, med AS value FROM stats
      UNION ALL SELECT CID, FeatureName, median FROM target WHERE NOT rejected) v USING (CID)""",
    "value",
)
def w05(spark, sf):
    ids = ["CID", "InChIKey", "PubChemName", "PubChem_URL"]
    wide = rebuild_wide(raw_long(spark, sf), view(spark, sf, "activities"))
    rest = [f"`{c}`" for c in wide.columns if c not in ids]
    return wide.unpivot(ids, rest, "FeatureName", "value").where("value is not null")
