"""Queries of the diagnostics and report aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidymeter.catalog import inputs  # noqa: F401
from tidymeter.catalog.base import VIEWS, duck, register, table, view
from tidymeter.catalog.measurements import _family_sql
from tidymeter.operators import reports as R

_WIDE_COLUMNS = [
    "CID", "InChIKey", "PubChemName", "MW", "LogP", "Rare", "Note", "ChEMBL:MIC [Bacillus]",
    "ChEMBL:MIC [Proteus]", "ChEMBL:IC50 [Giardia]", "ChEMBL:Ki [HeLa]", "ChEMBL:Potency [x]",
]
_FEATURES = ["MW", "LogP", "Rare", "Note"]
_TARGETS = [c for c in _WIDE_COLUMNS if c.startswith("ChEMBL:")]


def _is_number(c: str) -> str:
    return f'(TRY_CAST(CAST("{c}" AS VARCHAR) AS DOUBLE) IS NOT NULL)'


_COVERAGE = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {_is_number(c)}) AS filled, count(*) AS "rows",
    avg({_is_number(c)}::INT) AS coverage FROM {duck('wide')}"""
    for c in _WIDE_COLUMNS
)
_COVERAGE = f'SELECT "column", {_family_sql(chr(34) + "column" + chr(34))} AS category, filled, "rows", coverage FROM ({_COVERAGE})'

# Model report: each brand plays one target.
VIEWS["model_report"] = """
SELECT p_brand || ' ' || p_type AS target, count(*) AS n_samples, avg(p_size) / 50 AS cv_r2_mean,
  max(p_size) / 50.0E0 AS train_r2 FROM {part} GROUP BY p_brand, p_type
"""
# Selection results: return flag as block, line status plus line number as method.
VIEWS["selection_results"] = """
SELECT CASE l_linestatus WHEN 'F' THEN 'with_block' ELSE 'without_block' END AS block,
  'm' || CAST(l_linenumber AS STRING) AS method, avg(l_discount) * 10 AS cv_r2_random, avg(l_tax) * 10 AS cv_r2_grouped
FROM {lineitem} GROUP BY l_linestatus, l_linenumber
"""
VIEWS["relevance_scores"] = """
SELECT CASE l_linestatus WHEN 'F' THEN 'with_block' ELSE 'without_block' END AS block,
  'm' || CAST(l_linenumber % 3 AS STRING) AS method, 'f' || CAST(l_suppkey AS STRING) AS feature,
  max(CASE WHEN (l_suppkey + l_linenumber) % 5 <> 0 THEN l_extendedprice END) AS score FROM {lineitem} GROUP BY ALL
"""
VIEWS["relevance_scores"] = VIEWS["relevance_scores"].replace(
    "GROUP BY ALL", "GROUP BY l_linestatus, l_linenumber % 3, l_suppkey"
)
VIEWS["importances"] = """
SELECT o_orderpriority AS target, 'f' || CAST(o_custkey AS STRING) AS feature, sum(o_totalprice) AS importance
FROM {orders} GROUP BY o_orderpriority, o_custkey
"""
VIEWS["runs"] = """
SELECT l_returnflag AS stage, l_linenumber AS threads, sum(l_quantity) / l_linenumber AS seconds
FROM {lineitem} GROUP BY l_returnflag, l_linenumber
"""
VIEWS["configs"] = """
SELECT o_custkey AS stage, o_orderkey AS config, o_orderstatus = 'F' AS success,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS total_seconds,
  CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 2 END AS partial_seconds FROM {orders}
"""
VIEWS["jobs"] = """
SELECT event_id, CASE event_type WHEN 'click' THEN 'Completed' WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'aborted'
  WHEN 'signup' THEN NULL ELSE 'submitted' END AS status, ts AS updated, user_id, value FROM {events}
"""


@register("r01_column_coverage", _COVERAGE, "coverage")
def r01(spark, sf):
    return R.column_coverage(view(spark, sf, "wide"))


@register(
    "r01_category_summary",
    f"""WITH c AS ({_COVERAGE}), u AS (SELECT *, coverage >= CASE WHEN starts_with(category, 'target') THEN 0.05 ELSE 0.1 END AS ok FROM c)
    SELECT category, count(*) AS columns, min(coverage) AS min_coverage, max(coverage) AS max_coverage,
      list_sort(list(coverage))[count(*) // 2 + 1] AS upper_median, count(*) FILTER (WHERE ok) AS usable,
      coalesce(string_agg("column", ';' ORDER BY coverage DESC, "column") FILTER (WHERE ok), '') AS usable_columns
    FROM u WHERE category <> 'identity' GROUP BY category""",
    "min_coverage,max_coverage,upper_median",
)
def r01_summary(spark, sf):
    return R.category_summary(R.column_coverage(view(spark, sf, "wide")))


_SHARE = "(" + " + ".join(f"{_is_number(c)}::INT" for c in _FEATURES) + ") / 4.0"


@register(
    "r02_row_completeness",
    f"""SELECT count(*) AS "rows", avg(s) AS mean_completeness, count(*) FILTER (WHERE s < 0.3) AS sparse_rows,
      avg((s < 0.3)::INT) AS sparse_share FROM (SELECT {_SHARE} AS s FROM {duck('wide')})""",
    "mean_completeness,sparse_share",
)
def r02(spark, sf):
    return R.row_completeness(view(spark, sf, "wide"))


_COUNT = " + ".join(f"{_is_number(c)}::INT" for c in _TARGETS)


@register(
    "r03_target_multiplicity",
    f"""SELECT threshold, count(*) FILTER (WHERE n >= threshold) AS "rows", avg((n >= threshold)::INT) AS share
    FROM (SELECT {_COUNT} AS n FROM {duck('wide')}), (VALUES (1), (2), (5), (10), (20)) AS k(threshold) GROUP BY threshold""",
    "share",
    "threshold",
)
def r03(spark, sf):
    return R.target_multiplicity(view(spark, sf, "wide"))


@register(
    "r04_recommend_targets",
    f"""SELECT "column", filled, coverage FROM ({_COVERAGE}) WHERE category = 'target_antimicrobial' AND coverage >= 0.02""",
    "coverage",
)
def r04(spark, sf):
    return R.recommend_targets(R.column_coverage(view(spark, sf, "wide")), min_coverage=0.02)


@register("r05_value_counts", 'SELECT p_size, count(*) AS "count" FROM part GROUP BY p_size', ints="p_size")
def r05(spark, sf):
    return R.value_counts(table(spark, sf, "part"), "p_size")


@register(
    "r06_histogram",
    """WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
    c AS (SELECT least(floor((l_extendedprice - lo) * 24 / (hi - lo)), 23)::BIGINT AS bin, count(*) AS n FROM lineitem, e GROUP BY 1)
    SELECT b AS bin, lo + b * (hi - lo) / 24 AS low, lo + (b + 1) * (hi - lo) / 24 AS high, coalesce(n, 0) AS "count"
    FROM e, range(24) AS t(b) LEFT JOIN c ON c.bin = b""",
    "low,high",
    digits=4,
)
def r06(spark, sf):
    return R.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 24)


@register(
    "r06_column_median",
    "SELECT count(l_extendedprice) AS n, median(l_extendedprice) AS median FROM lineitem",
    "median",
)
def r06_median(spark, sf):
    return R.column_median(table(spark, sf, "lineitem"), "l_extendedprice")


@register(
    "r07_scatter",
    """SELECT o_orderkey::DOUBLE AS x, o_totalprice AS y, TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS color FROM orders""",
    "x,y,color",
)
def r07(spark, sf):
    rows = table(spark, sf, "orders").withColumn("level", F.substring("o_orderpriority", 1, 1))
    return R.scatter(rows, "o_orderkey", "o_totalprice", "level")


@register(
    "r08_top_coverage",
    """SELECT event_type, count(DISTINCT user_id) AS entities FROM events GROUP BY event_type ORDER BY 2 DESC, 1 LIMIT 15""",
)
def r08(spark, sf):
    return R.top_coverage(table(spark, sf, "events"), "user_id", "event_type")


@register(
    "r09_availability",
    """SELECT count(*) AS total, count(*) FILTER (WHERE lower(CAST(l_linestatus = 'F' AS VARCHAR)) = 'true') AS found,
    count(*) FILTER (WHERE l_tax > 0) AS with_hits FROM lineitem""",
)
def r09(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_linestatus") == "F").alias("found"), "l_tax")
    return R.availability(rows, "found", "l_tax")


@register(
    "r10_box_stats",
    """WITH top AS (SELECT l_suppkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, l_suppkey LIMIT 6),
    s AS (SELECT l_suppkey, count(*) AS n, quantile_cont(l_extendedprice, 0.25) AS q1, median(l_extendedprice) AS median,
      quantile_cont(l_extendedprice, 0.75) AS q3, min(l_extendedprice) AS min, max(l_extendedprice) AS max
      FROM lineitem SEMI JOIN top USING (l_suppkey) GROUP BY 1)
    SELECT s.*, min(l_extendedprice) FILTER (WHERE ok) AS whisker_low, max(l_extendedprice) FILTER (WHERE ok) AS whisker_high,
      count(*) FILTER (WHERE NOT ok) AS outliers FROM s JOIN (SELECT l.l_suppkey, l_extendedprice,
        l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok FROM lineitem l JOIN s USING (l_suppkey)) d
      USING (l_suppkey) GROUP BY ALL""",
    "q1,median,q3,min,max,whisker_low,whisker_high",
    digits=4,
)
def r10(spark, sf):
    return R.box_stats(table(spark, sf, "lineitem"), "l_suppkey", "l_extendedprice")


@register(
    "r11_leaderboard",
    f"""SELECT *, CASE WHEN cv_r2_mean >= 0.5 THEN 'good' WHEN cv_r2_mean >= 0.2 THEN 'fair' ELSE 'poor' END AS band,
      train_r2 - cv_r2_mean AS gap FROM {duck('model_report')} ORDER BY cv_r2_mean DESC, target LIMIT 20""",
    "cv_r2_mean,train_r2,gap",
)
def r11(spark, sf):
    return R.leaderboard(view(spark, sf, "model_report"))


_METHODS = [f"m{i}" for i in range(1, 8)]


@register(
    "r12_leakage_grid",
    "SELECT block, "
    + ", ".join(f"max(cv_r2_random - cv_r2_grouped) FILTER (WHERE method = '{m}') AS {m}" for m in _METHODS)
    + f" FROM {duck('selection_results')} GROUP BY block",
    ",".join(_METHODS),
)
def r12(spark, sf):
    return R.leakage_grid(view(spark, sf, "selection_results"), _METHODS)


@register(
    "r13_relevance_matrix",
    f"""WITH r AS (SELECT * FROM {duck('relevance_scores')} WHERE block = 'with_block'),
    b AS (SELECT feature, max(score) AS best FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15)
    SELECT feature, best, """
    + ", ".join(f"coalesce(max(score) FILTER (WHERE method = 'm{i}'), 0) AS m{i}" for i in range(3))
    + " FROM r JOIN b USING (feature) GROUP BY ALL",
    "best,m0,m1,m2",
)
def r13(spark, sf):
    return R.relevance_matrix(view(spark, sf, "relevance_scores"), ["m0", "m1", "m2"])


@register(
    "r14_top_importance",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY importance DESC, feature) AS "rank"
      FROM {duck('importances')}) WHERE "rank" <= 15""",
    "importance",
    digits=3,
)
def r14(spark, sf):
    return R.top_importance(view(spark, sf, "importances"), 15)


@register(
    "r15_scaling",
    f"""WITH r AS (SELECT * FROM {duck('runs')}), b AS (SELECT stage, min(threads) AS t0, arg_min(seconds, threads) AS s0,
      arg_min(threads, seconds) AS best FROM r GROUP BY 1)
    SELECT r.*, s0 / seconds AS speedup, threads / t0 AS ideal, threads = best AS optimal FROM r JOIN b USING (stage)""",
    "seconds,speedup,ideal",
    "threads",
)
def r15(spark, sf):
    return R.scaling(view(spark, sf, "runs"), "stage")


@register(
    "r16_best_config_run",
    f"""SELECT stage, config, success, total_seconds, partial_seconds FROM (SELECT *, row_number() OVER (PARTITION BY stage
      ORDER BY (success AND total_seconds IS NOT NULL) DESC, coalesce(total_seconds, partial_seconds, 'inf'::DOUBLE), config) AS rn
      FROM {duck('configs')}) WHERE rn = 1""",
    "total_seconds,partial_seconds",
)
def r16(spark, sf):
    return R.best_config_run(view(spark, sf, "configs"), "stage")


_STATUS = """CASE WHEN lower(coalesce(status, '')) IN ('completed', 'done', 'success', 'finished', 'ok') THEN 'done'
  WHEN lower(coalesce(status, '')) IN ('failed', 'error', 'aborted') THEN 'failed' ELSE 'running' END"""


@register(
    "r17_batch_status",
    f"""SELECT done, failed, running, 20000 - done - failed - running AS queued, done / span * 3600 AS per_hour,
      (20000 - done - failed) / (done / span) AS eta_seconds FROM (
      SELECT count(*) FILTER (WHERE s = 'done') AS done, count(*) FILTER (WHERE s = 'failed') AS failed,
        count(*) FILTER (WHERE s = 'running') AS running, (epoch_us(max(updated)) - epoch_us(min(updated))) / 1e6 AS span
      FROM (SELECT {_STATUS} AS s, updated FROM {duck('jobs')}))""",
    "per_hour,eta_seconds",
    digits=3,
)
def r17(spark, sf):
    return R.batch_status(view(spark, sf, "jobs"), total=20000)


@register(
    "r18_timing_summary",
    """SELECT count(*) AS entries, sum(value) AS total_seconds, count(DISTINCT user_id) AS entities,
    count(DISTINCT user_id) / sum(value) AS per_second FROM events""",
    "total_seconds,per_second",
    digits=5,
)
def r18(spark, sf):
    return R.timing_summary(table(spark, sf, "events"), "value", "user_id")


@register(
    "r19_batch_summary",
    f"""SELECT count(*) FILTER (WHERE {_STATUS} = 'done') AS succeeded, count(*) FILTER (WHERE {_STATUS} <> 'done') AS failed
    FROM {duck('jobs')}""",
)
def r19(spark, sf):
    done = R.job_state("status") == "done"
    return R.batch_summary(view(spark, sf, "jobs").select(done.alias("success")))


@register(
    "r19_batch_table",
    """SELECT CAST(o_orderkey AS VARCHAR) AS cid, o_orderstatus = 'F' AS success, -o_totalprice AS energy_ha, 298.15 AS "temp_K",
      o_custkey / 10.0 AS zpe_kcal, NULL::DOUBLE AS th_kcal, NULL::DOUBLE AS "ts_cal_K",
      CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority END AS error_msg FROM orders""",
    "energy_ha,temp_K,zpe_kcal,th_kcal,ts_cal_K",
)
def r19_table(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("cid"), (F.col("o_orderstatus") == "F").alias("success"),
        (-F.col("o_totalprice")).alias("energy_ha"), F.lit(298.15).alias("temp_K"),
        (F.col("o_custkey") / 10).alias("zpe_kcal"), F.lit(None).cast("double").alias("th_kcal"),
        F.lit(None).cast("double").alias("ts_cal_K"),
        F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderpriority")).alias("error_msg"),
        "o_orderdate",
    )
    return R.batch_table(rows)


@register(
    "r20_completed_counts",
    """SELECT l_returnflag AS state, count(*) FILTER (WHERE l_linestatus = 'F') AS completed FROM lineitem GROUP BY 1""",
)
def r20(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("state"), (F.col("l_linestatus") == "F").alias("success")
    )
    return R.completed_counts(rows)


@register(
    "r21_preview",
    f"""SELECT CAST(ordinal AS VARCHAR) AS ordinal, CID, coalesce("PubChemName", '') AS "PubChemName",
      coalesce("PropertyValue", '') AS "PropertyValue" FROM {duck('measurements')} ORDER BY CAST(ordinal AS BIGINT) LIMIT 25""",
)
def r21(spark, sf):
    rows = view(spark, sf, "measurements").select("ordinal", "CID", "PubChemName", "PropertyValue")
    return R.preview(rows, 25)
