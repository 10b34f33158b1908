"""Queries of the row filters, scalar functions, cleaning aggregates and pivots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidymeter import dictionaries as D
from tidymeter.catalog import inputs  # noqa: F401
from tidymeter.catalog.base import duck, in_list, register, table, values, view
from tidymeter.functions import numeric as N, text as X, units as U
from tidymeter.operators import cleaning as C, wide as W
from tidymeter.operators.ranks import size_guard
from tidymeter.plans.clean import clean, clean_rows

SHOWN = ["ordinal", "CID", "PropertyName", "PropertyValue"]
_SHOWN = ", ".join(SHOWN)

# --- SQL building blocks ------------------------------------------------------------------

_CONTENT = " + ".join(f"({c} IS NOT NULL)::INT" for c in C.CONTENT_COLUMNS)
_SYN = values(D.PROPERTY_SYNONYMS, "syn(k, v)")
_SPELL = values(D.UNIT_SPELLINGS, "sp(k, v)")
_CANON = values(D.CANONICAL_UNITS, "canon(prop, cu)")
_CONV = values(D.UNIT_CONVERSIONS, "conv(u, cu, divisor, shift)")
_RANGE = values(D.PLAUSIBLE_RANGES, "lim(prop, lo, hi)")
_NUM = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"


def _not_artifact(src: str) -> str:
    return f"""SELECT * FROM {src} WHERE NOT (coalesce(trim(PropertyName) IN {in_list(D.ARTIFACT_NAMES)}, false)
      OR trim(PropertyName) IS NOT DISTINCT FROM trim(PropertyValue) OR ({_CONTENT}) <= 1)"""


def _not_category(src: str) -> str:
    return f"SELECT * FROM {src} WHERE NOT coalesce(trim(PropertyName) IN {in_list(D.NON_QUANTITATIVE)}, false)"


def _not_garbage(src: str) -> str:
    return rf"""SELECT * FROM {src} WHERE NOT coalesce(
      regexp_matches(PropertyValue, 'for more|please visit|doi:|\{{''externaltablename''', 'i')
      OR regexp_matches(PropertyValue, '^\s*(https?://|www\.)', 'i')
      OR regexp_matches(PropertyValue, '^\s*[A-Za-z]{{1,10}}:\S+\s*$'), false)"""


def _unit_sql(unit: str) -> str:
    """Cleaned unit; expects the spelling table joined as sp1 and sp2."""
    low = f"lower(replace(replace(trim({unit}), '*', '/'), ' ', ''))"
    return f"""CASE WHEN nullif(trim({unit}), '') IS NULL THEN NULL
      WHEN sp1.v IS NOT NULL THEN sp1.v
      WHEN {low} LIKE '%mol/k' THEN 'J/mol/K' WHEN {low} LIKE '%kj/mol' THEN 'kJ/mol'
      WHEN {low} LIKE '%/mol' THEN {low} ELSE coalesce(sp2.v, trim({unit})) END"""


def _spell_join(unit: str) -> str:
    low = f"lower(replace(replace(trim({unit}), '*', '/'), ' ', ''))"
    spell1 = values(D.UNIT_SPELLINGS, "sp1(k, v)")
    spell2 = values(D.UNIT_SPELLINGS, "sp2(k, v)")
    degree = f"replace(replace({low}, 'degreec', 'c'), 'degc', 'c')"
    return f"LEFT JOIN {spell1} ON sp1.k = {low} LEFT JOIN {spell2} ON sp2.k = {degree}"


_INFER = """CASE WHEN contains({v}, 'cm^3/mol') THEN 'cm^3/mol' WHEN contains({v}, 'J/mol*K') THEN 'J/mol/K'
  WHEN contains({v}, 'J/mol/K') THEN 'J/mol/K' WHEN contains({v}, 'kJ/mol') THEN 'kJ/mol'
  WHEN contains({v}, 'g/mol') THEN 'g/mol' WHEN contains({v}, '°C') THEN 'C'
  WHEN contains({v}, 'eV') THEN 'eV' WHEN contains({v}, 'Da') THEN 'Da'
  WHEN contains({v}, 'Å²') THEN 'A2' WHEN contains({v}, 'A2') THEN 'A2'
  WHEN contains({v}, 'K') THEN 'K' END"""


def _standardized(src: str) -> str:
    value = "nullif(trim(PropertyValue), '')"
    name = "nullif(trim(PropertyName), '')"
    return f"""SELECT ordinal, CID, Source, {name} AS PropertyName, {value} AS PropertyValue,
      nullif(trim(Reference), '') AS Reference, nullif(trim(Condition), '') AS Condition,
      coalesce(syn.v, {name}) AS StandardPropertyName,
      TRY_CAST(nullif(regexp_extract(PropertyValue, '{_NUM}', 0), '') AS DOUBLE) AS NumericValue,
      coalesce({_unit_sql('PropertyUnit')}, {_INFER.format(v=value)}) AS CleanUnit
      FROM {src} LEFT JOIN {_SYN} ON syn.k = lower({name}) {_spell_join('PropertyUnit')}"""


def _canonical(src: str) -> str:
    unit = "nullif(trim(CleanUnit), '')"
    return f"""SELECT s.* EXCLUDE (NumericValue), canon.cu AS CanonicalUnit,
      CASE WHEN canon.cu IS NULL OR {unit} IS NULL THEN NumericValue
        ELSE NumericValue / conv.divisor + conv.shift END AS NumericValue
      FROM {src} s LEFT JOIN {_CANON} ON canon.prop = StandardPropertyName
      LEFT JOIN {_CONV} ON conv.u = {unit} AND conv.cu = canon.cu"""


def _bounded(src: str) -> str:
    return f"""SELECT b.* FROM {src} b LEFT JOIN {_RANGE} ON lim.prop = StandardPropertyName
      WHERE NOT coalesce(NumericValue < lo OR NumericValue > hi, false)"""


CLEAN = f"""
  f1 AS ({_not_artifact(duck('measurements'))}), f2 AS ({_not_category('f1')}),
  f3 AS ({_not_garbage('f2')}), st AS ({_standardized('f3')}),
  cv AS ({_canonical("(SELECT * FROM st WHERE StandardPropertyName IS NOT NULL)")}),
  rows_ AS ({_bounded("(SELECT * FROM cv WHERE NumericValue IS NOT NULL)")})"""

_SUMMARY = """SELECT CID, StandardPropertyName, count(NumericValue) AS "count", median(NumericValue) AS "median",
  avg(NumericValue) AS "mean", stddev_samp(NumericValue) AS "std", min(NumericValue) AS "min",
  max(NumericValue) AS "max",
  quantile_cont(NumericValue, 0.75) - quantile_cont(NumericValue, 0.25) AS iqr
  FROM {src} GROUP BY ALL"""
_SUMMARY_DOUBLES = "median,mean,std,min,max,iqr"


# --- F: row filters -----------------------------------------------------------------------


@register("f01_drop_artifacts", f"SELECT {_SHOWN} FROM ({_not_artifact(duck('measurements'))})")
def f01(spark, sf):
    return C.drop_artifacts(view(spark, sf, "measurements")).select(*SHOWN)


@register("f02_drop_categories", f"SELECT {_SHOWN} FROM ({_not_category(duck('measurements'))})")
def f02(spark, sf):
    return C.drop_categories(view(spark, sf, "measurements")).select(*SHOWN)


@register("f03_drop_garbage", f"SELECT {_SHOWN} FROM ({_not_garbage(duck('measurements'))})")
def f03(spark, sf):
    return C.drop_garbage(view(spark, sf, "measurements")).select(*SHOWN)


@register(
    "f04_require_value",
    f"""SELECT ordinal, StandardPropertyName, NumericValue FROM ({_standardized(duck('measurements'))})
    WHERE StandardPropertyName IS NOT NULL AND NumericValue IS NOT NULL""",
    "NumericValue",
)
def f04(spark, sf):
    rows = C.require_value(C.standardize(view(spark, sf, "measurements")))
    return rows.select("ordinal", "StandardPropertyName", "NumericValue")


@register(
    "f05_apply_bounds",
    f"SELECT ordinal, StandardPropertyName, NumericValue FROM ({_bounded(duck('standard'))})",
    "NumericValue",
)
def f05(spark, sf):
    rows = C.apply_bounds(view(spark, sf, "standard"))
    return rows.select("ordinal", "StandardPropertyName", "NumericValue")


@register(
    "f06_drop_censored",
    f"""SELECT CID, l_orderkey, l_linenumber, Relation FROM {duck('activities')}
    WHERE trim(CID) <> '' AND coalesce(trim(Relation), '') NOT IN ('>', '<', '>=', '<=')""",
    ints="l_linenumber",
)
def f06(spark, sf):
    rows = C.drop_censored(view(spark, sf, "activities"))
    return rows.select("CID", "l_orderkey", "l_linenumber", "Relation")


@register("f07_drop_mixtures", "SELECT doc_id, source FROM documents WHERE text NOT LIKE '%.%'")
def f07(spark, sf):
    return C.drop_mixtures(table(spark, sf, "documents"), "text").select("doc_id", "source")


# --- X: scalar functions ------------------------------------------------------------------


@register(
    "x01_extract_numeric",
    f"""SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '{_NUM}', 0), '') AS DOUBLE) AS strict,
    TRY_CAST(nullif(regexp_extract(CAST(n_chars AS VARCHAR), '{_NUM}', 0), '') AS DOUBLE) AS coerced
    FROM documents""",
    "strict,coerced",
)
def x01(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", X.extract_numeric("text").alias("strict"),
        X.extract_numeric("n_chars", coerce=True).alias("coerced"),
    )


@register(
    "x02_standardize_property",
    f"""SELECT ordinal, coalesce(syn.v, nullif(trim(PropertyName), '')) AS name
    FROM {duck('measurements')} LEFT JOIN {_SYN} ON syn.k = lower(trim(PropertyName))""",
)
def x02(spark, sf):
    return view(spark, sf, "measurements").select(
        "ordinal", X.standardize_property("PropertyName").alias("name")
    )


_ODD_UNIT = """CASE event_id % 12 WHEN 0 THEN '°C' WHEN 1 THEN 'degC' WHEN 2 THEN 'J/mol*K' WHEN 3 THEN 'J / mol K'
  WHEN 4 THEN 'kcal/mol' WHEN 5 THEN 'Å²' WHEN 6 THEN 'x kJ/mol' WHEN 7 THEN 'cal/mol/K'
  WHEN 8 THEN ' Pa ' WHEN 9 THEN '' WHEN 10 THEN NULL ELSE 'Degree C' END"""


@register(
    "x03_clean_unit",
    f"""SELECT event_id, {_unit_sql('unit')} AS unit_clean
    FROM (SELECT event_id, {_ODD_UNIT} AS unit FROM events) {_spell_join('unit')}""",
)
def x03(spark, sf):
    units = table(spark, sf, "events").select("event_id", F.expr(_ODD_UNIT).alias("unit"))
    return units.select("event_id", U.clean_unit("unit").alias("unit_clean"))


_ODD_VALUE = f"CAST(event_id AS STRING) || ' ' || coalesce({_ODD_UNIT}, 'K')"


@register(
    "x04_infer_unit",
    f"SELECT event_id, {_INFER.format(v='v')} AS unit FROM (SELECT event_id, {_ODD_VALUE} AS v FROM events)",
)
def x04(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.expr(_ODD_VALUE).alias("v"))
    return rows.select("event_id", U.infer_unit("v").alias("unit"))


@register(
    "x05_standardize_units",
    f"SELECT ordinal, CleanUnit FROM ({_standardized(duck('measurements'))})",
)
def x05(spark, sf):
    return C.standardize_units(view(spark, sf, "measurements")).select("ordinal", "CleanUnit")


@register(
    "x06_canonical_units",
    f"""SELECT ordinal, StandardPropertyName, CanonicalUnit, NumericValue
    FROM ({_canonical(duck('standard'))})""",
    "NumericValue",
)
def x06(spark, sf):
    return C.to_canonical(view(spark, sf, "standard")).select(
        "ordinal", "StandardPropertyName", "CanonicalUnit", "NumericValue"
    )


@register(
    "x07_normalize_text",
    "SELECT ordinal, "
    + ", ".join(f"nullif(trim({c}), '') AS {c}" for c in C.CONTENT_COLUMNS)
    + f" FROM {duck('measurements')}",
)
def x07(spark, sf):
    return C.normalize_text(view(spark, sf, "measurements")).select("ordinal", *C.CONTENT_COLUMNS)


@register(
    "x08_strip_unit_suffix",
    f"""SELECT ordinal, CASE WHEN coalesce(PropertyValue, '') <> '' AND coalesce(PropertyUnit, '') <> ''
      AND ends_with(PropertyValue, ' ' || PropertyUnit)
      THEN trim(left(PropertyValue, length(PropertyValue) - length(PropertyUnit) - 1))
      ELSE PropertyValue END AS value FROM {duck('measurements')}""",
)
def x08(spark, sf):
    return view(spark, sf, "measurements").select(
        "ordinal", X.strip_unit_suffix("PropertyValue", "PropertyUnit").alias("value")
    )


_MOLAR_UNIT = """CASE event_id % 13 WHEN 0 THEN 'nM' WHEN 1 THEN 'uM' WHEN 2 THEN 'µM' WHEN 3 THEN 'mM'
  WHEN 4 THEN ' M' WHEN 5 THEN 'pM' WHEN 6 THEN 'nmol/L' WHEN 7 THEN 'micromolar' WHEN 8 THEN 'xM'
  WHEN 9 THEN 'kg' WHEN 10 THEN NULL WHEN 11 THEN '' ELSE 'ngm' END"""


@register(
    "x09_molar_multiplier",
    f"""SELECT event_id, 1e12 * coalesce(mu.f, CASE WHEN u LIKE '%m' AND length(u) <= 3 THEN pre.f END) AS picomolar
    FROM (SELECT event_id, replace(replace(lower(trim({_MOLAR_UNIT})), 'µ', 'u'), 'μ', 'u') AS u FROM events)
    LEFT JOIN {values(D.MOLAR_UNITS, 'mu(k, f)')} ON mu.k = u
    LEFT JOIN {values(D.MOLAR_PREFIXES, 'pre(k, f)')} ON pre.k = left(u, 1)""",
    "picomolar",
)
def x09(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.expr(_MOLAR_UNIT).alias("u"))
    return rows.select("event_id", (U.molar_multiplier("u") * F.lit(1e12)).alias("picomolar"))


_PAIR = """CASE event_id % 5 WHEN 0 THEN CAST(event_id AS STRING) || ' kJ/mol'
  WHEN 1 THEN CAST(event_id AS STRING) || '.5 (K)' WHEN 2 THEN '-' || CAST(event_id AS STRING) || 'e3'
  WHEN 3 THEN 'about ' || CAST(event_id AS STRING) ELSE event_type || ' (' || props || ')' END"""


@register(
    "x10_split_value_unit",
    rf"""SELECT event_id,
    CASE WHEN regexp_matches(t, '^(.+?)\s*\(([^)]+)\)\s*$') THEN trim(regexp_extract(t, '^(.+?)\s*\(([^)]+)\)\s*$', 1))
      WHEN regexp_matches(t, '^([-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)(?:\s+(.+))?$')
      THEN trim(regexp_extract(t, '^([-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)(?:\s+(.+))?$', 1)) ELSE t END AS value,
    CASE WHEN regexp_matches(t, '^(.+?)\s*\(([^)]+)\)\s*$') THEN trim(regexp_extract(t, '^(.+?)\s*\(([^)]+)\)\s*$', 2))
      WHEN regexp_matches(t, '^([-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)(?:\s+(.+))?$')
      THEN trim(regexp_extract(t, '^([-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)(?:\s+(.+))?$', 2)) ELSE '' END AS unit
    FROM (SELECT event_id, trim({_PAIR}) AS t FROM events)""",
)
def x10(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.expr(_PAIR).alias("t"))
    return rows.select("event_id", X.split_value_unit("t").alias("p")).select("event_id", "p.*")


_HEADER = "CASE WHEN event_id % 3 = 0 THEN event_type ELSE event_type || ' (' || CAST(user_id AS STRING) || ') ' END"


@register(
    "x11_split_header_unit",
    rf"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type
      ELSE trim(regexp_extract(t, '^(.*?)\s*\(([^)]+)\)\s*$', 1)) END AS name,
      CASE WHEN event_id % 3 = 0 THEN '' ELSE regexp_extract(t, '^(.*?)\s*\(([^)]+)\)\s*$', 2) END AS unit
    FROM (SELECT event_id, event_type, trim({_HEADER}) AS t FROM events)""",
)
def x11(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.expr(_HEADER).alias("t"))
    return rows.select("event_id", X.split_header_unit("t").alias("p")).select("event_id", "p.*")


@register(
    "x12_collapse_ws",
    r"""SELECT doc_id, md5(trim(regexp_replace(text, '[\s\x0B\x1C-\x1F\x{0085}\p{Z}]+', ' ', 'g'))) AS digest
    FROM documents""",
)
def x12(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.collapse_ws("text")).alias("digest"))


@register(
    "x13_slugify",
    """SELECT page_id, replace(replace(replace(replace(replace(url, '/', '_'), ':', '_'), '[', ''), ']', ''), ' ', '_')
    AS slug FROM pages""",
)
def x13(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.slugify("url").alias("slug"))


@register(
    "x14_format_condition",
    """SELECT event_id, 'Temperature=' || CAST(user_id AS VARCHAR) ||
      CASE WHEN event_id % 4 = 0 THEN '' ELSE ' | Phase=' || event_type END AS condition FROM events""",
)
def x14(spark, sf):
    pairs = F.array(
        F.struct(F.lit("Temperature").alias("key"), F.col("user_id").cast("string").alias("value")),
        F.struct(F.lit("Pressure").alias("key"), F.lit("").alias("value")),
        F.struct(
            F.lit("Phase").alias("key"),
            F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("value"),
        ),
    )
    return table(spark, sf, "events").select("event_id", X.format_condition(pairs).alias("condition"))


@register(
    "x15_spread_ratios",
    """SELECT l_orderkey, min(l_extendedprice) AS lo,
      CASE WHEN min(l_discount) > 0 THEN max(l_discount) / min(l_discount) END AS fold,
      CASE WHEN min(l_tax) <> 0 THEN (max(l_tax) - min(l_tax)) / abs(min(l_tax)) ELSE 0.0 END AS ratio
    FROM lineitem GROUP BY l_orderkey""",
    "lo,fold,ratio",
)
def x15(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_extendedprice").alias("lo"), F.min("l_discount").alias("d0"),
        F.max("l_discount").alias("d1"), F.min("l_tax").alias("t0"), F.max("l_tax").alias("t1"),
    )
    return rows.select(
        "l_orderkey", "lo", N.fold_range("d0", "d1").alias("fold"),
        N.relative_iqr(F.col("t1") - F.col("t0"), "t0").alias("ratio"),
    )


@register(
    "x16_transforms",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN log10(value) ELSE value END AS forward,
    value AS back FROM events""",
    "forward,back",
)
def x16(spark, sf):
    kind = F.when(F.col("event_id") % 2 == 0, "log10").otherwise("identity")
    forward = N.apply_transform("value", kind)
    return table(spark, sf, "events").select(
        "event_id", forward.alias("forward"), N.inverse_transform(forward, kind).alias("back")
    )


@register(
    "x17_clipped_log10",
    "SELECT c_custkey, log10(greatest(c_acctbal, 1e-12)) AS y FROM customer",
    "y",
)
def x17(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", N.clipped_log10("c_acctbal").alias("y"))


_PICK = """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE '' END AS a,
  CASE WHEN doc_id % 3 = 1 THEN source WHEN doc_id % 3 = 2 THEN '' END AS b,
  CASE WHEN doc_id % 2 = 0 THEN CAST(n_chars AS STRING) END AS c FROM {documents}"""


@register(
    "x18_pick_structure",
    f"""SELECT doc_id, CASE WHEN coalesce(a, '') <> '' THEN a WHEN coalesce(b, '') <> '' THEN b
    WHEN coalesce(c, '') <> '' THEN c ELSE '' END AS structure FROM ({_PICK.format(documents='documents')})""",
)
def x18(spark, sf):
    rows = spark.sql(_PICK, documents=table(spark, sf, "documents"))
    return rows.select("doc_id", X.pick_structure("a", "b", "c").alias("structure"))


@register(
    "x19_convert_energy",
    """SELECT event_id, value * 27.211386245988 AS ev, value * 627.509474 AS kcal, value * 2625.5 AS kj
    FROM events""",
    "ev,kcal,kj",
)
def x19(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", U.energy_from_hartree("value", "eV").alias("ev"),
        U.energy_from_hartree("value", "kcal/mol").alias("kcal"),
        U.energy_from_hartree("value", "kJ/mol").alias("kj"),
    )


@register(
    "x20_gibbs_energy",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 4 THEN -l_quantity * 2625.5 + l_extendedprice / 1000 * 4.184
    - (270 + l_linenumber) * (l_discount * 1000 * (4.184 / 1000)) END AS g FROM lineitem""",
    "g",
    "l_linenumber",
)
def x20(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        N.gibbs_energy(
            -F.col("l_quantity"), F.col("l_extendedprice") / 1000, F.col("l_discount") * 1000,
            F.when(F.col("l_linenumber") != 4, F.lit(270) + F.col("l_linenumber")),
        ).alias("g"),
    )


@register(
    "x21_redox_potential",
    "SELECT c_custkey, -(c_acctbal - c_nationkey) / 96.5 AS e FROM customer",
    "e",
)
def x21(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey",
        N.redox_potential(
            F.lit(-3.5), F.lit(2.25), F.col("c_acctbal"), F.col("c_nationkey").cast("double")
        ).alias("e"),
    )


@register(
    "x22_marcus_energies",
    """SELECT *, CASE WHEN total > 0 THEN (total + t) * (total + t) / (4 * total) END AS barrier FROM (
      SELECT l_orderkey, l_linenumber, l_tax AS t,
        CASE WHEN q IS NOT NULL THEN (l_extendedprice - 1000 * q) / 1000 + (q - l_discount) END AS total,
        CASE WHEN q IS NOT NULL THEN (l_extendedprice - 1000 * q) / 1000 END AS lambda1,
        CASE WHEN q IS NOT NULL THEN q - l_discount END AS lambda2
      FROM (SELECT *, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS q FROM lineitem))""",
    "t,total,lambda1,lambda2,barrier",
    "l_linenumber",
)
def x22(spark, sf):
    q = F.when(F.col("l_linenumber") != 3, F.col("l_quantity"))
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_tax").alias("t"),
        N.reorganization(F.col("l_extendedprice") / 1000, q, q, "l_discount").alias("lam"),
    )
    return rows.select(
        "l_orderkey", "l_linenumber", "t", "lam.*", N.activation(F.col("lam.total"), "t").alias("barrier")
    )


_COLUMN_NAME = """CASE p_partkey % 8 WHEN 0 THEN 'CID' WHEN 1 THEN 'MW' WHEN 2 THEN p_name
  WHEN 3 THEN 'ChEMBL:MIC [' || p_brand || ']' WHEN 4 THEN 'ChEMBL:IC50 [Giardia ' || p_brand || ']'
  WHEN 5 THEN 'ChEMBL:Ki [HeLa]' WHEN 6 THEN 'ChEMBL:' ELSE 'ChEMBL:Other Kd ' || p_type END"""


def _family_sql(c: str) -> str:
    arms = "".join(
        " WHEN " + " OR ".join(f"contains({c}, '{w}')" for w in words) + f" THEN '{family}'"
        for family, words in D.TARGET_FAMILIES.items()
    )
    return f"""CASE WHEN {c} IN {in_list(D.IDENTITY_COLUMNS)} THEN 'identity'
      WHEN {c} IN {in_list(D.PROPERTY_FEATURES)} OR NOT starts_with({c}, 'ChEMBL:') THEN 'feature'
      {arms} ELSE 'target_other' END"""


@register(
    "x23_classify_column",
    f"SELECT p_partkey, {_family_sql('name')} AS family FROM (SELECT p_partkey, {_COLUMN_NAME} AS name FROM part)",
)
def x23(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.expr(_COLUMN_NAME).alias("name"))
    return rows.select("p_partkey", X.classify_column("name").alias("family"))


@register(
    "x24_is_target",
    f"""SELECT p_partkey, regexp_matches(name, 'ChEMBL:|IC50|EC50|Ki|Kd|Potency') AS loose,
    (starts_with(name, 'ChEMBL:') OR regexp_matches(name, 'IC50|EC50| Ki| Kd|Potency')) AND name <> 'ChEMBL:' AS strict
    FROM (SELECT p_partkey, {_COLUMN_NAME} AS name FROM part)""",
)
def x24(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.expr(_COLUMN_NAME).alias("name"))
    return rows.select(
        "p_partkey", X.is_target("name").alias("loose"), X.is_target("name", strict=True).alias("strict")
    )


# --- C: cleaning aggregates ---------------------------------------------------------------

_STD = ["ordinal", "PropertyName", "Reference", "Condition", "StandardPropertyName", "NumericValue", "CleanUnit"]


@register(
    "c01_standardize",
    f"SELECT {', '.join(_STD)} FROM ({_standardized(duck('measurements'))})",
    "NumericValue",
)
def c01(spark, sf):
    return C.standardize(view(spark, sf, "measurements")).select(*_STD)


_DEDUP = """SELECT CID, StandardPropertyName, ordinal, Source, Reference, med AS NumericValue FROM (
  SELECT *, median(NumericValue) OVER (PARTITION BY CID, StandardPropertyName) AS med,
    row_number() OVER (PARTITION BY CID, StandardPropertyName ORDER BY Reference IS NULL,
      CASE Source WHEN 'NIST' THEN 1 WHEN 'PubChem' THEN 2 ELSE 999 END, ordinal) AS rn
  FROM {src}) WHERE rn = 1"""
_DEDUP_COLUMNS = ["CID", "StandardPropertyName", "ordinal", "Source", "Reference", "NumericValue"]


@register("c02_dedup_measurements", _DEDUP.format(src=duck("standard")), "NumericValue")
def c02(spark, sf):
    return C.dedup_measurements(view(spark, sf, "standard").select(*_DEDUP_COLUMNS))


@register("c03_summarize", _SUMMARY.format(src=duck("standard")), _SUMMARY_DOUBLES)
def c03(spark, sf):
    return C.summarize(view(spark, sf, "standard"))


_COVER = """SELECT StandardPropertyName, count(DISTINCT CID) AS entities,
  count(DISTINCT CID) / (SELECT count(DISTINCT CID) FROM {src})::DOUBLE AS fraction
  FROM {src} WHERE StandardPropertyName IS NOT NULL GROUP BY ALL"""


@register(
    "c04_split_by_coverage",
    f"WITH {CLEAN} SELECT *, fraction >= 0.9 AS frequent FROM ({_COVER.format(src='rows_')})",
    "fraction",
)
def c04(spark, sf):
    return C.split_by_coverage(clean_rows(view(spark, sf, "measurements")), 0.9)


@register(
    "c05_rare_properties",
    f"""WITH {CLEAN} SELECT StandardPropertyName, entities AS CompoundCount, fraction AS FractionOfCompounds
    FROM ({_COVER.format(src='rows_')}) WHERE fraction < 0.95""",
    "FractionOfCompounds",
)
def c05(spark, sf):
    return C.rare_properties(clean_rows(view(spark, sf, "measurements")), 0.95)


@register(
    "c06_cleaning_report",
    f"""WITH {CLEAN}, raw AS (SELECT * FROM {duck('measurements')}),
    rare AS (SELECT * FROM ({_COVER.format(src='rows_')}) WHERE fraction < 0.95)
    SELECT 'funnel' AS section, 'original_rows' AS metric, (SELECT count(*) FROM raw)::DOUBLE AS value
    UNION ALL SELECT 'funnel', 'rows_retained', (SELECT count(*) FROM rows_)
    UNION ALL SELECT 'funnel', 'rows_removed', (SELECT count(*) FROM raw) - (SELECT count(*) FROM rows_)
    UNION ALL SELECT 'funnel', 'unique_entities', (SELECT count(DISTINCT CID) FROM rows_)
    UNION ALL SELECT 'funnel', 'properties_before', (SELECT count(DISTINCT PropertyName) FROM raw)
    UNION ALL SELECT 'funnel', 'properties_after', (SELECT count(DISTINCT StandardPropertyName) FROM rows_)
    UNION ALL SELECT 'funnel', 'rare_properties', (SELECT count(*) FROM rare)
    UNION ALL (SELECT 'top_properties', StandardPropertyName, count(*) FROM rows_ GROUP BY StandardPropertyName
      ORDER BY 3 DESC, 2 LIMIT 50)
    UNION ALL (SELECT 'rare_sample', StandardPropertyName, entities FROM rare ORDER BY fraction, 2 LIMIT 20)""",
    "value",
)
def c06(spark, sf):
    raw = view(spark, sf, "measurements")
    return C.cleaning_report(raw, clean_rows(raw), 0.95)


@register("c07_clean_summary", f"WITH {CLEAN} {_SUMMARY.format(src='rows_')}", _SUMMARY_DOUBLES)
def c07(spark, sf):
    return clean(view(spark, sf, "measurements"))["summary"]


@register(
    "c07_clean_legacy",
    f"WITH {CLEAN} SELECT CID, StandardPropertyName, NumericValue FROM ({_DEDUP.format(src='rows_')})",
    "NumericValue",
)
def c07_legacy(spark, sf):
    cleaned = clean(view(spark, sf, "measurements"), legacy=True)["cleaned"]
    return cleaned.select("CID", "StandardPropertyName", "NumericValue")


@register(
    "c07_clean_cleaned",
    f"WITH {CLEAN} SELECT CID, StandardPropertyName, NumericValue FROM ({_DEDUP.format(src='rows_')})",
    "NumericValue",
)
def c07_cleaned(spark, sf):
    return clean(view(spark, sf, "measurements"))["cleaned"].select("CID", "StandardPropertyName", "NumericValue")


@register(
    "c07_clean_sparse",
    f"""WITH {CLEAN}, often AS (SELECT StandardPropertyName FROM ({_COVER.format(src='rows_')}) WHERE fraction >= 0.95),
    few AS (SELECT * FROM rows_ WHERE StandardPropertyName NOT IN (SELECT StandardPropertyName FROM often))
    {_SUMMARY.format(src='few')}""",
    _SUMMARY_DOUBLES,
)
def c07_sparse(spark, sf):
    return clean(view(spark, sf, "measurements"), min_coverage=0.95)["sparse"]


@register(
    "c07_clean_rare",
    f"""WITH {CLEAN} SELECT StandardPropertyName, entities AS "CompoundCount", fraction AS "FractionOfCompounds"
    FROM ({_COVER.format(src='rows_')}) WHERE fraction < 0.95""",
    "FractionOfCompounds",
)
def c07_rare(spark, sf):
    return clean(view(spark, sf, "measurements"), min_coverage=0.95)["rare"]


# --- W: long to wide ----------------------------------------------------------------------


def _pivot_sql(names: list[str], src: str) -> str:
    cols = []
    for p in names:
        pick = f"FILTER (WHERE StandardPropertyName = '{p}')"
        cols.append(f"median(NumericValue) {pick} AS \"{p}_Median\"")
        cols.append(f"nullif(count(NumericValue) {pick}, 0) AS \"{p}_Count\"")
        cols.append(
            f"quantile_cont(NumericValue, 0.75) {pick} - quantile_cont(NumericValue, 0.25) {pick} AS \"{p}_IQR\""
        )
    return f"SELECT CID, {', '.join(cols)} FROM {src} GROUP BY CID"


_ML_NAMES = ["MW", "LogP", "Tb", "Hvap", "PA"]
_ML_DOUBLES = ",".join(f"{p}_{s}" for p in _ML_NAMES for s in ("Median", "IQR"))


@register("w01_pivot_ml", f"WITH {CLEAN} {_pivot_sql(_ML_NAMES, 'rows_')}", _ML_DOUBLES)
def w01(spark, sf):
    raw = view(spark, sf, "measurements")
    return W.pivot_ml(clean_rows(raw), hot_rows=size_guard(raw, ["CID"]))


def _listed(rows, keys):
    """A map column as rows."""
    return rows.select(*keys, F.explode("values").alias("name", "v")).select(*keys, "name", "v.*")


@register(
    "w01_open_ml",
    f"""WITH {CLEAN} SELECT CID, StandardPropertyName AS name, median(NumericValue) AS "Median", count(*) AS "Count",
      quantile_cont(NumericValue, 0.75) - quantile_cont(NumericValue, 0.25) AS "IQR" FROM rows_ GROUP BY ALL""",
    "Median,IQR",
)
def w01_open(spark, sf):
    raw = view(spark, sf, "measurements")
    return _listed(W.open_ml(clean_rows(raw), hot_rows=size_guard(raw, ["CID"])), ["CID"])


_RAW_WIDE = f"""
  src AS (SELECT *, PropertyName || CASE WHEN coalesce(PropertyUnit, '') <> '' THEN ' (' || PropertyUnit || ')' ELSE '' END AS base,
    TRY_CAST(nullif(regexp_extract(CASE WHEN coalesce(PropertyValue, '') <> '' AND coalesce(PropertyUnit, '') <> ''
      AND ends_with(PropertyValue, ' ' || PropertyUnit)
      THEN trim(left(PropertyValue, length(PropertyValue) - length(PropertyUnit) - 1)) ELSE PropertyValue END,
      '{_NUM}', 0), '') AS DOUBLE) AS x
    FROM (SELECT * REPLACE (trim(CASE WHEN ordinal % 40 = 2 THEN 'Other' ELSE PropertyName END) AS PropertyName)
      FROM {duck('measurements')})),
  ident AS (SELECT CID, coalesce(arg_min(nullif(InChIKey, ''), ordinal) FILTER (WHERE InChIKey <> ''), '') AS InChIKey,
    coalesce(arg_min(PubChemName, ordinal) FILTER (WHERE PubChemName <> ''), '') AS PubChemName,
    coalesce(arg_min(PubChem_URL, ordinal) FILTER (WHERE PubChem_URL <> ''), '') AS PubChem_URL FROM src GROUP BY CID),
  lists AS (SELECT CID, base, list_sort(list(x)) AS l FROM src WHERE x IS NOT NULL GROUP BY ALL),
  stats AS (SELECT CID, base, list_aggregate(l, 'median') AS med, len(l) AS n,
    CASE WHEN len(l) < 2 THEN 0.0 ELSE list_aggregate(l[(len(l) + 1) // 2 + 1:], 'median')
      - list_aggregate(l[:len(l) // 2], 'median') END AS iqr FROM lists)"""
# The raw column bases that the measurement view produces.
RAW_BASES = [
    "Boiling Point", "Boiling Point (°C)", "Boiling Point (K)", "Molecular Weight",
    "Molecular Weight (g/mol)", "Molecular Weight ( Da)", "Molecular Weight (g / mol)",
    "heat of vaporization", "heat of vaporization (kJ/mol)", "heat of vaporization (J/mol)",
    "heat of vaporization (kcal/mol)", "XLogP3", "Proton Affinity (kJ/mol)",
    "Proton Affinity (kJ/mol) (kJ / mol)", "Proton Affinity (kJ/mol) (eV)", "Units", "Odor", "Other",
    "Units (°C)", "Units (K)", "Units (g/mol)", "Units ( Da)", "Units (g / mol)", "Units (kJ/mol)",
    "Units (J/mol)", "Units (kcal/mol)", "Units (kJ / mol)", "Units (eV)",
    "Odor (°C)", "Odor (K)", "Odor (g/mol)", "Odor ( Da)", "Odor (g / mol)", "Odor (kJ/mol)",
    "Odor (J/mol)", "Odor (kcal/mol)", "Odor (kJ / mol)", "Odor (eV)",
    "Other (°C)", "Other (K)", "Other (g/mol)", "Other ( Da)", "Other (g / mol)", "Other (kJ/mol)",
    "Other (J/mol)", "Other (kcal/mol)", "Other (kJ / mol)", "Other (eV)",
]


def raw_long(spark, sf):
    name = F.when(F.col("ordinal") % 40 == 2, "Other").otherwise(X.strip("PropertyName"))
    return view(spark, sf, "measurements").withColumn("PropertyName", name)


@register(
    "w02_pivot_raw",
    f"""WITH {_RAW_WIDE} SELECT CID, InChIKey, PubChemName, PubChem_URL, base, stat, value FROM (
      SELECT i.*, base, unnest(['Median', 'Count', 'IQR']) AS stat, unnest([med, n::DOUBLE, iqr]) AS value
      FROM stats JOIN ident i USING (CID))""",
    "value",
)
def w02(spark, sf):
    long = raw_long(spark, sf)
    wide = W.pivot_raw(long, hot_rows=size_guard(long, ["CID"]))
    rest = [c for c in wide.columns if c not in D.IDENTITY_COLUMNS]
    wide = wide.select(*D.IDENTITY_COLUMNS, *[F.col(f"`{c}`").cast("double").alias(c) for c in rest])
    long = wide.unpivot(D.IDENTITY_COLUMNS, [f"`{c}`" for c in rest], "column", "value")
    return long.where("value is not null").select(
        *D.IDENTITY_COLUMNS, F.regexp_extract("column", "^(.*)_([A-Za-z]+)$", 1).alias("base"),
        F.regexp_extract("column", "^(.*)_([A-Za-z]+)$", 2).alias("stat"), "value",
    )


@register(
    "w02_open_raw",
    f"""WITH {_RAW_WIDE} SELECT CID, InChIKey, PubChemName, PubChem_URL, base AS name, med AS "Median", n AS "Count", iqr AS "IQR"
      FROM stats JOIN ident i USING (CID)""",
    "Median,IQR",
)
def w02_open(spark, sf):
    long = raw_long(spark, sf)
    return _listed(W.open_raw(long, hot_rows=size_guard(long, ["CID"])), D.IDENTITY_COLUMNS)


@register(
    "w03_iqr_halves",
    """SELECT l_suppkey, l_returnflag, len(l) AS n, list_aggregate(l, 'median') AS median,
      CASE WHEN len(l) < 2 THEN 0.0 ELSE list_aggregate(l[(len(l) + 1) // 2 + 1:], 'median')
        - list_aggregate(l[:len(l) // 2], 'median') END AS iqr, l[1] AS min, l[len(l)] AS max
    FROM (SELECT l_suppkey, l_returnflag, list_sort(list(l_extendedprice)) AS l FROM lineitem GROUP BY ALL)""",
    "median,iqr,min,max",
)
def w03(spark, sf):
    return W.halves_stats(table(spark, sf, "lineitem"), ["l_suppkey", "l_returnflag"], "l_extendedprice")


@register(
    "w04_values_only",
    f"""WITH {CLEAN} SELECT CID, '' AS InChIKey, '' AS PubChemName, '' AS PubChem_URL,
    {', '.join(f'"{p}_Median" AS "{p}"' for p in _ML_NAMES)} FROM ({_pivot_sql(_ML_NAMES, 'rows_')})""",
    ",".join(_ML_NAMES),
)
def w04(spark, sf):
    return W.values_only(w01(spark, sf))
