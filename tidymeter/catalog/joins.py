"""Queries of the joins, set operations and incremental work."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidymeter import dictionaries as D
from tidymeter.catalog import extraction, inputs  # noqa: F401
from tidymeter.catalog.base import VIEWS, duck, register, table, view
from tidymeter.operators import combine as J
from tidymeter.plans.energies import state_energies

# Structures: nation rows as text ids; the odd nations have none.
VIEWS["structures"] = """
SELECT CASE WHEN n_regionkey <> 2 THEN CAST(n_nationkey AS STRING) END AS CID, n_name AS SMILES FROM {nation}
"""
VIEWS["molecules"] = """
SELECT c_nationkey AS CID, c_custkey, c_acctbal FROM {customer}
"""
# The first order of a customer is not unique as such: many structure rows per id.
VIEWS["repeated"] = """
SELECT CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey AS STRING) ELSE 'none ' || CAST(o_custkey AS STRING) END AS CID,
  o_orderpriority AS SMILES, o_orderkey AS ordinal FROM {orders}
"""
VIEWS["blocks"] = """
SELECT CID, max(o_totalprice) AS top, CASE WHEN count(*) > 5 THEN count(*) END AS many FROM (
  SELECT CASE WHEN o_orderstatus = 'O' THEN CAST(o_custkey AS STRING) ELSE 'none ' || CAST(o_custkey AS STRING) END AS CID,
    o_totalprice FROM {orders}) GROUP BY CID
"""
VIEWS["cross"] = """
SELECT CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey AS STRING) ELSE 'none ' || CAST(c_custkey AS STRING) END AS CID,
  -c_acctbal / 100 AS e_reduced_at_oxidized,
  CASE WHEN c_custkey % 9 <> 0 THEN -c_acctbal / 90 - 1 END AS e_oxidized_at_reduced,
  CASE WHEN c_custkey % 9 = 0 THEN 'not converged' END AS error FROM {customer}
"""
# Lookups: every order is one attempt for its customer.
VIEWS["attempts"] = """
SELECT CAST(o_custkey AS STRING) AS CID, o_orderkey AS priority, o_orderpriority AS method,
  'http://o/' || CAST(o_orderkey AS STRING) AS url, 'title ' || o_orderpriority AS title,
  CASE WHEN o_orderstatus = 'P' THEN 'timeout' END AS error,
  o_orderpriority = '5-LOW' AS not_found, o_orderpriority IN ('4-NOT SPECIFIED', '1-URGENT') AS search_page,
  o_totalprice > 200000 AS has_keywords, 'snippet ' || CAST(o_orderkey AS STRING) AS snippet
FROM {orders}
"""
VIEWS["results"] = """
SELECT l_orderkey, l_linestatus = 'F' AS success, l_orderkey * 100 + l_linenumber * 10 + l_partkey / 1000000.0 AS done_at,
  l_shipdate, l_partkey, l_suppkey, l_linenumber FROM {lineitem}
"""


@register(
    "j01_attach_structures",
    f"""SELECT CAST(m.CID AS VARCHAR) AS CID, c_custkey, c_acctbal, SMILES
    FROM {duck('molecules')} m LEFT JOIN {duck('structures')} s ON CAST(m.CID AS VARCHAR) = s.CID""",
    "c_acctbal",
)
def j01(spark, sf):
    return J.attach_structures(view(spark, sf, "molecules"), view(spark, sf, "structures"))


@register(
    "j01_missing_count",
    f"""SELECT count(*) FILTER (WHERE SMILES IS NULL) AS missing, count(*) AS "rows"
    FROM {duck('molecules')} m LEFT JOIN {duck('structures')} s ON CAST(m.CID AS VARCHAR) = s.CID""",
)
def j01_missing(spark, sf):
    joined = J.attach_structures(view(spark, sf, "molecules"), view(spark, sf, "structures"))
    return J.missing_count(joined, "SMILES")


@register(
    "j02_attach_distinct",
    f"""SELECT CAST(c_custkey AS VARCHAR) AS CID, c_name, SMILES FROM customer LEFT JOIN (
      SELECT CID, arg_min(SMILES, ordinal) AS SMILES FROM {duck('repeated')} GROUP BY CID) r
    ON r.CID = CAST(c_custkey AS VARCHAR)""",
)
def j02(spark, sf):
    left = table(spark, sf, "customer").select(F.col("c_custkey").alias("CID"), "c_name")
    return J.attach_distinct(left, view(spark, sf, "repeated"))


@register(
    "j03_attach_block",
    f"""SELECT CAST(c_custkey AS VARCHAR) AS CID, top, many, (top IS NOT NULL OR many IS NOT NULL) AS covered
    FROM customer LEFT JOIN {duck('blocks')} b ON b.CID = CAST(c_custkey AS VARCHAR)""",
    "top",
)
def j03(spark, sf):
    left = table(spark, sf, "customer").select(F.col("c_custkey").alias("CID"))
    return J.attach_block(left, view(spark, sf, "blocks"))


@register(
    "j03_coverage_count",
    f"""SELECT count(*) FILTER (WHERE top IS NOT NULL OR many IS NOT NULL) AS covered, count(*) AS "rows"
    FROM customer LEFT JOIN {duck('blocks')} b ON b.CID = CAST(c_custkey AS VARCHAR)""",
)
def j03_count(spark, sf):
    return J.coverage_count(j03(spark, sf))


_STATE = ["scf_energy", "zpe_correction", "gibbs_G", "entropy_S"]


@register(
    "j04_state_delta",
    f"""SELECT n.CID, {', '.join(f'n.{c} AS neutral_{c}, a.{c} AS anion_{c}, a.{c} - n.{c} AS delta_{c}' for c in _STATE)}
    FROM {duck('states')} n JOIN {duck('states')} a ON n.CID = a.CID AND n.state = 'neutral' AND a.state = 'anion'""",
    ",".join(f"{p}_{c}" for c in _STATE for p in ("neutral", "anion", "delta")),
    digits=5,
)
def j04(spark, sf):
    return J.state_delta(view(spark, sf, "states"), columns=_STATE)


@register(
    "j05_available_pairs",
    f"""SELECT CID FROM {duck('states')} WHERE state = 'neutral' INTERSECT
    SELECT CID FROM {duck('states')} WHERE state = 'anion'""",
)
def j05(spark, sf):
    return J.available_pairs(view(spark, sf, "states"))


_EV, _KCAL = D.HARTREE_TO_EV, D.HARTREE_TO_KCAL
_MARCUS = ["reorg_energy_eV", "reorg_energy_kcal", "lambda1_eV", "lambda2_eV", "dG_reduction_eV",
           "activation_energy_eV", "activation_energy_kcal"]


@register(
    "j06_assemble_marcus",
    f"""SELECT CID, lam * {_EV} AS "reorg_energy_eV", lam * {_KCAL} AS reorg_energy_kcal, l1 * {_EV} AS "lambda1_eV",
      l2 * {_EV} AS "lambda2_eV", dg * {_EV} AS "dG_reduction_eV",
      CASE WHEN lam > 0 THEN (lam + dg) * (lam + dg) / (4 * lam) END * {_EV} AS "activation_energy_eV",
      CASE WHEN lam > 0 THEN (lam + dg) * (lam + dg) / (4 * lam) END * {_KCAL} AS activation_energy_kcal,
      coalesce(error, '') AS error
    FROM (SELECT n.CID, error, CASE WHEN ro IS NOT NULL AND orr IS NOT NULL THEN ro - a.scf_energy END AS l1,
        CASE WHEN ro IS NOT NULL AND orr IS NOT NULL THEN orr - n.scf_energy END AS l2,
        CASE WHEN ro IS NOT NULL AND orr IS NOT NULL THEN ro - a.scf_energy + (orr - n.scf_energy) END AS lam,
        a.gibbs_G - n.gibbs_G AS dg
      FROM {duck('states')} n JOIN {duck('states')} a ON n.CID = a.CID AND n.state = 'neutral' AND a.state = 'anion'
      LEFT JOIN (SELECT CID, e_reduced_at_oxidized AS ro, e_oxidized_at_reduced AS orr, error FROM {duck('cross')}) c
        ON c.CID = n.CID)""",
    ",".join(_MARCUS),
    digits=3,
)
def j06(spark, sf):
    return J.assemble_marcus(view(spark, sf, "states"), view(spark, sf, "cross"))


# Logs of both states: every order is a run of its customer, in the state of its parity.
VIEWS["state_logs"] = VIEWS["freq_logs"].replace(
    "AS path,", "AS path, CASE WHEN o_orderkey % 2 = 0 THEN 'neutral' ELSE 'anion' END AS state,", 1
)
_RUNS = rf"""runs AS (SELECT CID, state, scf, gibbs FROM (
    SELECT *, row_number() OVER (PARTITION BY CID, state ORDER BY mtime DESC, o_orderkey DESC) AS rn FROM (
      SELECT CID, state, mtime, o_orderkey,
        CAST(regexp_extract_all(text, 'SCF Done:\s+E\(\S+\)\s+=\s+([-\d.]+)', 1)[-1] AS DOUBLE) AS scf,
        CAST(nullif(regexp_extract(text, 'thermal Free Energies=\s+([-\d.]+)', 1), '') AS DOUBLE) AS gibbs
      FROM {duck('state_logs')} WHERE contains(text, 'Normal termination'))) WHERE rn = 1)"""


@register(
    "j14_logs_to_marcus",
    f"""WITH {_RUNS}, two AS (
      SELECT n.CID, a.scf - n.scf AS delta_scf_energy, a.gibbs - n.gibbs AS dg, error, ro - a.scf AS l1, orr - n.scf AS l2,
        ro IS NOT NULL AND orr IS NOT NULL AS known
      FROM runs n JOIN runs a ON n.CID = a.CID AND n.state = 'neutral' AND a.state = 'anion'
      LEFT JOIN (SELECT CID, e_reduced_at_oxidized AS ro, e_oxidized_at_reduced AS orr, error FROM {duck('cross')}) c ON c.CID = n.CID)
    SELECT CID, delta_scf_energy, dg AS "delta_gibbs_G", CASE WHEN known THEN (l1 + l2) * {_EV} END AS "reorg_energy_eV",
      CASE WHEN known AND l1 + l2 > 0 THEN (l1 + l2 + dg) * (l1 + l2 + dg) / (4 * (l1 + l2)) END * {_EV} AS "activation_energy_eV",
      dg * {_EV} AS "dG_reduction_eV", coalesce(error, '') AS error, known OR dg IS NOT NULL OR error IS NOT NULL AS covered FROM two""",
    "delta_scf_energy,delta_gibbs_G,reorg_energy_eV,activation_energy_eV,dG_reduction_eV",
    digits=2,
)
def j14(spark, sf):
    done = state_energies(view(spark, sf, "state_logs"), view(spark, sf, "cross"), tie=["o_orderkey"])
    return done.select(
        "CID", "delta_scf_energy", "delta_gibbs_G", "reorg_energy_eV", "activation_energy_eV", "dG_reduction_eV",
        "error", "covered",
    )


@register(
    "j06_skipped_keys",
    f"""SELECT CID FROM {duck('states')} GROUP BY CID
    HAVING NOT (bool_or(state = 'neutral') AND bool_or(state = 'anion'))""",
)
def j06_skipped(spark, sf):
    return J.skipped_keys(view(spark, sf, "states"))


@register(
    "j08_priority_lookup",
    f"""WITH t AS (SELECT *, error IS NULL AND NOT not_found AND NOT search_page AS direct,
        CASE WHEN error IS NOT NULL THEN 'Lookup failed: ' || error WHEN not_found THEN 'No entry found'
          WHEN search_page THEN 'Search results page returned, no direct page'
          WHEN has_keywords THEN 'Found related content' ELSE 'Page found, no explicit keywords' END AS note
      FROM {duck('attempts')}),
    cut AS (SELECT *, min(CASE WHEN direct THEN priority END) OVER (PARTITION BY CID) AS stop FROM t),
    tried AS (SELECT * FROM cut WHERE stop IS NULL OR priority <= stop),
    final AS (SELECT *, row_number() OVER (PARTITION BY CID ORDER BY priority DESC) AS rn FROM tried),
    answered AS (SELECT *, row_number() OVER (PARTITION BY CID ORDER BY priority DESC) AS rn FROM tried WHERE error IS NULL)
    SELECT f.CID, coalesce(f.direct AND f.has_keywords, false) AS found, coalesce(a.url, '') AS url,
      coalesce(a.method, '') AS method, coalesce(a.title, '') AS title, f.note,
      CASE WHEN f.direct AND f.has_keywords THEN f.snippet ELSE '' END AS snippet
    FROM final f LEFT JOIN answered a ON a.CID = f.CID AND a.rn = 1 WHERE f.rn = 1""",
)
def j08(spark, sf):
    return J.priority_lookup(view(spark, sf, "attempts"))


_DIM = """SELECT CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_partkey AS STRING) ELSE 'none' END AS target_id,
  CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE '' END AS pref_name,
  CASE WHEN p_partkey % 3 = 1 THEN p_type END AS target_name, p_partkey, p_brand, p_name FROM {part}"""


@register(
    "j09_resolve_names",
    f"""SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS Target,
      coalesce(CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN target_name
        ELSE CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'acc ' || target_id END END, '') AS TargetName
    FROM lineitem LEFT JOIN ({_DIM.format(part='part')}) d ON d.target_id = CAST(l_partkey AS VARCHAR)""",
    ints="l_linenumber",
)
def j09(spark, sf):
    dim = spark.sql(_DIM, part=table(spark, sf, "part"))
    even = F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise("")
    targets = dim.select(
        "target_id", "pref_name", "target_name",
        F.array(
            F.struct(F.lit("").alias("component_name"), F.lit(None).cast("string").alias("accession")),
            F.struct(
                even.alias("component_name"),
                F.concat(F.lit("acc "), "target_id").alias("accession"),
            ),
        ).alias("components"),
    )
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("Target")
    )
    return J.resolve_names(rows, targets)


@register(
    "j10_pending",
    f"""SELECT o_orderkey FROM orders ANTI JOIN (SELECT l_orderkey FROM {duck('results')} GROUP BY l_orderkey
      HAVING arg_max(success, done_at)) d ON o_orderkey = d.l_orderkey""",
)
def j10(spark, sf):
    inputs_ = table(spark, sf, "orders").select("o_orderkey")
    results = view(spark, sf, "results").withColumnRenamed("l_orderkey", "o_orderkey")
    return J.pending(inputs_, results, "o_orderkey", "success", "done_at")


@register(
    "j11_latest_per_key",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
      ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus <> 'P') WHERE rn = 1""",
    "o_totalprice",
)
def j11(spark, sf):
    rows = J.latest_per_key(
        table(spark, sf, "orders"), "o_custkey", "o_orderdate", ["o_orderkey"],
        F.col("o_orderstatus") != "P",
    )
    return rows.select("o_custkey", "o_orderkey", "o_totalprice")


@register(
    "j12_qualifying_ids",
    f"""SELECT DISTINCT CID FROM {duck('wide')} WHERE "ChEMBL:MIC [Bacillus]" IS NOT NULL
      OR "ChEMBL:IC50 [Giardia]" IS NOT NULL OR "ChEMBL:Ki [HeLa]" IS NOT NULL""",
)
def j12(spark, sf):
    return J.qualifying_ids(view(spark, sf, "wide"), min_coverage=0.05, min_samples=30)


@register(
    "j13_prepend_dedup",
    """SELECT o_custkey AS CID, o_orderkey AS ordinal, o_orderpriority AS SMILES, extra FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY part, o_orderkey) AS rn FROM (
        SELECT *, 0 AS part, NULL::VARCHAR AS extra FROM orders WHERE o_orderstatus = 'P'
        UNION ALL SELECT *, 1, o_orderstatus FROM orders WHERE o_orderstatus <> 'P')) WHERE rn = 1""",
)
def j13(spark, sf):
    orders = table(spark, sf, "orders")
    rows = orders.select(
        F.col("o_custkey").alias("CID"), F.col("o_orderkey").alias("ordinal"),
        F.col("o_orderpriority").alias("SMILES"), F.col("o_orderstatus").alias("extra"),
    )
    first = rows.where("extra = 'P'").drop("extra")
    return J.prepend_dedup(first, rows.where("extra <> 'P'"))
