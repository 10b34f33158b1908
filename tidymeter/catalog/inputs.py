"""Input views over the given tables, in SQL that both engines read alike.

They only shape the whole tables into what the operators expect: long
measurements from events, activity rows from line items, and so on.
"""

from __future__ import annotations

from tidymeter.catalog.base import VIEWS

# Long measurements. Names, units and a few bad values vary with the event id,
# so that every cleaning rule has rows to act on.
VIEWS["measurements"] = """
SELECT CAST(user_id AS STRING) AS CID,
  CASE WHEN event_id % 7 = 0 THEN '' ELSE 'KEY' || CAST(user_id AS STRING) END AS InChIKey,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'user ' || CAST(user_id AS STRING) END AS PubChemName,
  'http://u/' || CAST(user_id AS STRING) AS PubChem_URL,
  CASE event_id % 3 WHEN 0 THEN 'NIST' WHEN 1 THEN 'PubChem' ELSE 'Other' END AS Source,
  'Section' AS Section, 'Sub' AS Subsection,
  CASE event_id % 40 WHEN 0 THEN 'Units' WHEN 1 THEN 'Odor' WHEN 2 THEN vtext ELSE pname END AS PropertyName,
  CASE event_id % 40 WHEN 2 THEN vtext || ' ' WHEN 3 THEN 'for more info' WHEN 4 THEN ' https://x.org/1'
    WHEN 5 THEN 'HSDB:12' WHEN 6 THEN NULL WHEN 7 THEN 'no number'
    WHEN 8 THEN '  ' ELSE vtext || coalesce(' ' || unit, '') END AS PropertyValue,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE unit END AS PropertyUnit,
  CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE 'ref ' || CAST(event_id % 4 AS STRING) END AS Reference,
  CAST(NULL AS STRING) AS Method, '' AS Comment, props AS Condition,
  CAST(NULL AS STRING) AS ReactionEquation, 'http://s' AS SourceURL, event_id AS ordinal
FROM (SELECT event_id, user_id, props, CAST(CAST(value AS DECIMAL(18,2)) AS STRING) AS vtext,
  CASE event_type WHEN 'click' THEN ' Boiling Point' WHEN 'purchase' THEN 'Molecular Weight '
    WHEN 'error' THEN 'heat of vaporization' WHEN 'signup' THEN 'XLogP3'
    ELSE 'Proton Affinity (kJ/mol)' END AS pname,
  CASE event_type
    WHEN 'click' THEN CASE event_id % 3 WHEN 0 THEN '°C' WHEN 1 THEN 'K' ELSE NULL END
    WHEN 'purchase' THEN CASE event_id % 3 WHEN 0 THEN 'g/mol' WHEN 1 THEN ' Da' ELSE 'g / mol' END
    WHEN 'error' THEN CASE event_id % 3 WHEN 0 THEN 'kJ/mol' WHEN 1 THEN 'J/mol' ELSE 'kcal/mol' END
    WHEN 'signup' THEN NULL
    ELSE CASE event_id % 3 WHEN 0 THEN 'kJ / mol' WHEN 1 THEN '' ELSE 'eV' END END AS unit
  FROM {events})
"""

# Standard measurements: names and units already harmonised, values numeric.
VIEWS["standard"] = """
SELECT CAST(user_id AS STRING) AS CID,
  CASE event_type WHEN 'click' THEN 'Tb' WHEN 'purchase' THEN 'MW' WHEN 'error' THEN 'Hvap'
    WHEN 'signup' THEN 'LogP' ELSE 'Viscosity' END AS StandardPropertyName,
  CASE event_type WHEN 'purchase' THEN value * 10 WHEN 'signup' THEN value / 10 ELSE value END AS NumericValue,
  CASE event_type WHEN 'click' THEN CASE event_id % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'K' ELSE NULL END
    WHEN 'purchase' THEN CASE event_id % 3 WHEN 0 THEN 'Da' WHEN 1 THEN 'g/mol' ELSE 'kJ/mol' END
    WHEN 'error' THEN CASE event_id % 3 WHEN 0 THEN 'J/mol' WHEN 1 THEN 'kJ/mol' ELSE 'kcal/mol' END
    ELSE CASE event_id % 3 WHEN 0 THEN ' ' ELSE 'x' END END AS CleanUnit,
  CASE event_id % 3 WHEN 0 THEN 'NIST' WHEN 1 THEN 'PubChem' ELSE 'Other' END AS Source,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'ref ' || CAST(event_id % 4 AS STRING) END AS Reference,
  event_id AS ordinal
FROM {events}
"""

# Activity rows: supplier as entity, return flag as target, part group as assay.
VIEWS["activities"] = """
SELECT ' ' || CAST(l_suppkey AS STRING) AS CID,
  CASE WHEN l_linestatus = 'F' THEN 'ChEMBL' ELSE 'BindingDB' END AS Source,
  CAST(l_partkey % 7 AS STRING) AS AssayID,
  'T' || l_returnflag AS Target,
  CASE l_returnflag WHEN 'A' THEN ' target   A ' WHEN 'N' THEN '' ELSE NULL END AS TargetName,
  CASE WHEN l_linenumber = 2 THEN 'Ki' ELSE 'IC50' END AS ActivityType,
  CASE WHEN l_linenumber = 7 THEN 'broken' ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) END AS Value,
  CASE l_linenumber WHEN 5 THEN CAST(CAST(l_quantity AS DECIMAL(18,2)) AS STRING) WHEN 6 THEN 'n/a' ELSE '' END AS pChemblValue,
  CASE l_linenumber WHEN 3 THEN '>' WHEN 1 THEN '=' WHEN 2 THEN NULL ELSE '~' END AS Relation,
  l_orderkey, l_linenumber
FROM {lineitem}
"""

# Order totals averaged per customer and state: one row per (customer, state).
VIEWS["states"] = """
SELECT CAST(o_custkey AS STRING) AS CID,
  CASE o_orderstatus WHEN 'F' THEN 'neutral' WHEN 'O' THEN 'anion' ELSE 'cation' END AS state,
  -avg(o_totalprice) / 1000 AS scf_energy, -avg(o_totalprice) / 1000 - 0.05 AS gibbs_G,
  min(o_totalprice) / 1000000 AS zpe_correction, CAST(count(*) AS DOUBLE) AS entropy_S
FROM {orders} GROUP BY o_custkey, o_orderstatus
"""

# Wide table with identity, features and targets of several families.
VIEWS["wide"] = """
SELECT CAST(c_custkey AS STRING) AS CID, 'K' || CAST(c_custkey AS STRING) AS InChIKey,
  c_name AS PubChemName, CAST(c_acctbal AS DOUBLE) AS MW,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_nationkey AS DOUBLE) END AS LogP,
  CASE WHEN c_custkey % 50 = 0 THEN 1.0E0 END AS Rare,
  CASE WHEN c_custkey % 2 = 0 THEN 'n/a' ELSE CAST(c_custkey AS STRING) END AS Note,
  CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END AS `ChEMBL:MIC [Bacillus]`,
  CASE WHEN c_custkey % 30 = 0 THEN c_acctbal END AS `ChEMBL:MIC [Proteus]`,
  CASE WHEN c_acctbal > 5000 THEN c_acctbal END AS `ChEMBL:IC50 [Giardia]`,
  CASE WHEN c_custkey % 4 = 0 THEN c_acctbal END AS `ChEMBL:Ki [HeLa]`,
  CASE WHEN c_custkey % 200 = 0 THEN c_acctbal END AS `ChEMBL:Potency [x]`
FROM {customer}
"""
