"""Queries of the extraction jobs over corpora built from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidymeter import dictionaries as D
from tidymeter.catalog.base import REGISTRY, VIEWS, duck, literal, register, table, view
from tidymeter.catalog.measurements import CLEAN
from tidymeter.operators import literature, logs as L, pages as P, payloads, sequences as S
from tidymeter.plans.clean import clean
from tidymeter.plans.payloads import measurements

_DEC = "CAST(CAST({x} AS DECIMAL(18,{d})) AS STRING)"


def _num(x: str, d: int) -> str:
    return _DEC.format(x=x, d=d)


# Frequency logs: every order is one run of its customer.
VIEWS["freq_logs"] = f"""
SELECT CAST(o_custkey AS STRING) AS CID, 'run/' || CAST(o_orderkey AS STRING) || '_freq.log' AS path,
  o_orderdate AS mtime, o_orderkey,
  ' Entering' || chr(10) || ' NAtoms=      ' || CAST(2 + o_orderkey % 4 AS STRING) || chr(10)
  || ' SCF Done:  E(RB3LYP) =  -154.05' || CAST(1000 + o_custkey % 1000 AS STRING) || '     A.U. after   10 cycles' || chr(10)
  || ' SCF Done:  E(RB3LYP) =  -' || {_num('o_totalprice', 2)} || '     A.U. after   12 cycles' || chr(10) || chr(10)
  || ' Frequencies --    ' || {_num('o_orderkey % 700 - 50', 4)} || '   200.0000   ' || {_num('o_totalprice', 2)} || chr(10)
  || ' Red. masses --      1.0000     2.0000     3.0000' || chr(10)
  || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ' Frequencies --    400.5000   -1.2500   600.0000' || chr(10) END
  || ' Red. masses --      1.0000' || chr(10) || chr(10)
  || ' Zero-point correction=                           0.' || CAST(100000 + o_custkey AS STRING) || ' (Hartree/Particle)' || chr(10)
  || ' Thermal correction to Energy=                    0.131234' || chr(10)
  || ' Thermal correction to Enthalpy=                  0.' || CAST(200000 + o_custkey AS STRING) || chr(10)
  || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ' Thermal correction to Gibbs Free Energy=         0.098765' || chr(10) END
  || ' Sum of electronic and zero-point Energies=         -154.123456' || chr(10)
  || ' Sum of electronic and thermal Enthalpies=          -' || {_num('o_totalprice', 2)} || chr(10)
  || ' Sum of electronic and thermal Free Energies=       -' || {_num('o_totalprice + 1', 2)} || chr(10) || chr(10)
  || ' Temperature   298.' || CAST(100 + o_orderkey % 900 AS STRING) || ' Kelvin.  Pressure   1.00000 Atm.' || chr(10) || chr(10)
  || '                    E (Thermal)             CV                S' || chr(10)
  || '                     KCal/Mol        Cal/Mol-Kelvin    Cal/Mol-Kelvin' || chr(10)
  || ' Total                   55.000             ' || CAST(o_orderkey % 50 AS STRING) || '.500            75.' || CAST(100 + o_custkey % 800 AS STRING) || chr(10)
  || ' Translational           0.889              2.981            40.000' || chr(10)
  || ' Rotational              0.889              2.250            25.000' || chr(10)
  || ' Vibrational            53.000             14.000            10.125' || chr(10) || chr(10)
  || CASE o_orderstatus WHEN 'P' THEN ' running' WHEN 'O' THEN ' Error termination via Lnk1e'
     ELSE ' Normal termination of the job.' END || chr(10) AS text
FROM {{orders}}
"""

# Optimisation logs: one per line item, two full steps and a third that is cut off.
VIEWS["opt_logs"] = f"""
SELECT l_orderkey, l_linenumber,
  ' SCF Done:  E(RB3LYP) =  -' || {_num('l_extendedprice', 2)} || '     A.U.' || chr(10)
  || ' Maximum Force            0.010000     0.000450     NO' || chr(10)
  || ' RMS     Force            ' || {_num('l_discount', 4)} || '     0.000300     ' || CASE WHEN l_discount < 0.01 THEN 'YES' ELSE 'NO' END || chr(10)
  || ' Maximum Displacement     ' || {_num('l_tax', 4)} || '     0.001800     ' || CASE WHEN l_tax < 0.01 THEN 'YES' ELSE 'NO' END || chr(10)
  || ' RMS     Displacement     0.030000     0.001200     NO' || chr(10)
  || ' SCF Done:  E(RB3LYP) =  -' || {_num('l_extendedprice + l_quantity', 2)} || '     A.U.' || chr(10)
  || ' Maximum Force            0.000400     0.000450     YES' || chr(10)
  || ' RMS     Force            0.000100     0.000300     YES' || chr(10)
  || ' Maximum Displacement     0.001000     0.001800     YES' || chr(10)
  || ' RMS     Displacement     ' || {_num('l_quantity', 4)} || '     0.001200     ' || CASE WHEN l_linestatus = 'F' THEN 'YES' ELSE 'NO' END || chr(10)
  || CASE WHEN l_linenumber = 2 THEN ' SCF Done:  E(RB3LYP) =  -1.0' || chr(10) || ' Maximum Force            0.5     0.000450     NO' || chr(10) ELSE '' END
  AS text
FROM {{lineitem}}
"""

VIEWS["geometry_logs"] = f"""
SELECT p_partkey, ' Standard orientation:' || chr(10) || repeat('-', 30) || chr(10) || ' Center Atomic' || chr(10)
  || repeat('-', 30) || chr(10) || '   1   1   0   9.0 9.0 9.0' || chr(10) || repeat('-', 30) || chr(10)
  || ' Standard orientation:' || chr(10) || repeat('-', 30) || chr(10) || ' Center Atomic' || chr(10)
  || repeat('-', 30) || chr(10)
  || '      1          6           0        ' || {_num('p_retailprice', 2)} || '    -0.500000    0.000000' || chr(10)
  || '      2          ' || CAST(1 + p_partkey % 95 AS STRING) || '           0       -1.250000    ' || CAST(p_size AS STRING) || '.5    2.000000' || chr(10)
  || repeat('-', 30) || chr(10) AS text
FROM {{part}}
"""

VIEWS["ensembles"] = f"""
SELECT o_orderkey, '2' || chr(10) || '  -' || {_num('o_totalprice / 1000000', 8)} || chr(10) || 'H 0 0 0' || chr(10) || 'H 0 0 1' || chr(10)
  || '1' || chr(10) || 'conf_2 -' || {_num('o_orderkey / 50000.0', 6)} || ' Eh' || chr(10) || 'He 0 0 0' || chr(10) || chr(10)
  || '1' || chr(10) || 'no energy' || chr(10) || 'Ne 0 0 0' || chr(10)
  || '1' || chr(10) || '-' || {_num('o_custkey / 5000.0', 6)} || chr(10) || 'Ar 0 0 0' || chr(10)
  || '3' || chr(10) || '-99.0' || chr(10) || 'X 0 0 0' || chr(10) AS text
FROM {{orders}}
"""

VIEWS["route_files"] = """
SELECT o_custkey AS root, CASE WHEN o_orderstatus = 'P' THEN 'preopt/' ELSE 'job/' END || lpad(CAST(o_orderkey AS STRING), 9, '0')
  || CASE WHEN o_orderstatus = 'F' THEN '_freq.gjf' ELSE '_opt.gjf' END AS path,
  '%nproc=4' || chr(10) || CASE WHEN o_orderkey % 3 = 0 THEN '#p PM7 opt' || chr(10) ELSE '' END
  || '  #p METHOD' || CAST(o_orderkey % 10 AS STRING) || '/BASIS' || CAST(o_orderkey % 7 AS STRING) || ' opt' || chr(10)
  || 'title a/b' || chr(10) AS text
FROM {orders}
"""

VIEWS["table_pages"] = f"""
SELECT o_orderkey AS page_id, '<html><body><h2>Phase <b>data</b></h2><p>A + B = C' || CAST(o_custkey AS STRING) || '</p>'
  || '<table class="wide data"><tr><th>Quantity</th><th>Value</th><th>Units</th><th>Method</th><th>Temperature (K)</th></tr>'
  || '<tr><td>Tboil</td><td>' || {_num('o_totalprice', 2)} || '</td><td>K</td><td>' || o_orderstatus || '</td><td>298</td></tr>'
  || '<tr><td>Sgas</td><td>' || CAST(o_custkey AS STRING) || ' (J/mol&#42;K)</td><td></td><td></td><td></td></tr>'
  || '<tr><td> </td><td></td><td></td><td></td><td></td></tr></table>'
  || '<h3>Ions</h3><div><table class="data"><tr><th>IE (eV)</th><th>Reference</th><th>Pressure (kPa)</th><th>Tc</th></tr>'
  || '<tr><td>' || CAST(o_custkey AS STRING) || '.5 kJ</td><td>' || o_orderpriority || '</td><td>101</td><td></td></tr></table></div>'
  || '<table class="data"><tr><th>Quantity</th><th>Value</th><th>Quantity</th><th>Value</th></tr>'
  || '<tr><td>a</td><td>1</td><td>b</td><td>' || CAST(o_orderkey AS STRING) || '</td></tr></table>'
  || '<table class="plain"><tr><th>Quantity</th></tr><tr><td>skip</td></tr></table></body></html>' AS html
FROM {{orders}}
"""

VIEWS["div_pages"] = """
SELECT o_orderkey AS page_id, '<div class="x"><div class="sm:table-row"><div class="sm:table-cell">Property Name</div>'
  || '<div class="sm:table-cell">Property Value</div><div class="sm:table-cell">Reference</div></div>'
  || '<div class="sm:table-row b"><div class="sm:table-cell">Priority</div><div class="sm:table-cell"><div>' || o_orderpriority
  || '</div> &amp; <b>more</b></div><div class="sm:table-cell">r' || CAST(o_custkey AS STRING) || '</div></div>'
  || '<div class="sm:table-row"><div class="sm:table-cell">two</div><div class="sm:table-cell">cells</div></div>'
  || CASE WHEN o_orderkey % 2 = 0 THEN '<div class="sm:table-row"><div class="sm:table-cell">Key</div><div class="sm:table-cell">'
     || CAST(o_orderkey AS STRING) || '</div><div class="sm:table-cell"></div></div>' ELSE '' END || '</div>' AS html
FROM {orders}
"""

VIEWS["section_payloads"] = """
SELECT p_partkey, repeat('{{"Any":[', CAST(p_partkey % 10 AS INT)) || '{{"Record":{{"Section":[{{"TOCHeading":"Names","Section":[{{"TOCHeading":"skip","Information":[{{"Value":{{"String":"x"}}}}]}}]}},'
  || '{{"TOCHeading":"Chemical and Physical Properties","Section":[{{"TOCHeading":"Computed Properties","Information":[{{"Value":{{"Text":"outer"}}}}],"Section":['
  || '{{"TOCHeading":" Molecular Weight ","Information":[{{"Value":{{"Number":[' || CAST(p_size AS STRING) || ',2.5],"Unit":"g/mol"}},"Reference":["r1 ","","r2"]}}]}},'
  || '{{"TOCHeading":"Name","Information":[{{"Value":{{"StringWithMarkup":[{{"String":"' || p_name || '"}},{{"String":" second "}}]}}}},{{"Value":{{"String":" ' || p_brand || ' "}},"Reference":null}}]}}]}},'
  || '{{"TOCHeading":"Experimental Properties","Section":[{{"TOCHeading":"Odor","Information":[{{"Value":{{"Text":"t' || CAST(p_partkey AS STRING) || '"}}}}]}}]}}]}}]}}}}' || repeat(']}}', CAST(p_partkey % 10 AS INT)) AS payload
FROM {part}
"""

VIEWS["activity_payloads"] = """
SELECT o_orderkey, '{{"' || CASE WHEN o_orderkey % 2 = 0 THEN 'activities' ELSE 'activity' END
  || '":[{{"target_chembl_id":"T' || CAST(o_custkey AS STRING) || '","standard_value":"' || CAST(o_orderkey AS STRING)
  || '.5","pchembl_value":"' || CASE WHEN o_orderkey % 3 = 0 THEN 'bad' ELSE '7.25' END || '","assay_chembl_id":"A'
  || CAST(o_custkey % 9 AS STRING) || '","standard_type":"IC50","standard_units":"nM","standard_relation":"=","document_chembl_id":"D1"}},'
  || '{{"standard_value":null,"assay_id":' || CAST(o_custkey AS STRING) || ',"src_id":7}}]}}' AS payload FROM {orders}
"""

VIEWS["synonyms"] = """
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '50-00-' || CAST(p_partkey % 10000 AS STRING) END AS s1,
  '12-345-' || CAST(p_size AS STRING) AS s2, CASE WHEN p_partkey % 7 = 0 THEN '123-456-789' ELSE 'CAS ' || p_name END AS s3,
  CASE WHEN p_partkey % 3 = 0 THEN '77' ELSE p_name END AS s4, p_brand AS reg, p_partkey % 4 = 0 AS bare FROM {part}
"""

VIEWS["mention_pages"] = """
SELECT o_orderkey, '<p>IC50: ' || CAST(1000 + o_custkey AS STRING) || ',5 nM and ki=' || CAST(o_orderkey AS STRING)
  || '.25 uM</p> kd ... , EC50 ' || CAST(o_custkey AS STRING) || ' end' AS html FROM {orders}
"""

VIEWS["articles"] = """
SELECT doc_id, source, text || CASE WHEN doc_id % 3 = 0 THEN ' The enthalpy of x is about ' || CAST(doc_id AS STRING) || ' kJ/mol here.'
  WHEN doc_id % 3 = 1 THEN ' Supplementary data: entropy 5 J/mol, Gibbs free energy of -' || CAST(doc_id % 20 AS STRING) || ' kcal/mol; entropy 5 J/mol'
  ELSE '' END AS text FROM {documents}
"""

# --- F08, E01..E05 ------------------------------------------------------------------------

_SCF_SQL = r"regexp_extract_all(text, 'SCF Done:\s+E\(\S+\)\s+=\s+([-\d.]+)', 1)"


def _label(label: str) -> str:
    return rf"TRY_CAST(nullif(regexp_extract(text, '{label}\s*([-\d.]+)', 1), '') AS DOUBLE)"


_MODES = r"""list_filter(list_transform(flatten(list_transform(regexp_extract_all(text, 'Frequencies --\s+([-\d.\s]+)', 1),
  lambda x: regexp_split_to_array(trim(x, E' \n\t\r'), '\s+'))), lambda x: TRY_CAST(x AS DOUBLE)), lambda x: x IS NOT NULL)"""
_DESCRIPTOR_SQL = (
    f"CAST({_SCF_SQL}[-1] AS DOUBLE) AS scf_energy, "
    + ", ".join(f'{_label(v)} AS "{k}"' for k, v in D.DESCRIPTOR_LABELS.items())
    + r""", TRY_CAST(nullif(regexp_extract(text, '(?m)^\s*Total\s+[\d.]+\s+[\d.]+\s+([\d.]+)', 1), '') AS DOUBLE) AS "entropy_S","""
    + f""" len(list_filter({_MODES}, lambda x: x < 0)) AS n_imaginary, list_min({_MODES}) AS lowest_freq,
    len({_MODES}) AS n_modes"""
)
_DESC_DOUBLES = ",".join(c for c in D.DESCRIPTORS if c not in ("n_imaginary", "n_modes"))


@register(
    "f08_completed_logs",
    f"SELECT path, CID FROM {duck('freq_logs')} WHERE contains(text, 'Normal termination')",
)
def f08(spark, sf):
    return L.completed_logs(view(spark, sf, "freq_logs")).select("path", "CID")


@register(
    "f08_completed_logs_tail",
    f"SELECT path, CID FROM {duck('freq_logs')} WHERE contains(right(text, 4096), 'Normal termination')",
)
def f08_tail(spark, sf):
    return L.completed_logs(view(spark, sf, "freq_logs"), tail=4096).select("path", "CID")


@register(
    "e01_extract_descriptors",
    f"""SELECT o_orderkey, {_DESCRIPTOR_SQL} FROM {duck('freq_logs')} WHERE contains(text, 'Normal termination')""",
    _DESC_DOUBLES,
)
def e01(spark, sf):
    return L.extract_descriptors(view(spark, sf, "freq_logs")).select("o_orderkey", *D.DESCRIPTORS)


@register(
    "e01_newest_descriptors",
    f"""SELECT CID, {_DESCRIPTOR_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY CID ORDER BY mtime DESC, o_orderkey DESC) AS rn
      FROM {duck('freq_logs')} WHERE contains(text, 'Normal termination')) WHERE rn = 1""",
    _DESC_DOUBLES,
)
def e01_newest(spark, sf):
    found = L.extract_descriptors(view(spark, sf, "freq_logs"))
    newest = L.latest_per_key(found, "CID", "mtime", ["o_orderkey"])
    return newest.select("CID", *D.DESCRIPTORS)


_KCAL = D.HARTREE_TO_KCAL


@register(
    "e02_extract_thermo",
    rf"""SELECT o_orderkey, CAST('298.' || CAST(100 + o_orderkey % 900 AS VARCHAR) AS DOUBLE) AS temp,
      NULL::DOUBLE AS freq_scale, CAST('0.' || CAST(100000 + CAST(CID AS BIGINT) AS VARCHAR) AS DOUBLE) * {_KCAL} AS zpe,
      0.131234 * {_KCAL} AS te, CAST('0.' || CAST(200000 + CAST(CID AS BIGINT) AS VARCHAR) AS DOUBLE) * {_KCAL} AS th,
      75 + (100 + CAST(CID AS BIGINT) % 800) / 1000.0 AS ts, 40.0 AS ts_trans, 25.0 AS ts_rot, 10.125 AS ts_vib,
      o_orderkey % 50 + 0.5 AS cv, 2.981 AS cv_trans, 2.25 AS cv_rot, 14.0 AS cv_vib FROM {duck('freq_logs')}""",
    "temp,freq_scale,zpe,te,th,ts,ts_trans,ts_rot,ts_vib,cv,cv_trans,cv_rot,cv_vib",
)
def e02(spark, sf):
    return L.extract_thermo(view(spark, sf, "freq_logs")).drop("CID", "path", "mtime")


@register(
    "e03_extract_steps",
    """SELECT l_orderkey, l_linenumber, 1 AS step, -l_extendedprice AS energy, 0.0 AS delta_e, l_discount AS rms_force,
      0.01 AS max_force, 0.03 AS rms_disp, l_tax AS max_disp FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, 2, -round(l_extendedprice + l_quantity, 2),
      -round(l_extendedprice + l_quantity, 2) + l_extendedprice, 0.0001, 0.0004, l_quantity, 0.001 FROM lineitem""",
    "energy,delta_e,rms_force,max_force,rms_disp,max_disp",
    "l_linenumber,step",
)
def e03(spark, sf):
    return L.extract_steps(view(spark, sf, "opt_logs"))


@register(
    "e04_extract_criteria",
    """WITH c AS (SELECT l_orderkey, l_linenumber, 1 AS step, -l_extendedprice AS energy, NULL::DOUBLE AS delta_e,
        unnest(['Maximum Force', 'RMS Force', 'Maximum Displacement', 'RMS Displacement']) AS name,
        unnest([0.01, l_discount, l_tax, 0.03]) AS value, unnest([0.00045, 0.0003, 0.0018, 0.0012]) AS threshold,
        unnest([false, l_discount < 0.01, l_tax < 0.01, false]) AS converged FROM lineitem
      UNION ALL SELECT l_orderkey, l_linenumber, 2, -round(l_extendedprice + l_quantity, 2),
        -round(l_extendedprice + l_quantity, 2) + l_extendedprice,
        unnest(['Maximum Force', 'RMS Force', 'Maximum Displacement', 'RMS Displacement']),
        unnest([0.0004, 0.0001, 0.001, l_quantity]), unnest([0.00045, 0.0003, 0.0018, 0.0012]),
        unnest([true, true, true, l_linestatus = 'F']) FROM lineitem)
    SELECT *, value / threshold AS ratio, sum(converged::INT) OVER w AS n_converged, bool_and(converged) OVER w AS all_converged
    FROM c WINDOW w AS (PARTITION BY l_orderkey, l_linenumber, step, energy)""",
    "energy,delta_e,value,threshold,ratio",
    "l_linenumber,step,n_converged",
    digits=4,
)
def e04(spark, sf):
    return L.extract_criteria(view(spark, sf, "opt_logs"))


@register(
    "e05_log_state",
    f"""SELECT o_orderkey, CASE WHEN contains(text, 'Normal termination') THEN 'done' WHEN contains(text, 'Error termination')
      THEN 'error' ELSE 'running' END AS state, len({_MODES}) AS modes, 3 * (2 + o_orderkey % 4) - 6 AS expected_modes,
      CASE WHEN o_orderkey % 4 = 0 THEN CASE WHEN contains(text, 'Normal termination') THEN 1.0 ELSE 0.0 END
        ELSE least(greatest(len({_MODES}) / (3.0 * (2 + o_orderkey % 4) - 6), 0.0), 1.0) END AS progress
    FROM {duck('freq_logs')}""",
    "progress",
    "modes,expected_modes",
)
def e05(spark, sf):
    return L.log_state(view(spark, sf, "freq_logs")).drop("CID", "path", "mtime")


_ELEMENT_ROWS = ", ".join(f"({k}, '{v}')" for k, v in D.ELEMENTS.items())


@register(
    "e06_extract_geometry",
    f"""SELECT p_partkey, 1 AS atom, 'C' AS element, p_retailprice AS x, -0.5 AS y, 0.0 AS z FROM part
    UNION ALL SELECT p_partkey, 2, coalesce(v, 'X' || CAST(1 + p_partkey % 95 AS VARCHAR)), -1.25, p_size + 0.5, 2.0
    FROM part LEFT JOIN (VALUES {_ELEMENT_ROWS}) AS el(k, v) ON k = 1 + p_partkey % 95""",
    "x,y,z",
    "atom",
)
def e06(spark, sf):
    return L.extract_geometry(view(spark, sf, "geometry_logs"))


@register(
    "e07_select_conformers",
    f"""WITH r AS (SELECT o_orderkey, unnest([1, 2, 3, 4]) AS pos,
        unnest([-CAST(CAST(o_totalprice / 1000000 AS DECIMAL(18,8)) AS DOUBLE), -CAST(CAST(o_orderkey / 50000.0 AS DECIMAL(18,6)) AS DOUBLE), 0.0,
          -CAST(CAST(o_custkey / 5000.0 AS DECIMAL(18,6)) AS DOUBLE)]) AS e,
        unnest(['H', 'He', 'Ne', 'Ar']) AS head FROM orders),
      k AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY e, pos) AS "rank",
        (e - min(e) OVER (PARTITION BY o_orderkey)) * {_KCAL} AS rel FROM r)
    SELECT o_orderkey, "rank", rel AS rel_energy_kcal, head FROM k WHERE "rank" <= 3 AND rel <= 120""",
    "rel_energy_kcal",
)
def e07(spark, sf):
    rows = L.select_conformers(view(spark, sf, "ensembles"), 3, 120.0)
    return rows.withColumn("head", F.regexp_extract("block", r"\n([A-Z][a-z]?) [^\n]*\n", 1)).drop("block")


@register(
    "e08_rank_results",
    f"""SELECT o_custkey AS CID, o_orderkey AS ordinal, row_number() OVER (PARTITION BY o_custkey ORDER BY NOT good,
        CASE WHEN good THEN energy END, o_orderkey) AS "rank",
      (energy - min(CASE WHEN good THEN energy END) OVER (PARTITION BY o_custkey)) * {_KCAL} AS rel_energy_kcal
    FROM (SELECT *, CASE WHEN o_orderkey % 5 <> 0 THEN -o_totalprice / 100000 END AS energy,
      o_orderstatus <> 'P' AND o_orderkey % 5 <> 0 AS good FROM orders)""",
    "rel_energy_kcal",
)
def e08(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("CID"), F.col("o_orderkey").alias("ordinal"),
        F.when(F.col("o_orderkey") % 5 != 0, -F.col("o_totalprice") / 100000).alias("energy"),
        (F.col("o_orderstatus") != "P").alias("success"),
    )
    return L.rank_results(rows).drop("energy", "success")


@register(
    "e09_route_level",
    f"""SELECT root, 'METHOD' || CAST(k % 10 AS VARCHAR) AS method, 'BASIS' || CAST(k % 7 AS VARCHAR) AS basis FROM (
      SELECT o_custkey AS root, coalesce(min(o_orderkey) FILTER (WHERE o_orderstatus = 'F'),
        min(o_orderkey) FILTER (WHERE o_orderstatus = 'O')) AS k FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey)""",
)
def e09(spark, sf):
    return L.route_level(view(spark, sf, "route_files"))


# --- E10..E17 -----------------------------------------------------------------------------

_NAME3 = '"PropertyName", "PropertyValue", "PropertyUnit", "Condition"'


@register(
    "e10_extract_html_tables",
    """WITH o AS (SELECT *, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS price FROM orders),
    eq AS (SELECT o_orderkey, 'A + B = C' || CAST(o_custkey AS VARCHAR) AS e FROM orders)
    SELECT r.* , e AS "ReactionEquation" FROM (
      SELECT o_orderkey AS page_id, 0 AS table_no, 0 AS part, 'Phase data' AS "TableHeading", '' AS "Reference", o_orderstatus AS "Method",
        'Tboil' AS "PropertyName", price AS "PropertyValue", 'K' AS "PropertyUnit", 'Temperature=298' AS "Condition" FROM o
      UNION ALL SELECT o_orderkey, 0, 0, 'Phase data', '', '', 'Sgas', CAST(o_custkey AS VARCHAR) || ' (J/mol*K)', 'J/mol*K', '' FROM o
      UNION ALL SELECT o_orderkey, 1, 0, 'Ions', o_orderpriority, '', 'IE', CAST(o_custkey AS VARCHAR) || '.5', 'kJ', 'Pressure (kPa)=101' FROM o
      UNION ALL SELECT o_orderkey, 1, 0, 'Ions', o_orderpriority, '', 'Tc', '', '', 'Pressure (kPa)=101' FROM o
      UNION ALL SELECT o_orderkey, 2, 0, 'Ions', '', '', 'a', '1', '', '' FROM o
      UNION ALL SELECT o_orderkey, 2, 1, 'Ions', '', '', 'b', CAST(o_orderkey AS VARCHAR), '', '' FROM o) r
    JOIN eq ON eq.o_orderkey = r.page_id""",
    ints="table_no,part",
)
def e10(spark, sf):
    return P.extract_html_tables(view(spark, sf, "table_pages")).drop("row_no", "Comment")


@register(
    "e11_extract_links",
    """SELECT DISTINCT page_id, m[2] AS section, CASE WHEN m[1] LIKE '/%' THEN 'http://base.example.org' || m[1]
      ELSE m[1] END AS url FROM (
      SELECT page_id, unnest(list_zip(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1),
        regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 2))) AS m FROM pages)
    WHERE regexp_matches(lower(m[2]), 'th|an') AND m[1] LIKE '%/%' AND trim(m[2]) <> ''
    QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY section) = 1""",
)
def e11(spark, sf):
    pages = table(spark, sf, "pages")
    return P.extract_links(pages, "http://base.example.org/x", mask="/", topics=["th", "an"])


@register(
    "e12_classify_pages",
    r"""SELECT page_id, url, trim(regexp_extract(html, '(?i)<title>([^<]+)</title>', 1)) AS title,
      contains(html, '<nav>') AND contains(html, 'href="/') AS is_search, contains(lower(html), 'tion') AS has_keywords,
      left(trim(regexp_extract(html, '(?i)(the[^.\n]{0,40}?(?:tion|th))', 1)), 250) AS snippet FROM pages""",
)
def e12(spark, sf):
    return P.classify_pages(
        table(spark, sf, "pages"), keywords=["TION"], search_marks=("<nav>", 'href="/'),
        phrase=r"(?i)(the[^.\n]{0,40}?(?:tion|th))",
    )


@register(
    "e13_extract_json_sections",
    """SELECT p_partkey, unnest(['Chemical and Physical Properties', 'Computed Properties', 'Computed Properties',
        'Computed Properties', 'Experimental Properties']) AS heading,
      unnest(['Computed Properties', 'Molecular Weight', 'Name', 'Name', 'Odor']) AS "PropertyName",
      unnest(['outer', CAST(p_size AS VARCHAR) || ', 2.5 g/mol', p_name || ' second', p_brand, 't' || CAST(p_partkey AS VARCHAR)]) AS "PropertyValue",
      unnest(['', 'g/mol', '', '', '']) AS "PropertyUnit", unnest(['', 'r1 | r2', '', '', '']) AS "Reference" FROM part""",
)
def e13(spark, sf):
    return payloads.extract_json_sections(view(spark, sf, "section_payloads")).drop("section_no")


_PAYLOAD_ROWS = f"""
  (SELECT CAST(p_partkey AS VARCHAR) AS CID, 'K' || p_partkey AS InChIKey, p_name AS PubChemName, '' AS PubChem_URL, 'PubChem' AS Source,
    '' AS Section, '' AS Subsection, "PropertyName", CASE WHEN "PropertyUnit" <> '' AND ends_with("PropertyValue", ' ' || "PropertyUnit")
      THEN trim(left("PropertyValue", length("PropertyValue") - length("PropertyUnit") - 1)) ELSE "PropertyValue" END AS "PropertyValue",
    "PropertyUnit", "Reference", '' AS Method, '' AS Comment, '' AS Condition, '' AS ReactionEquation, '' AS SourceURL
  FROM (SELECT p_partkey AS k, * EXCLUDE (p_partkey) FROM ({REGISTRY["e13_extract_json_sections"].sql})) JOIN part ON p_partkey = k
  UNION ALL SELECT CAST(page_id % 300 AS VARCHAR), coalesce('K' || p_partkey, ''), coalesce(p_name, ''), '', 'NIST', 'Phase', 'Phase data',
    "PropertyName", "PropertyValue", "PropertyUnit", "Reference", "Method", '', "Condition", "ReactionEquation", 'http://p/' || r.page_id
  FROM ({REGISTRY["e10_extract_html_tables"].sql}) r LEFT JOIN part ON p_partkey = r.page_id % 300)"""


def payload_rows(spark, sf):
    entities = table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("CID"), F.concat(F.lit("K"), F.col("p_partkey").cast("string")).alias("InChIKey"),
        F.col("p_name").alias("PubChemName"), F.lit("").alias("PubChem_URL"),
    )
    sections = view(spark, sf, "section_payloads").withColumn("CID", F.col("p_partkey").cast("string")).drop("p_partkey")
    pages = view(spark, sf, "table_pages").select(
        (F.col("page_id") % 300).cast("string").alias("CID"), F.concat(F.lit("http://p/"), F.col("page_id").cast("string")).alias("url"),
        F.lit("Phase data").alias("title"), "html",
    )
    return measurements(entities, sections, pages)


@register("e10_payload_measurements", f"SELECT * FROM {_PAYLOAD_ROWS}")
def e10_measurements(spark, sf):
    return payload_rows(spark, sf).drop("ordinal")


@register(
    "w06_payloads_to_wide",
    f"""WITH {CLEAN.replace(duck('measurements'), '(SELECT 0 AS ordinal, * FROM ' + _PAYLOAD_ROWS + ')')}
    SELECT CID, name, unnest(['Median', 'Count', 'IQR']) AS stat, unnest([median, n::DOUBLE, iqr]) AS value FROM (
      SELECT CID, StandardPropertyName AS name, median(NumericValue) AS median, count(*) AS n,
        quantile_cont(NumericValue, 0.75) - quantile_cont(NumericValue, 0.25) AS iqr FROM rows_ GROUP BY ALL)""",
    "value",
)
def w06(spark, sf):
    """Landed pages and payloads, through the cleaning job, to the wide table."""
    wide = clean(payload_rows(spark, sf), min_coverage=0.0)["ml"]
    columns = [F.col(f"`{c}`").cast("double").alias(c) for c in wide.columns if c != "CID"]
    long = wide.select("CID", *columns).unpivot("CID", [f"`{c}`" for c in wide.columns if c != "CID"], "column", "value")
    name = r"^(.*)_(Median|Count|IQR)$"
    return long.where("value IS NOT NULL").select(
        "CID", F.regexp_extract("column", name, 1).alias("name"), F.regexp_extract("column", name, 2).alias("stat"), "value"
    )


_DIV_SQL = """SELECT o_orderkey AS page_id, 'Priority' AS "PropertyName", o_orderpriority || ' & more' AS "PropertyValue",
  '' AS "PropertyUnit", 'r' || CAST(o_custkey AS VARCHAR) AS "Reference" FROM orders
  UNION ALL SELECT o_orderkey, 'Key', CAST(o_orderkey AS VARCHAR), '', '' FROM orders WHERE o_orderkey % 2 = 0"""


@register("e14_extract_div_rows", _DIV_SQL)
def e14(spark, sf):
    return P.extract_div_rows(view(spark, sf, "div_pages")).drop("place")


@register(
    "e14_prefer_first",
    f"""SELECT CASE WHEN o_orderstatus = 'F' THEN o_orderkey ELSE -1 - o_orderkey END AS page_id, 'Json' AS "PropertyName",
      o_orderstatus AS "PropertyValue", '' AS "PropertyUnit", 'j' AS "Reference" FROM orders UNION ALL
    SELECT * FROM ({_DIV_SQL}) WHERE page_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
)
def e14_prefer(spark, sf):
    # Orders of another status bring a page of their own, so that their other rows stay.
    best = table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")).otherwise(-1 - F.col("o_orderkey")).alias("page_id"), F.lit("Json").alias("PropertyName"),
        F.col("o_orderstatus").alias("PropertyValue"), F.lit("").alias("PropertyUnit"),
        F.lit("j").alias("Reference"),
    )
    return P.prefer_first(best, e14(spark, sf), "page_id")


@register(
    "e15_resolve_identity",
    """SELECT p_partkey, CASE WHEN bare THEN '' WHEN s4 <> '77' THEN s4 WHEN p_partkey % 5 = 0 THEN '' ELSE s1 END AS name,
      CASE WHEN bare THEN reg ELSE s2 END AS cas FROM (SELECT * FROM """
    + duck("synonyms")
    + ")",
)
def e15(spark, sf):
    rows = view(spark, sf, "synonyms")
    synonyms = F.when(F.col("bare"), F.array().cast("array<string>")).otherwise(
        F.array("s1", "s2", "s3", "s4")
    )
    shaped = rows.select(
        "p_partkey", synonyms.alias("synonyms"), F.array("reg").alias("registry_numbers")
    )
    return payloads.resolve_identity(shaped)


@register(
    "e16_extract_activities",
    """SELECT o_orderkey, 0 AS place, 'ChEMBL' AS "Source", 'A' || CAST(o_custkey % 9 AS VARCHAR) AS "AssayID",
      'T' || CAST(o_custkey AS VARCHAR) AS "Target", 'IC50' AS "ActivityType", o_orderkey + 0.5 AS "Value", 'nM' AS "Unit",
      '=' AS "Relation", CASE WHEN o_orderkey % 3 <> 0 THEN 7.25 END AS "pChemblValue", 'D1' AS "Reference",
      NULL::VARCHAR AS "AssayDescription", 'http://a/A' || CAST(o_custkey % 9 AS VARCHAR) AS "URL" FROM orders
    UNION ALL SELECT o_orderkey, 1, 'ChEMBL', CAST(o_custkey AS VARCHAR), '', NULL, NULL, NULL, NULL, NULL, '7', NULL, '' FROM orders""",
    "Value,pChemblValue",
    "place",
)
def e16(spark, sf):
    return payloads.extract_activities(view(spark, sf, "activity_payloads"), assay_url="http://a/")


@register(
    "e17_extract_mentions",
    """SELECT o_orderkey, 0 AS place, 'IC50' AS "ActivityType", (1000 + o_custkey) * 10 + 5.0 AS "Value", 'nM' AS "Unit",
      ((1000 + o_custkey) * 10 + 5.0) * 1e-9 * 1e9 AS "Value_nM" FROM orders
    UNION ALL SELECT o_orderkey, 1, 'KI', o_orderkey + 0.25, 'uM', (o_orderkey + 0.25) * 1000 FROM orders
    UNION ALL SELECT o_orderkey, 3, 'EC50', o_custkey, '', NULL FROM orders""",
    "Value,Value_nM",
    "place",
    digits=3,
)
def e17(spark, sf):
    rows = P.extract_mentions(view(spark, sf, "mention_pages"))
    return rows.withColumn("Value_nM", F.col("Value_M") * 1e9).drop("Value_M")


# --- E18..E21 -----------------------------------------------------------------------------

_PHRASE = literal(D.ENERGY_PHRASE)

@register(
    "e18_mine_phrases",
    f"""SELECT doc_id, coalesce(string_agg(phrase, ' | ' ORDER BY pos) FILTER (WHERE rn <= 5), '') AS phrases,
      count(phrase) > 0 AS has_match FROM (SELECT d.doc_id, phrase, pos, row_number() OVER (PARTITION BY d.doc_id ORDER BY pos) AS rn
      FROM documents d LEFT JOIN (SELECT doc_id, phrase, min(pos) AS pos FROM (SELECT doc_id,
          unnest(list_transform(regexp_extract_all(text, {_PHRASE}, 1), lambda x: trim(x))) AS phrase,
          generate_subscripts(regexp_extract_all(text, {_PHRASE}, 1), 1) AS pos FROM {duck('articles')})
        GROUP BY ALL) p ON p.doc_id = d.doc_id) GROUP BY doc_id""",
)
def e18(spark, sf):
    rows = literature.mine_phrases(view(spark, sf, "articles"))
    return rows.select("doc_id", F.array_join("phrases", " | ").alias("phrases"), "has_match")


@register(
    "e19_literature_summary",
    f"""WITH a AS (SELECT * FROM {duck('articles')}),
    p AS (SELECT source, phrase, min(doc_id * 1000 + pos) AS k FROM (SELECT source, doc_id,
        unnest(list_transform(regexp_extract_all(text, {_PHRASE}, 1), lambda x: trim(x))) AS phrase,
        generate_subscripts(regexp_extract_all(text, {_PHRASE}, 1), 1) AS pos FROM a) GROUP BY ALL),
    e AS (SELECT source, string_agg(phrase, ' | ' ORDER BY k) AS examples FROM (
        SELECT *, row_number() OVER (PARTITION BY source ORDER BY k) AS rn FROM p) WHERE rn <= 5 GROUP BY source)
    SELECT a.source, count(*) AS documents, count(*) FILTER (WHERE regexp_matches(text, {_PHRASE})) AS matching,
      count(*) FILTER (WHERE regexp_matches(text, '(?i)supplementary|supporting information|supplemental')) AS supplementary,
      coalesce(any_value(examples), '') AS examples FROM a LEFT JOIN e ON e.source = a.source GROUP BY a.source""",
)
def e19(spark, sf):
    return literature.literature_summary(view(spark, sf, "articles"), "source", "doc_id")


@register(
    "e20_interleave",
    """SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY
      coalesce(CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END, 0), c_custkey) AS round FROM customer""",
)
def e20(spark, sf):
    rows = table(spark, sf, "customer").select(
        "c_mktsegment", "c_custkey",
        F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("weight"),
    )
    return S.interleave(rows, "c_mktsegment", "weight", "c_custkey").drop("weight")


_RING = "CAST(o_custkey * 7 % 3000 AS STRING)"


@register(
    "e21_canonical_cycles",
    f"""SELECT list_min(list_concat(list_transform(range(length(s)), lambda i: s[i + 1:] || s[:i]),
        list_transform(range(length(s)), lambda i: reverse(s)[i + 1:] || reverse(s)[:i]))) AS ring, count(*) AS sequences
    FROM (SELECT {_RING} AS s FROM orders) GROUP BY 1""",
)
def e21(spark, sf):
    rows = table(spark, sf, "orders").select(F.split(F.expr(_RING), "").alias("ring"))
    return S.canonical_cycles(rows, "ring").withColumn("ring", F.array_join("ring", ""))


@register(
    "e21_cycle_predicates",
    f"""SELECT o_orderkey, length(s) >= 2 AND regexp_matches(s || s[1], '11|22|12|21') AS forbidden,
      least(coalesce(list_max(list_transform(regexp_extract_all(s || s, '1+'), lambda x: length(x))), 0), length(s)) AS run
    FROM (SELECT o_orderkey, {_RING} AS s FROM orders)""",
    ints="run",
)
def e21_predicates(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.split(F.expr(_RING), "").alias("ring"))
    pairs = [("1", "1"), ("2", "2"), ("1", "2")]
    return rows.select(
        "o_orderkey", S.has_forbidden_neighbours("ring", pairs).alias("forbidden"),
        S.max_cyclic_run("ring", "1").alias("run"),
    )
