"""Small cases with values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tidymeter import dictionaries as D
from tidymeter.functions import numeric as N, text as X, units as U
from tidymeter.operators import activity as A, cleaning as C, combine as J, logs as L, pages as P, payloads, sequences as S, wide as W
from tidymeter.plans.clean import clean, frequent_and_sparse


def value(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "prop,number,unit,expected",
    [
        ("Tb", 100.0, "C", 373.15), ("Hvap", 50000.0, "J/mol", 50.0), ("MW", 180.0, "Da", 180.0),
        ("LogP", 2.5, None, 2.5), ("MW", 180.0, None, 180.0), ("Tb", 50.0, "kJ/mol", None),
        ("Tb", None, "K", None), ("Other", 3.0, "furlong", 3.0),
    ],
)
def test_canonical(spark, prop, number, unit, expected):
    df = spark.createDataFrame([(prop, number, unit)], "StandardPropertyName string, NumericValue double, CleanUnit string")
    assert C.to_canonical(df).first()["NumericValue"] == expected
    got = df.select(U.canonical_value("StandardPropertyName", "NumericValue", "CleanUnit").alias("v")).first()["v"]
    assert got == expected


def test_mixed_units_median(spark):
    df = spark.createDataFrame(
        [("1", "Tb", 100.0, "C", "PubChem", None, 0), ("1", "Tb", 373.0, "K", "NIST", "r", 1)],
        "CID string, StandardPropertyName string, NumericValue double, CleanUnit string, Source string, Reference string, ordinal int",
    )
    row = C.dedup_measurements(C.to_canonical(df)).first()
    assert row["NumericValue"] == pytest.approx(373.075)
    assert row["Source"] == "NIST"


def test_bounds(spark):
    df = spark.createDataFrame(
        [("MW", 180.0), ("MW", 5000.0), ("Tb", 5e9), ("Any", 1e6), ("MW", None)],
        "StandardPropertyName string, NumericValue double",
    )
    kept = {(r[0], r[1]) for r in C.apply_bounds(df).collect()}
    assert kept == {("MW", 180.0), ("Any", 1e6), ("MW", None)}


def test_coverage_split(spark):
    df = spark.createDataFrame(
        [("1", "MW", 1.0), ("2", "MW", 2.0), ("3", "MW", 3.0), ("1", "Rare", 9.0)],
        "CID string, StandardPropertyName string, NumericValue double",
    )
    frequent, sparse = frequent_and_sparse(df, 0.5)
    assert frequent.count() == 3 and sparse.count() == 1
    assert "MW_Median" in W.pivot_ml(frequent).columns and "Rare_Median" in W.pivot_ml(sparse).columns


def test_empty_pivot_has_only_the_id(spark):
    df = spark.createDataFrame([], "CID string, StandardPropertyName string, NumericValue double")
    assert W.pivot_ml(df).columns == ["CID"]


@pytest.mark.parametrize(
    "text,expected",
    [("about -1.5e3 K", -1500.0), (".5", 0.5), ("none", None), ("", None), (None, None), ("12,5", 12.0)],
)
def test_extract_numeric(spark, text, expected):
    assert value(spark, X.extract_numeric(F.lit(text).cast("string"))) == expected


@pytest.mark.parametrize(
    "unit,expected",
    [("°C", "C"), (" K ", "K"), ("J/mol*K", "J/mol/K"), ("Å²", "A2"), ("degC", "C"), ("kcal/mol", "kcal/mol"),
     ("weird Unit", "weird Unit"), ("  ", None)],
)
def test_clean_unit(spark, unit, expected):
    assert value(spark, U.clean_unit(F.lit(unit))) == expected


def test_infer_unit_prefers_the_longest(spark):
    assert value(spark, U.infer_unit(F.lit("5 J/mol*K"))) == "J/mol/K"
    assert value(spark, U.infer_unit(F.lit("5 J/mol*K"), legacy=True)) == "K"


def test_strip_all_white_space(spark):
    assert value(spark, X.strip(F.lit("\t  a b \n"))) == "a b"
    assert value(spark, X.collapse_ws(F.lit(" a \t\n b c "))) == "a b c"


@pytest.mark.parametrize("text,expected", [("5 (K)", ("5", "K")), ("-1.2e3 kJ/mol", ("-1.2e3", "kJ/mol")), ("x y", ("x y", "")), ("", ("", ""))])
def test_split_value_unit(spark, text, expected):
    got = value(spark, X.split_value_unit(F.lit(text)))
    assert (got["value"], got["unit"]) == expected


def test_slug_and_targets(spark):
    assert value(spark, X.slugify(F.lit("ChEMBL:IC50 [a/b]"))) == "ChEMBL_IC50_a_b"
    assert X.is_target_name("Kinetics") and not X.is_target_name("Kinetics", strict=True)
    assert not X.is_target_name("ChEMBL:", strict=True)


def test_energies(spark):
    lam = value(spark, N.reorganization(F.lit(-10.0), F.lit(-10.1), F.lit(-9.0), F.lit(-9.05)))
    assert (lam["lambda1"], lam["lambda2"], lam["total"]) == pytest.approx((0.1, 0.05, 0.15))
    missing = value(spark, N.reorganization(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0)))
    assert missing["total"] is None and missing["lambda2"] is None
    assert value(spark, N.activation(F.lit(0.2), F.lit(-0.1))) == pytest.approx(0.0125)
    assert value(spark, N.activation(F.lit(0.2), F.lit(-0.2))) == pytest.approx(0.0)
    assert value(spark, N.activation(F.lit(0.0), F.lit(-0.1))) is None


def test_row_filters(spark):
    rows = [
        ("Value", "1", "r"), ("x", " x ", "r"), ("Odor", "sweet", "r"), ("Tb", "For more data", "r"),
        ("Tb", "www.x.org", "r"), ("Tb", "HSDB:1", "r"), ("Tb", None, "r"), ("Tb", "5 K", None), (None, None, None),
    ]
    base = spark.createDataFrame(rows, "PropertyName string, PropertyValue string, Reference string")
    extra = [c for c in C.CONTENT_COLUMNS if c not in base.columns]
    df = base.withColumns({c: F.lit(None).cast("string") for c in extra})
    kept = C.drop_garbage(C.drop_categories(C.drop_artifacts(df))).select("PropertyName", "PropertyValue").collect()
    assert [tuple(r) for r in kept] == [("Tb", None), ("Tb", "5 K")]


def test_null_reference_stays_null(spark):
    df = spark.createDataFrame([(" ", None)], "Reference string, Method string")
    assert tuple(C.normalize_text(df, ["Reference", "Method"]).first()) == (None, None)


def test_pipeline_keeps_replicates_by_default(spark, sf):
    from tidymeter.catalog.base import view

    tables = clean(view(spark, sf, "measurements"))
    assert tables["summary"].agg(F.max("count")).first()[0] > 1
    legacy = clean(view(spark, sf, "measurements"), legacy=True)
    assert legacy["summary"].agg(F.max("count")).first()[0] == 1


def test_qc_partitions_the_input(spark, sf):
    from tidymeter.catalog.activity import assays

    level = assays(spark, sf)
    passing, rejected = A.assay_qc(level)
    assert passing.count() + rejected.count() == level.count()


def test_activity_rules(spark):
    rows = [
        ("1", "S", "a", "t", "IC50", "5", "7.5", "="), ("1", "S", "a", "t", "IC50", "5", "bad", "="),
        ("1", "S", "a", "t", "IC50", "-5", "", "="), ("1", "S", "a", "t", "IC50", "5", "", ">"),
        (" ", "S", "a", "t", "IC50", "5", "", "="), ("2", "S", None, None, "Ki", "3", None, None),
    ]
    df = spark.createDataFrame(
        rows, "CID string, Source string, AssayID string, TargetName string, ActivityType string, Value string, pChemblValue string, Relation string"
    ).withColumn("Target", F.lit(None).cast("string"))
    got = {tuple(r) for r in A.activity_features(df).collect()}
    assert got == {
        ("1", "S:pActivity [t]", "a", 7.5), ("1", "S:IC50 [t]", "a", 5.0), ("2", "S:Ki [Unchecked]", "NO_ASSAY", 3.0),
    }
    assert A.activity_features(df, legacy=True).count() == 2


def test_descriptors(spark, freq_log):
    df = spark.createDataFrame([("5", freq_log), ("6", freq_log.replace("Normal termination", "x"))], "CID string, text string")
    rows = L.extract_descriptors(df).collect()
    assert len(rows) == 1
    got = rows[0].asDict()
    assert [got[c] for c in D.DESCRIPTORS] == pytest.approx(
        [-154.062345678, 0.123456, 0.131234, 0.132178, 0.098765, -154.123456, -154.11, -154.15, 75.0, 298.15, 0, 100.0, 6]
    )


def test_thermo_reads_every_row(spark, freq_log):
    got = L.extract_thermo(spark.createDataFrame([(freq_log,)], "text string")).first()
    assert got["zpe"] == pytest.approx(0.123456 * 627.509474)
    assert (got["temp"], got["ts"], got["cv"], got["ts_trans"], got["cv_vib"]) == (298.15, 75.0, 20.0, 40.0, 14.0)


def test_steps_and_criteria(spark, opt_log):
    df = spark.createDataFrame([("p", opt_log), ("q", "nothing")], "path string, text string")
    steps = L.extract_steps(df).orderBy("step").collect()
    assert [s["step"] for s in steps] == [1, 2]
    assert steps[1]["energy"] == -154.062 and steps[1]["max_force"] == 0.0004
    assert steps[1]["delta_e"] == pytest.approx(-0.012) and steps[0]["delta_e"] == 0.0
    last = L.extract_criteria(df).where("step = 2").collect()
    assert len(last) == 4 and all(r["all_converged"] and r["n_converged"] == 4 for r in last)


def test_state_rules(spark):
    df = spark.createDataFrame(
        [("5", "neutral", -154.15), ("5", "anion", -154.10), ("6", "neutral", -1.0)], "CID string, state string, gibbs_G double"
    )
    got = J.state_delta(df, columns=["gibbs_G"]).collect()
    assert len(got) == 1 and got[0]["delta_gibbs_G"] == pytest.approx(0.05)
    assert [r[0] for r in J.available_pairs(df).collect()] == ["5"]
    assert [r[0] for r in J.skipped_keys(df).collect()] == ["6"]


def test_newest_log_wins(spark, freq_log):
    df = spark.createDataFrame(
        [("5", freq_log.replace("-154.062345678", "-1.0"), 1000), ("5", freq_log, 2000), ("5", "broken", 3000)],
        "CID string, text string, mtime long",
    )
    assert L.newest_descriptors(df).first()["scf_energy"] == -154.062345678


def test_html_table_with_conditions(spark):
    page = (
        "<h2>Phase</h2><p>x = y</p><table class='data'><tr><th>Tc (K)</th><th>Method</th><th>Temperature</th></tr>"
        "<tr><td>5 (C)</td><td>N/A &amp; b</td><td>300</td></tr></table>"
    )
    row = P.extract_html_tables(spark.createDataFrame([(1, page)], "page_id int, html string")).first()
    assert (row["PropertyName"], row["PropertyValue"], row["PropertyUnit"]) == ("Tc", "5", "C")
    assert (row["Condition"], row["Method"], row["ReactionEquation"]) == ("Temperature=300", "N/A & b", "x = y")


def test_json_nested_headings(spark):
    payload = (
        '{"Record":{"Section":[{"TOCHeading":"Chemical and Physical Properties","Section":[{"TOCHeading":"Computed Properties",'
        '"Section":[{"TOCHeading":"MW","Information":[{"Value":{"Number":[78.11],"Unit":"g/mol"},"Reference":["a"," b "]}]}]}]}]}}'
    )
    rows = payloads.extract_json_sections(spark.createDataFrame([(1, payload), (2, "broken")], "id int, payload string")).collect()
    assert [(r["PropertyName"], r["PropertyValue"], r["PropertyUnit"], r["Reference"]) for r in rows] == [("MW", "78.11 g/mol", "g/mol", "a | b")]


def test_cycles(spark):
    df = spark.createDataFrame([(["n", "c", "c"],), (["c", "n", "c"],), (["c", "o", "n", "c"],)], "ring array<string>")
    got = {tuple(r["ring"]): r["sequences"] for r in S.canonical_cycles(df, "ring").collect()}
    assert got == {("c", "c", "n"): 2, ("c", "c", "n", "o"): 1}
    ring = F.array(*[F.lit(x) for x in "ncnn"])
    assert value(spark, S.max_cyclic_run(ring, "n")) == 3
    assert value(spark, S.has_forbidden_neighbours(ring, [("o", "n")])) is False


def test_conformers(spark):
    text = "1\n-1.0\nH 0 0 0\n1\n-1.001\nHe 0 0 0\n1\nconf -0.5 Eh\nNe 0 0 0\n2\n-9.0\ncut"
    rows = L.select_conformers(spark.createDataFrame([("a", text)], "f string, text string"), 5, 10.0).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2] and rows[0]["block"].startswith("1\n-1.001")
    assert rows[1]["rel_energy_kcal"] == pytest.approx(0.627509474)


@pytest.mark.parametrize(
    "text,expected",
    [
        ("a &amp; b", "a & b"), ("&amp;lt;", "&lt;"), ("&#176;C &#xb5;m &deg;", "°C µm °"), ("&#x1F600;", "\U0001f600"),
        ("&unknown; & &;", "&unknown; & &;"), ("", ""), (None, None),
    ],
)
def test_character_references(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(X.unescape("t").alias("v")).first()["v"] == expected


def _div(css, *inner):
    return f'<div class="{css}">' + "".join(inner) + "</div>"


ROW, CELL = "sm:table-row x", "y sm:table-cell"


@pytest.mark.parametrize(
    "page,expected",
    [
        (_div(ROW, *[_div(CELL, t) for t in ("n", " a <b>b</b>\n c ", "&lt;r&gt;")]), [("n", "a b c", "<r>")]),
        (_div(ROW, *[_div(CELL, t) for t in ("Property Name", "x", "y")]), []),
        (_div(ROW, *[_div(CELL, t) for t in ("two", "cells")]), []),
        ("</div></div>" + _div(ROW, *[_div(CELL, _div("z", t)) for t in "abc"]) + "tail", [("a", "b", "c")]),
        (_div(ROW, "<!-- </div> -->", *[_div(CELL, t) for t in "abcd"], "<script>'<div>'</script>"), [("a", "b", "c")]),
        (_div(CELL, "outside") + _div(ROW, *[_div(CELL, t) for t in "abc"]) * 2, [("a", "b", "c")] * 2),
        (_div(ROW, *[_div(CELL, t) for t in "ab"], _div("g", _div(ROW, *[_div(CELL, t) for t in "xyz"])), _div(CELL, "c")), [("a", "b", "c"), ("x", "y", "z")]),
        ("<div CLASS='sm:table-row'>" + "".join(f"<DIV class=sm:table-cell>{t}</DIV>" for t in "abc") + "</div>", [("a", "b", "c")]),
        (None, []), ("sm:table-row", []),
    ],
)
def test_div_rows(spark, page, expected):
    df = spark.createDataFrame([(1, page), (1, page)], "page_id int, html string")
    got = P.extract_div_rows(df)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    rows = sorted(tuple(r) for r in got.select("PropertyName", "PropertyValue", "Reference").collect())
    assert rows == sorted(expected * 2)


BASES = ["http://h.org/a/b/c.cgi?x=1", "https://h.org", "http://h.org/d/"]
ADDRESSES = ["", "x", "x/y?q=1#f", "./x", "../x", "../../../x", "a/../b/./c", "/r", "/r/../s", "//o.org/p", "?q=2", "#top", "http://z.org/a/../b", "mailto:a@b.c", "..", ".", "x/.."]


def test_addresses_as_seen_from_a_page(spark):
    from urllib.parse import urljoin

    df = spark.createDataFrame([(a,) for a in ADDRESSES], "a string")
    for base in BASES:
        got = {r["a"]: r["u"] for r in df.select("a", X.join_url(base, "a").alias("u")).collect()}
        assert got == {a: urljoin(base, a) for a in ADDRESSES}


def test_links_of_odd_markup(spark):
    page = (
        "<!-- <a href='/th-comment'>th</a> --><a name=x>th</a><A class=b HREF = '/th/1?a=1&amp;b=2'> <b>Thermo</b> &lt;data&gt;"
        "</a><script>'<a href=\"/th/s\">th</a>'</script><a href=/th/2>th<a href=\"/th/3\"></a><a href='/th/1?a=1&amp;b=2'>again th</a>"
    )
    df = spark.createDataFrame([(1, page), (2, None), (3, "<a href='/th/4'>open th")], "page_id int, html string")
    found = P.extract_links(df, "http://h.org/x", mask="/th", topics=["th"])
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [
        (1, "Thermo <data>", "http://h.org/th/1?a=1&b=2"), (1, "th", "http://h.org/th/2"), (3, "open th", "http://h.org/th/4"),
    ]
