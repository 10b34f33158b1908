"""Queries of the scans and sinks: written from the given tables, read back, compared whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidymeter import dictionaries as D
from tidymeter.catalog import inputs  # noqa: F401
from tidymeter.catalog.base import VIEWS, duck, register, table, view
from tidymeter.operators import payloads
from tidymeter.session import scratch_path
from tidymeter.sources import readers, writers

_TOKENS = "('', 'NA', 'nan')"


@register(
    "s01_read_measurements",
    "SELECT "
    + ", ".join(f'CASE WHEN "{c}" NOT IN {_TOKENS} THEN "{c}" END AS "{c}"' for c in D.MEASUREMENT_COLUMNS)
    + f" FROM {duck('measurements')}",
)
def s01(spark, sf):
    path = scratch_path(spark, "measurements-csv")
    writers.write_table(view(spark, sf, "measurements").select(*D.MEASUREMENT_COLUMNS), path)
    return readers.read_measurements(spark, path).drop("ordinal")


VIEWS["assay_payloads"] = """
SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN '' END
  WHEN 'F' THEN 'PUBCHEM_SID,"PUBCHEM_ACTIVITY_OUTCOME", PUBCHEM_ACTIVITY_CONCENTRATION,PUBCHEM_ACTIVITY_CONCENTRATION_UNIT' || chr(10)
    || '1,Active,' || CAST(o_custkey AS STRING) || '.5,uM' || chr(10) || chr(10) || '2,"Inactive",bad' || chr(10)
  ELSE 'PUBCHEM_SID,PUBCHEM_ACTIVITY_CONCENTRATION' || chr(10) || '1,"' || CAST(o_orderkey AS STRING) || '"' END AS payload
FROM {orders}
"""


@register(
    "s02_parse_assay_csv",
    """SELECT o_orderkey, NULL::VARCHAR AS "ActivityType", NULL::DOUBLE AS "Value", NULL::VARCHAR AS "Unit", NULL::VARCHAR AS "Outcome", true AS is_stub
      FROM orders WHERE o_orderstatus = 'P'
    UNION ALL SELECT o_orderkey, 'Concentration', o_custkey + 0.5, 'uM', 'Active', false FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT o_orderkey, 'Concentration', NULL, '', 'Inactive', false FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT o_orderkey, 'Concentration', o_orderkey, '', '', false FROM orders WHERE o_orderstatus = 'O'""",
    "Value",
)
def s02(spark, sf):
    return payloads.parse_assay_csv(view(spark, sf, "assay_payloads")).drop("line_no")


@register(
    "s03_read_entity_ids",
    "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS CID FROM orders WHERE o_orderstatus <> 'P'",
)
def s03(spark, sf):
    path = scratch_path(spark, "ids-csv")
    key = F.when(F.col("o_orderstatus") == "P", F.lit("  ")).otherwise(
        F.concat(F.lit(" "), F.col("o_custkey").cast("string"))
    )
    writers.write_table(table(spark, sf, "orders").select(key.alias("CID"), "o_orderkey"), path)
    return readers.read_entity_ids(spark, path).select("CID")


@register(
    "s04_read_queries",
    """SELECT CASE WHEN p_partkey % 10 = 3 THEN p_brand ELSE p_name END AS query FROM part WHERE p_partkey % 10 NOT IN (0, 1)""",
)
def s04(spark, sf):
    path = scratch_path(spark, "queries-txt")
    line = F.expr(
        "CASE p_partkey % 10 WHEN 0 THEN 'SMILES,x' WHEN 1 THEN '  ' WHEN 3 THEN p_brand ELSE p_name || ',' || p_type END"
    )
    table(spark, sf, "part").select(line.alias("value")).write.text(path)
    return readers.read_queries(spark, path).select("query")


@register(
    "s05_union_activities",
    """SELECT 'A' AS "Source", CAST(o_custkey AS VARCHAR) AS "CID", o_totalprice AS "Value", NULL::VARCHAR AS "Outcome", NULL::DOUBLE AS "Value_M" FROM orders
    UNION ALL SELECT 'B', CAST(c_custkey AS VARCHAR), NULL, c_mktsegment, NULL FROM customer
    UNION ALL SELECT 'C', CAST(s_suppkey AS VARCHAR), s_acctbal, NULL, s_acctbal / 1000 FROM supplier""",
    "Value,Value_M",
)
def s05(spark, sf):
    a = table(spark, sf, "orders").select(
        F.lit("A").alias("Source"), F.col("o_custkey").cast("string").alias("CID"), F.col("o_totalprice").alias("Value")
    )
    b = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("CID"), F.lit("B").alias("Source"), F.col("c_mktsegment").alias("Outcome")
    )
    c = table(spark, sf, "supplier").select(
        F.lit("C").alias("Source"), F.col("s_suppkey").cast("string").alias("CID"), F.col("s_acctbal").alias("Value"),
        (F.col("s_acctbal") / 1000).alias("Value_M"),
    )
    return readers.union_activities(a, b, c)


@register(
    "s06_write_tables",
    " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, CAST(doc_id AS VARCHAR) AS doc_id, lang, md5(replace(text, chr(10), ' ')) AS digest FROM documents"
        for kind in ("csv", "tsv", "json", "parquet")
    ),
)
def s06(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), "lang", F.translate("text", "\n", " ").alias("text")
    )
    kinds = ["csv", "tsv", "json", "parquet"]
    paths = writers.write_tables({"docs": docs}, scratch_path(spark, "tables"), {"docs": kinds})
    out = None
    for kind in kinds:
        path = paths[f"docs.{kind}"]
        if kind in ("csv", "tsv"):
            back = readers._csv(spark, path, "\t" if kind == "tsv" else ",")
        else:
            back = spark.read.format(kind).schema("doc_id string, lang string, text string").load(path)
        part = back.select(F.lit(kind).alias("kind"), "doc_id", "lang", F.md5("text").alias("digest"))
        out = part if out is None else out.unionByName(part)
    return out


@register(
    "s07_read_logs",
    """SELECT CAST(l_suppkey AS VARCHAR) AS supplier, count(*) AS lines, sum(length('SCF Done ' || CAST(l_orderkey AS VARCHAR)) + 1)::BIGINT AS chars
    FROM lineitem GROUP BY 1""",
)
def s07(spark, sf):
    path = scratch_path(spark, "logs")
    text = F.concat(F.lit("SCF Done "), F.col("l_orderkey").cast("string")).alias("value")
    rows = table(spark, sf, "lineitem").select("l_suppkey", text)
    rows.repartition("l_suppkey").write.partitionBy("l_suppkey").text(path)
    logs = readers.read_logs(spark, path, "*.txt")
    return logs.select(
        F.regexp_extract("path", r"l_suppkey=(\d+)", 1).alias("supplier"),
        F.size(F.regexp_extract_all("text", F.lit("SCF Done"), F.lit(0))).cast("bigint").alias("lines"),
        F.length("text").cast("bigint").alias("chars"),
    )


@register(
    "s08_read_articles_xml",
    r"""SELECT CAST(doc_id AS VARCHAR) AS pmid, lang || ' & <' || source || '>' AS title,
      md5(trim(text, E' \n\r\t') || CASE WHEN doc_id % 2 = 0 THEN ' second' ELSE '' END) AS digest FROM documents""",
)
def s08(spark, sf):
    path = scratch_path(spark, "articles-xml")
    parts = F.when(F.col("doc_id") % 2 == 0, F.array("text", F.lit("second"))).otherwise(F.array("text"))
    article = F.struct(
        F.concat("lang", F.lit(" & <"), "source", F.lit(">")).alias("ArticleTitle"),
        F.struct(parts.alias("AbstractText")).alias("Abstract"),
    )
    citation = F.struct(F.col("doc_id").cast("string").alias("PMID"), article.alias("Article"))
    rows = table(spark, sf, "documents").select(citation.alias("MedlineCitation"))
    rows.write.format("xml").option("rowTag", "PubmedArticle").option("rootTag", "PubmedArticleSet").save(path)
    found = readers.read_articles_xml(spark, path)
    return found.select("pmid", "title", F.md5("abstract").alias("digest"))
