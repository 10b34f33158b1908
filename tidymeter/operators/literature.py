"""Phrase mining in documents and its roll-up per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidymeter import dictionaries as D
from tidymeter.functions.text import as_col, strip
from tidymeter.session import materialize


def phrases(text, pattern: str = D.ENERGY_PHRASE, limit: int = 5) -> Column:
    """The first distinct matches of group 1, at most ``limit``."""
    found = F.regexp_extract_all(as_col(text), F.lit(pattern), F.lit(1))
    return F.slice(F.array_distinct(F.transform(found, lambda s: strip(s))), 1, limit)


def mine_phrases(
    docs: DataFrame, text: str = "text", pattern: str = D.ENERGY_PHRASE, limit: int = 5
) -> DataFrame:
    """Phrases and a hit flag per document; the text itself is dropped."""
    kept = [c for c in docs.columns if c != text]
    return docs.select(*kept, phrases(text, pattern, limit).alias("phrases")).withColumn(
        "has_match", F.size("phrases") > 0
    )


def literature_summary(
    docs: DataFrame,
    entity: str,
    ordinal: str,
    text: str = "text",
    pattern: str = D.ENERGY_PHRASE,
    supplement: str = D.SUPPLEMENT_PATTERN,
    limit: int = 5,
) -> DataFrame:
    """Per entity: documents, matching documents, example phrases, supplementary mentions.

    Examples are the first distinct phrases in document order. They are reduced
    per (entity, phrase) and cut to the limit before the shuffle, so an entity
    with a third of all documents never gathers in one task.
    """
    body = strip(F.coalesce(text, F.lit("")))
    # Written once: both aggregations below read these few columns, the texts are mined once.
    work = materialize(
        docs.select(
            entity, ordinal, phrases(text, pattern, limit).alias("_found"),
            (body.rlike(supplement)).alias("_extra"),
        ),
        "phrases",
    )
    counts = work.groupBy(entity).agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.size("_found") > 0).alias("matching"),
        F.count_if("_extra").alias("supplementary"),
    )
    first = (
        work.select(entity, ordinal, F.posexplode("_found").alias("_pos", "phrase"))
        .groupBy(entity, "phrase")
        .agg(F.min(F.struct(ordinal, "_pos")).alias("_at"))
    )
    top = W.partitionBy(entity).orderBy("_at")
    examples = (
        first.withColumn("_rn", F.row_number().over(top))
        .where(F.col("_rn") <= limit)
        .groupBy(entity)
        .agg(F.array_sort(F.collect_list(F.struct("_rn", "phrase"))).alias("_list"))
        .select(
            entity,
            F.array_join(F.transform("_list", lambda s: s["phrase"]), " | ").alias("examples"),
        )
    )
    return counts.join(examples, entity, "left").withColumn(
        "examples", F.coalesce("examples", F.lit(""))
    )
