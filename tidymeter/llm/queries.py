"""Registered queries opN_<name>: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidymeter.llm import (
    backoff_lm, decontaminate, lexical, line_rules, manifest, mixing, ngram_join, packing, quality, secrets, sharding,
    surrogates, toxicity,
)
from tidymeter.llm.oracles import ORACLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in ORACLES.items() if name in QUERIES}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@register
def op1_toxicity_chain(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    labels = table(spark, sf, "labels").filter("toxic IS NOT NULL").join(documents.select("doc_id", "lang"), "doc_id")
    chain = toxicity.train(documents, labels, TOXIC_CATEGORIES)
    done = toxicity.score(documents, chain)
    return done.withColumn("flagged", F.col("toxic") >= 0.5)


#: Toxicity by language first, then over all.
TOXIC_CATEGORIES = {f"toxic_{x}": f"toxic = 1 AND lang = '{x}'" for x in ("en", "de", "fr", "es")} | {"toxic": "toxic = 1"}


@register
def op2_line_rules(spark: SparkSession, sf: str) -> DataFrame:
    done = line_rules.judge(table(spark, sf, "documents").select("doc_id", "text"))
    return done.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_good_lines", "lost_chars",
    )


@register
def op3_minimax_shards(spark: SparkSession, sf: str) -> DataFrame:
    done = sharding.shard(table(spark, sf, "documents"))
    return done.select(
        "doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


@register
def op4_pattern_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"))


@register
def op5_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.link(table(spark, sf, "documents"))


@register
def op6_shrunk_qda(spark: SparkSession, sf: str) -> DataFrame:
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    labels = table(spark, sf, "labels").filter((fold != 0) & F.col("quality").isNotNull())
    done = quality.classify(table(spark, sf, "documents"), labels.select("doc_id", F.col("quality").alias("label")))
    return done.select(
        "doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    )


@register
def op7_backoff_lm(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    done = backoff_lm.score(documents.withColumn("train", ~held_out), train_col="train")
    return done.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score",
    )


@register
def op8_markov_secrets(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents").select("doc_id", "text")
    done = secrets.scan(documents, secrets.fit(documents))

    def n(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return done.select(
        "row.doc_id", n("assign"), n("access"), n("hex"),
        F.sha2(secrets.digest("base"), 256).alias("base_sha256"),
        secrets.digest("spans").alias("spans"),
    )


@register
def op9_suffix_automaton(spark: SparkSession, sf: str) -> DataFrame:
    done = decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256)
    return done.select("doc_id", "n_words", "n_hit", "n_items", items.alias("items_sha256"), "contaminated")


@register
def op10_surrogates(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents").select("doc_id", "text")
    return surrogates.pseudonymise(documents, key="query-key")


@register
def op11_source_schedule(spark: SparkSession, sf: str) -> DataFrame:
    done = mixing.taken(mixing.mix(table(spark, sf, "documents")))
    return done.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@register
def op12_pointer_proofs(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    values = {c: F.col(c) for c in manifest.FIELDS}
    cut = manifest.leaf_hash(*(values | {"text": F.translate("text", "\n", "")}).values())
    leaf = manifest.leaf_hash(*values.values())
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    done = manifest.verify(manifest.prove(documents, leaf, F.when(tampered, cut).otherwise(leaf)))
    return done.withColumnRenamed("id", "doc_id")


@register
def op13_best_positions(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
