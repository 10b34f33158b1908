"""Empty tables, nulls, empty and long texts, repeated rows and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from tidymeter.llm import (
    backoff_lm, decontaminate, line_rules, ngram_join, packing, quality, secrets, sharding, surrogates, toxicity,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, row string, name string"


@pytest.fixture(scope="module")
def odd(spark):
    long_text = " ".join(f"word{i} and then." for i in range(12_000))
    rows = [
        (1, "Plain words in a line that ends. " * 8, "en", "a", 5, 1, "x", "n"),
        (2, None, None, None, None, None, None, None),
        (3, "", "en", "a", 0, 2, "x", "n"),
        (4, " \n\t ", "en", "a", 4, 2, "x", "n"),
        (5, long_text, "en", "a", 4, 2, "x", "n"),
        (6, "Plain words in a line that ends. " * 8, "en", "a", 5, 1, "x", "n"),
        (6, "Plain words in a line that ends. " * 8, "en", "a", 5, 1, "x", "n"),
        (None, "no id here", "en", "a", 5, 1, "x", "n"),
        (7, "ключ Ünïcödé \U0001f600 text", "ru", "a", 5, 1, "x", "n"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bench(spark, rows=((1, "alpha beta"), (2, None), (None, "gamma"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (5, 1, None), (None, None, None)], "doc_id long, quality int, toxic int")


CASES = {
    "toxicity": lambda s, d: toxicity.score(d, toxicity.train(d, labels(s).filter("toxic IS NOT NULL"), {"toxic": "toxic = 1"})),
    "line_rules": lambda s, d: line_rules.judge(d),
    "sharding": lambda s, d: sharding.shard(d),
    "ngram_join": lambda s, d: ngram_join.link(d),
    "quality": lambda s, d: quality.classify(d, labels(s).select("doc_id", F.col("quality").alias("label"))),
    "backoff_lm": lambda s, d: backoff_lm.score(d.withColumn("train", F.col("doc_id") % 2 == 1)),
    "secrets": lambda s, d: secrets.scan(d, secrets.fit(d)),
    "redact": lambda s, d: secrets.redact(d, secrets.fit(d)),
    "contamination": lambda s, d: decontaminate.contamination(d, bench(s)),
    "surrogates": lambda s, d: surrogates.pseudonymise(d, "k"),
}


@pytest.mark.parametrize("name", CASES)
def test_one_result_per_row(spark, odd, name):
    assert len(CASES[name](spark, odd).collect()) == odd.count()


@pytest.mark.parametrize("name", [*CASES, "pack"])
def test_empty_table(spark, empty, name):
    run = CASES.get(name, lambda s, d: packing.pack_documents(d))
    assert run(spark, empty).collect() == []


def test_pipeline_stages_on_odd_rows(spark, odd):
    kept = line_rules.clean(odd)
    assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.collect()} == {5}
    one = ngram_join.deduplicate(odd)
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in one.collect())
    assert [i for _, i in ids] == [1, 2, 3, 4, 5, 7, 0]
    clean = decontaminate.decontaminate(odd, bench(spark, [(1, "no id here")]))
    assert clean.columns == odd.columns and clean.count() == odd.count() - 1
    assert packing.pack_documents(odd).select("doc_id", "piece").distinct().count() >= odd.count() - 1


def test_values_of_empty_texts(spark, odd):
    r = {x["row"]["doc_id"]: x for x in line_rules.judge(odd).collect()}
    for k in (2, 3, 4):
        assert (r[k]["n_words"], r[k]["word_chars"], r[k]["base_failed"], r[k]["kept"]) == (0, 0, True, False)
    links = {x["doc_id"]: x for x in ngram_join.link(odd).collect()}
    assert links[2]["n_shingles"] == 0 and links[2]["component_id"] == 2
    assert links[6]["component_id"] == 1 and links[1]["component_id"] == 1
    sizes = {x["doc_id"]: x for x in sharding.shard(odd).collect()}
    assert sizes[2]["size"] == sizes[3]["size"] == 1 and sizes[2]["text_crc32"] == 0
