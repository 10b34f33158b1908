"""Secrets without a label: however many the corpus holds, of 8 characters and more, and around fixed patterns."""

import random
import string

from pyspark.sql import functions as F

from tidymeter.llm import secrets

WORDS = "the quick brown fox jumps over lazy dogs while seven wizards from another kingdom carefully examine documents".split()


def key(rng, n):
    return "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))


def found(spark, model, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = secrets.scan(df, model).select("row.doc_id", F.expr("filter(spans, s -> s.kind = 'markov')").alias("m")).collect()
    return {r["doc_id"]: [s["value"] for s in r["m"]] for r in rows}


def test_unlabelled_keys_do_not_train_the_identifiers(spark):
    rng = random.Random(5)
    prose = [" ".join(rng.choice(WORDS) for _ in range(30)) + f". token={key(rng, 24)}" for _ in range(100)]
    lines = [key(rng, 40) for _ in range(400)]
    model = secrets.fit(spark.createDataFrame(list(enumerate(prose + lines)), "doc_id long, text string"))
    fresh = [key(rng, 32) for _ in range(20)]
    short = ["login " + key(rng, 10) for _ in range(20)]
    hexed = "0123456789abcdef" * 2
    whole = key(rng, 12) + "Z" + hexed + "Q" + key(rng, 12)
    plain = ["carefully examine_documents wizards-kingdom 2024010112 WIZARDS anotherKingdom"]
    got = found(spark, model, fresh + short + [whole] + plain)
    assert sum(got[i] == [fresh[i]] for i in range(20)) == 20
    assert sum(len(got[20 + i]) == 1 for i in range(20)) >= 18
    assert got[40] == [whole]
    assert got[41] == []
