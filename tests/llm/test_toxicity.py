"""Features come from all labelled rows, and each category has its own."""

from pyspark.sql import functions as F

from tidymeter.llm import toxicity


def test_features_of_all_labelled_rows(spark):
    """A word that no row of the fitting sample may hold is counted; a rare category keeps its word."""
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("plain words here "), F.when(F.col("id") % 400 == 7, "vileword").when(F.col("id") % 2 == 0, "badword").otherwise("calm")).alias("text"),
    )
    labels = docs.select("doc_id", (F.col("text").contains("vileword") | F.col("text").contains("badword")).cast("int").alias("toxic"),
                         F.col("text").contains("vileword").alias("rare"))
    chain = toxicity.train(docs, labels, {"rare": "rare", "toxic": "toxic = 1"}, features=2, max_rows=40)
    assert b"vileword" in chain.vocabulary and b"badword" in chain.vocabulary


def test_each_category_has_features(spark):
    rows = [(f"en{i % 5} " if i % 10 else "rareword ", int(i % 10 > 0 and i % 5 == 1), int(i % 10 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "text string, y0 int, y1 int")
    assert b"rareword" in toxicity._select(df, ["y0", "y1"], 1)
    assert b"en1" in toxicity._select(df, ["y0", "y1"], 1)
