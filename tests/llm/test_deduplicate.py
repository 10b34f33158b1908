"""Near duplicates are told apart by id and text: null and repeated ids cost no unrelated text."""

import pytest

from tidymeter.llm import ngram_join

A, B, C, D, E = (" ".join(f"{w}{i}" for i in range(40)) for w in "abcde")


@pytest.mark.parametrize(
    "rows, kept",
    [
        # A null-id row with an id in its class goes; another without stays.
        ([(1, A), (None, A + " more"), (None, B), (None, C)], {(1, A), (None, B), (None, C)}),
        # One id on two texts: the copy goes, the other text stays.
        ([(1, A), (2, A + " more"), (2, B)], {(1, A), (2, B)}),
        # One id on two unlinked texts beside unlinked rows without id.
        ([(1, A), (1, B), (None, C), (None, D), (3, E), (3, E), (4, None), (4, None)],
         {(1, A), (1, B), (None, C), (None, D), (3, E), (4, None)}),
        # A class without any id keeps one row.
        ([(None, A), (None, A), (None, B)], {(None, A), (None, B)}),
    ],
)
def test_ids_do_not_decide_alone(spark, rows, kept):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in ngram_join.deduplicate(df).collect()]
    assert set(got) == kept
    assert len(got) == len(kept) + sum(r == (4, None) for r in rows) // 2


def test_columns_with_the_names_of_the_joins(spark):
    rows = [(i, t, "d", 2 * i, "k", "x", i) for i, t in enumerate((A, A + " more", B, B))]
    df = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, _digest string, _key_id long, key string, row string, id long")
    got = ngram_join.deduplicate(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == [rows[0], rows[2]]
