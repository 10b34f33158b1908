"""Search against a full evaluation: ties, odd rows, many small blocks and portions."""

import collections
import math
import random
import re

import pytest

from tidymeter.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").encode().lower().decode())


def full(docs, items, top):
    own = [(i, collections.Counter(terms(t))) for i, t in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    n_docs, n_terms = len(own), sum(n for _, _, n in own)
    df = collections.Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in own:
            m = 50 + (50 * n * n_docs) // n_terms
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                for t in set(terms(text)) if t in c
            )
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, k, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def made(seed=3, n=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "ключ", "A1"]
    pick = lambda k: " ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=k))
    docs = [(i, pick(rng.randint(1, 40))) for i in range(n)]
    docs += [(n + i, docs[5][1]) for i in range(80)] + [(7, "second row of id 7 w3"), (None, "w1 w2"), (None, "w1 w2 w50")]
    docs += [(-1, None), (-2, ""), (-3, " .,- \n"), (-4, "w40 " * 20_000)]
    items = [(i, pick(12)) for i in range(8)] + [(8, None), (9, ""), (10, "unknown words"), (11, "W1, w1;w59"), (0, "w9 w8")]
    return docs, items


@pytest.mark.parametrize("top, block, block_terms", [(50, 2_000_000, 100_000), (5, 300, 100_000), (400, 50, 100_000), (10, 500, 40)])
def test_against_full_evaluation(spark, top, block, block_terms):
    docs, items = made()
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item string, score int")
    found = lexical.search(df, spark.createDataFrame(items, "item_id long, text string"), top, block_postings=block, block_terms=block_terms)
    assert sorted(map(tuple, found.collect()), key=str) == full(docs, items, top)


def test_string_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "y")], "doc_id string, text string")
    items = spark.createDataFrame([("i", "X")], "item_id string, text string")
    assert [tuple(r)[:3] for r in lexical.search(docs, items).orderBy("rank").collect()] == [("i", 1, "a"), ("i", 2, "b")]
    assert lexical.search(docs.limit(0), items).collect() == []
    assert lexical.search(docs, items.limit(0)).collect() == []


def test_stops_before_the_end(spark, monkeypatch):
    """A rare, weighty term decides the ranks: the long list of a light term is not read to its end."""
    import numpy as np

    n = 20_000
    terms_of = [np.array([0, 1]) if i % 200 == 0 else np.array([1]) for i in range(n)]
    ends = np.concatenate(([0], np.cumsum([len(t) for t in terms_of])))
    lists = lexical.Lists(np.full(n, 10), ends, np.concatenate(terms_of), np.ones(ends[-1], np.int64), 2, n, 10 * n)
    reads = []
    monkeypatch.setattr(lexical.np, "unique", lambda x, f=np.unique: reads.append(len(x)) or f(x))
    docs, _ = lists.best([(0, 9000), (1, 10)], 50, 0)
    assert docs.tolist() == list(range(0, 200 * 50, 200)) and sum(reads) < n / 2
