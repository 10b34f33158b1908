"""Trained operators against their formulas, worked out row by row without the operators' arrays."""

import collections
import math
import re

import duckdb
import numpy as np
import pytest

from tidymeter.llm import quality, queries, secrets, surrogates, toxicity


@pytest.fixture(scope="module")
def docs(sf):
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())


def test_discriminant_scores(spark, sf, docs):
    """Every score of op6 from class means and shrunk covariances, by solving instead of factoring."""
    import zlib

    labels = {i: q for i, q in duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall()
              if q is not None and zlib.crc32(str(i).encode()) % 5 and i in docs}
    x = {i: np.array(quality.statistics((t or "").encode())) for i, t in docs.items()}
    rows = {k: np.array([x[i] for i, q in labels.items() if q == k]) for k in (0, 1)}
    covariance = {k: (r - r.mean(axis=0)).T @ (r - r.mean(axis=0)) / len(r) for k, r in rows.items()}
    n = sum(map(len, rows.values()))
    pooled = sum(covariance[k] * len(rows[k]) for k in rows) / n
    shrunk = {k: (1 - quality.SHRINK) * c + quality.SHRINK * np.diag(np.maximum(np.diag(pooled), quality.FLOOR)) for k, c in covariance.items()}

    def density(v, k):
        gap = v - rows[k].mean(axis=0)
        return -0.5 * (gap @ np.linalg.solve(shrunk[k], gap) + np.linalg.slogdet(shrunk[k])[1]) + math.log(len(rows[k]) / n)

    for r in queries.op6_shrunk_qda(spark, sf).collect():
        v = x[r["doc_id"]]
        odds = density(v, 1) - density(v, 0)
        want = 1 / (1 + math.exp(-min(max(odds, -700), 700)))
        assert r["score"] == pytest.approx(want, rel=1e-6, abs=1e-9)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3)


def test_statistics_by_hand():
    text = "Hello, big big World! 42\n\nHello, big big World! 42\nnaïve end"
    got = dict(zip(quality.STATISTICS, quality.statistics(text.encode())))
    words = text.encode().split()
    assert got["log_words"] == pytest.approx(math.log(13)) and len(words) == 12
    assert got["word_length"] == pytest.approx(math.sqrt(sum(map(len, words)) / 12 / 10))
    assert got["loud_marks"] == pytest.approx(math.sqrt(2 / 12)) and got["commas"] == pytest.approx(math.sqrt(2 / 12))
    assert got["repeats"] == pytest.approx(math.sqrt(2 / 12)) and got["distinct"] == pytest.approx(math.sqrt(6 / 12))
    assert got["repeated_lines"] == pytest.approx(math.sqrt(1 / 3)) and got["line_ends"] == 0
    assert got["non_ascii"] == pytest.approx(math.sqrt(2 / len(text.encode())))


def test_chain_probabilities(spark, sf, docs):
    """Every probability of op1 from the features of its text and the earlier categories' log-odds, one by one."""
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("toxic IS NOT NULL").join(documents.select("doc_id", "lang"), "doc_id")
    chain = toxicity.train(documents, labels, queries.TOXIC_CATEGORIES)
    d = len(chain.vocabulary)
    for r in toxicity.score(documents, chain).collect():
        present = [chain.vocabulary[f] for f in toxicity.features_of((docs[r["doc_id"]] or "").encode()) if f in chain.vocabulary]
        earlier = []
        for name, w in zip(chain.names, chain.weights):
            odds = w[0] + sum(w[1 + i] for i in present) + sum(a * b for a, b in zip(w[1 + d :], earlier))
            earlier.append(min(max(odds, -12.0), 12.0))
            assert r[name] == pytest.approx(1 / (1 + math.exp(-earlier[-1])), rel=1e-4, abs=1e-6)


def test_later_models_see_out_of_fold_odds():
    """The second category's input is, row by row, the odds by a model that was not trained on the row."""
    rng = np.random.default_rng(2)
    x = (rng.random((90, 6)) < 0.4).astype(np.float32)
    y = np.stack([x[:, 0] > 0, (x[:, 0] + x[:, 1]) > 1], axis=1).astype(np.float32)
    folds = np.arange(90) % 3
    first, second = toxicity.fit_chain(x, y, folds)
    unseen = np.array([
        np.clip(w[0] + x[i] @ w[1:], -12, 12)
        for i in range(90) for w in [toxicity._logistic(x[folds != folds[i]], y[folds != folds[i], 0])]
    ], np.float32)
    assert np.allclose(first, toxicity._logistic(x, y[:, 0]), atol=1e-4)
    assert np.allclose(second, toxicity._logistic(np.concatenate((x, unseen[:, None]), axis=1), y[:, 1]), atol=2e-3)


def test_markov_spans(spark, sf, docs):
    """Every added span of op8 by scoring each long word, character pair by character pair."""
    documents = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = {-1: "key Zq8Kx2VbN4mW7tRp end", -2: "call +1 (838) 555-7235 or 0049-30-1234567, 2024-01-02/12345678", -3: "plain_words other-words Identifiers"}
    rows = spark.createDataFrame(list(extra.items()), documents.schema)
    model = secrets.fit(documents)
    width, first = secrets.WIDTH, secrets.FIRST
    n = 0
    for r in secrets.scan(documents.unionByName(rows), model).select("row.doc_id", "base", "spans").collect():
        text = {**docs, **extra}[r["doc_id"]] or ""
        base = [(s["start"], s["stop"]) for s in r["base"]]
        want = []
        for m in re.finditer(secrets.CANDIDATE, text):
            pairs = [(ord(a) - first) * width + ord(b) - first for a, b in zip(m[0], m[0][1:])]
            ratio = sum(model[p] for p in pairs) / len(pairs)
            if ratio > secrets.MIN_RATIO and not any(a <= m.start() and m.end() <= b for a, b in base):
                want.append((m.start(), m.end()))
        assert [(s["start"], s["stop"]) for s in r["spans"] if s["kind"] == "markov"] == want
        n += len(want)
        if r["doc_id"] == -1:
            assert want == [(4, 20)]
        if r["doc_id"] in (-2, -3):
            assert want == []
    assert n >= 1


FINDERS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])",
}


def test_surrogates_of_the_whole_table(spark, sf, docs):
    """E-mail addresses and IPs: none is left, each has one surrogate in the whole table, and different ones differ."""
    new = {r["doc_id"]: r["text"] for r in surrogates.pseudonymise(spark.read.parquet(f"{sf}/documents.parquet"), "k").collect()}
    assert set(new) == set(docs)
    for pattern in FINDERS.values():
        made, n = collections.defaultdict(set), 0
        for i, text in docs.items():
            old, now = re.findall(pattern, text or ""), re.findall(pattern, new[i] or "")
            assert len(old) == len(now)
            n += len(old)
            for a, b in zip(old, now):
                made[a.lower()].add(b.lower())
        assert n and all(len(x) == 1 for x in made.values())
        values = [next(iter(x)) for x in made.values()]
        assert len(set(values)) == len(values) and not set(values) & set(made)
    for i, text in docs.items():
        if not re.search(r"[@\d]|\b(?:Mrs?|Ms|Miss|Frau|Herr|Madame|Mme|Monsieur|Señora?|Sra?|Don|Dr|Prof)\b", text or ""):
            assert new[i] == text
