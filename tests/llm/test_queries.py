"""Registered queries: against their SQL, or against brute force over the whole small tables."""

import collections
import hashlib
import math
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import compare, connect
from tidymeter.llm import backoff_lm, ngram_join, queries, sharding

pytest.importorskip("public_tokenizers")
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def docs(sf):
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())


def rows(spark, sf, name):
    return queries.QUERIES[name](spark, sf).collect()


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_against_sql(spark, sf, name):
    note, _, good = compare(spark, connect(sf), sf, name, queries.QUERIES[name], queries.oracle_sql()[name])
    assert good, note


def lower(text):
    return text.encode().lower().decode()


def test_ngram_join_by_brute_force(spark, docs):
    """Near copies with one word changed at growing distances, chains included."""
    base = [f"w{i}" for i in range(60)]
    made = []
    for k in range(12):
        words = list(base)
        for j in range(k):
            words[5 * j] = f"x{j}"
        made.append((k, " ".join(words)))
    made += [(100 + k, " ".join(["shared", "words", "in", "every", "text"] * 2 + [f"y{k}_{i}" for i in range(8)])) for k in range(30)]
    made += [(200, "two words"), (201, "Two  WORDS"), (202, "two"), (203, None)]
    df = spark.createDataFrame(made, "doc_id long, text string")

    def grams(t):
        w = WORD.findall(lower(t or ""))
        return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()

    sets = {i: grams(t) for i, t in made}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link(df).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


def greedy(sizes, capacity):
    out, filled = 1, 0
    for s in sizes:
        if s > capacity:
            return 10**9
        if filled + s > capacity:
            out, filled = out + 1, 0
        filled += s
    return out


def test_shards(spark, sf, docs):
    got = rows(spark, sf, "op3_minimax_shards")
    sizes, slots, shard_of = collections.Counter(), collections.defaultdict(list), {}
    for r in got:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "bytes")
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert shard_of.setdefault(docs[r["doc_id"]], r["shard"]) == r["shard"]
    assert set(sizes) == set(range(8)) and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_minimax_capacity_is_least(spark):
    rng = np.random.default_rng(7)
    for n, heavy in ((400, 1), (400, 3000), (5, 1), (1, 1)):
        keys = np.sort(rng.integers(-(2**63), 2**63 - 1, n))
        size = rng.integers(1, 100, n)
        size[0] = heavy
        rng.shuffle(size)
        groups = spark.createDataFrame([(int(k), int(s)) for k, s in zip(keys, size)], "key long, size long")
        ends = sharding.bounds(groups, 8)
        shards = np.searchsorted(np.array(ends, np.int64), keys, side="left") if ends else np.zeros(n, int)
        largest = max(np.bincount(shards, weights=size))
        least = next(c for c in range(int(size.max()), int(size.sum()) + 1) if greedy(size.tolist(), c) <= 8)
        assert largest == least and shards.max() < 8


def test_packing(spark, sf, docs):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    got = rows(spark, sf, "op4_pattern_packing")
    pieces, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(docs)
    for i, text in docs.items():
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want = [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted(pieces[i]) == want
    total = 0
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 1024
        total += end
    assert len(places) <= math.ceil(total / 1024) * 1.02 + 1


@pytest.mark.parametrize("text", ["a  b", "a \n b", " a", "a ", "a\n\n b", "x \t\ty", "a  b  c", "<|endoftext|> a", "I'm  we'll ", "", "é 中文 字\n"])
def test_encoder_equals_the_tokenizer(text):
    from tokenizers import Tokenizer

    from tidymeter.llm.packing import Encoder, public_vocabulary

    v = public_vocabulary()
    coder = Encoder(v.vocabulary, v.ranks, v.pattern)
    want = Tokenizer.from_file(v.vocabulary).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(coder.encode(text), "<u4").tolist() == want


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(t):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(found)


def test_secret_base_spans(spark, sf, docs):
    for r in rows(spark, sf, "op8_markov_secrets"):
        own = base_spans(docs[r["doc_id"]] or "")
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in own)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x[1] == i for x in own) for i in range(3)]
        assert {x for x in text.split(",") if x} <= set(r["spans"].split(","))


def brute_force_scores(texts, train, order=3, mass=2.0):
    """(n_tokens, n_known, all tokens, base, score) of every text by the formula of the model, n-gram by n-gram."""
    tokens = [[*WORD.findall(lower(t or "")), None] for t in texts]
    count, history = collections.Counter(), collections.Counter()
    for own, use in zip(tokens, train):
        if use:
            line = ["<s>", *own]
            for i in range(1, len(line)):
                for k in range(1, order + 1):
                    if i - k + 1 >= 0:
                        gram = tuple(line[i - k + 1 : i + 1])
                        count[gram] += 1
                        history[gram[:-1]] += 1
    n, v = history[()], sum(len(g) == 1 for g in count)

    def p(gram):
        if len(gram) == 1:
            return (count[gram] + 1) / (n + v + 1)
        return (count[gram] + mass * p(gram[1:])) / (history[gram[:-1]] + mass)

    out = []
    for own in tokens:
        line = ["<s>", *own]
        scores = [p(tuple(line[max(0, i - order + 1) : i + 1])) for i in range(1, len(line))]
        base = [(count[(w,)] + 1) / (n + v + 1) for w in own]
        out.append((len(own), sum(count[(w,)] > 0 for w in own), n, sum(map(math.log10, base)), sum(map(math.log10, scores))))
    return out


def same_scores(got, want):
    assert got[:3] == want[:3]
    assert got[3:] == pytest.approx(want[3:], rel=1e-9, abs=1e-9)


FIELDS = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def test_language_model_by_brute_force(spark, sf, docs):
    ids = list(docs)
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i in ids]
    want = dict(zip(ids, brute_force_scores([docs[i] for i in ids], train)))
    got = rows(spark, sf, "op7_backoff_lm")
    assert len(got) == len(ids) and {r["doc_id"]: not r["held_out"] for r in got} == dict(zip(ids, train))
    for r in got:
        same_scores(tuple(r[f] for f in FIELDS), want[r["doc_id"]])


@pytest.mark.parametrize("order, limits", [(2, {}), (3, {}), (4, {}), (3, {"range_keys": 50, "fan": 4}), (5, {"range_keys": 200})])
def test_automaton_over_many_blocks(spark, order, limits):
    """Long texts are walked in stretches, texts lie in many blocks, n-grams in many ranges; one and two hops."""
    rng = np.random.default_rng(order)
    texts = [" ".join(f"w{x}" for x in rng.geometric(0.15, n)) for n in [*rng.integers(1, 60, 120), 900, 257, 256, 255]]
    texts += [texts[3]] * 6 + [None, "", " \n ", "only here", "w1", "Ünïcödé ключ w1 w2"]
    train = [i % 4 != 1 for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, u) for i, (t, u) in enumerate(zip(texts, train))], "doc_id long, text string, train boolean")
    got = backoff_lm.score(df, order=order, block_bytes=1500, **limits).collect()
    want = brute_force_scores(texts, train, order)
    assert len(got) == len(texts)
    for r in got:
        same_scores(tuple(r[f] for f in FIELDS), want[r["doc_id"]])


def test_packed_values():
    """What travels between blocks and ranges comes back as it was, without bytes that are all zero."""
    rng = np.random.default_rng(5)
    for v in ([], [0], [0, 0, 0], [2**63 - 1, 0, 5], [1] * 1000, range(300), rng.geometric(0.01, 5000)):
        v = np.array(v, np.int64)
        assert backoff_lm._unpack_counts(backoff_lm._pack(v)).tolist() == v.tolist()
    for v in ([], [0], [2**64 - 1], [5, 2**64 - 1], [0, 1, 2**63], np.unique(rng.integers(0, 2**44, 5000))):
        v = np.array(v, np.uint64)
        assert backoff_lm._unpack_keys(backoff_lm._pack_keys(v)).tolist() == v.tolist()
    keys = np.unique(rng.integers(0, 2**44, 2**19).astype(np.uint64))
    assert len(backoff_lm._pack_keys(keys)) < 4 * len(keys) and len(backoff_lm._pack(np.ones(len(keys), np.int64))) < len(keys) // 100


def test_language_model_memory_of_a_block():
    """A task takes less than 100 MB for the asks and for the scores of a block."""
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{x}" for x in rng.geometric(0.0005, 500)) for _ in range(backoff_lm.BLOCK_BYTES // 2700)]
    docs = pd.DataFrame({"id": range(len(texts)), "text": texts, "train": True})
    tracemalloc.start()
    try:
        asks = backoff_lm._requests(3, 44, 200)((0,), docs)
        peaks = [tracemalloc.get_traced_memory()[1]]
        answers = asks[["block", "kind", "range", "counts"]].assign(tokens=1, types=1)
        asked = asks["keys"].map(len).sum() + asks["counts"].map(len).sum()
        del asks
        tracemalloc.reset_peak()
        backoff_lm._scored(3, 44, len(texts), 2.0, ["id", "train"])((0,), docs, answers)
        peaks.append(tracemalloc.get_traced_memory()[1])
    finally:
        tracemalloc.stop()
    assert max(peaks) < 100e6 and asked < 2 * backoff_lm.BLOCK_BYTES, (peaks, asked)


@pytest.mark.parametrize("limits", [{}, {"range_keys": 50, "fan": 4}])
def test_language_model_shuffles_texts_once(spark, limits):
    """Counting and scoring read one shuffle of the texts; nothing is written in between."""
    df = spark.createDataFrame([(i, f"a b{i % 7} c{i}") for i in range(300)], "doc_id long, text string").withColumn("train", F.col("doc_id") % 3 > 0)
    done = backoff_lm.score(df, block_bytes=500, **limits)
    assert len(done.collect()) == 300
    plan = done._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan and "Scan parquet" not in plan and plan.count("Scan ExistingRDD") == 1, plan


def test_language_model_without_training_rows(spark):
    df = spark.createDataFrame([(1, "a b", None), (2, None, False)], "doc_id long, text string, train boolean")
    got = {r["doc_id"]: r for r in backoff_lm.score(df).collect()}
    assert (got[1]["n_known"], got[1]["train_tokens"], got[1]["base_score"], got[2]["n_tokens"]) == (0, 0, 0.0, 1)


def test_quality_held_out(spark, sf):
    sf = "/root/testdata/sf0.01"
    truth = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
    got = [(r["predicted"], truth[r["doc_id"]]) for r in rows(spark, sf, "op6_shrunk_qda") if r["held_out"] and r["doc_id"] in truth]
    assert len(got) > 40 and sum(a == b for a, b in got) >= 0.95 * len(got)


def test_toxicity_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").fetchall())
    got = [(r["flagged"], truth[r["doc_id"]] == 1) for r in rows(spark, sf, "op1_toxicity_chain") if r["doc_id"] in truth]
    assert sum(a == b for a, b in got) >= 0.97 * len(got)


def four_grams(text):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def one_of_each(kept):
    """The documents that stay: the least id of every component of texts with 85 percent of their 4-grams in common."""
    sets = {i: four_grams(t) for i, t in kept.items()}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: t for i, t in kept.items() if find(i) == i}


BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def uncontaminated(kept, items):
    """Texts below the coverage limit, without the stretches of their hit words."""
    windows = set()
    for text in items:
        w = BENCH_WORD.findall(lower(text or ""))
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    out = {}
    for i, text in kept.items():
        found = list(BENCH_WORD.finditer(lower(text or "")))
        words = [m[0] for m in found]
        hit = set()
        for n in {len(x) for x in windows}:
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if hit and 20 * len(hit) >= len(words):
            continue
        parts, last = [], 0
        for k in sorted(hit):
            if k - 1 not in hit:
                parts.append(text[last : found[k].start()])
            if k + 1 not in hit:
                last = found[k].end()
        out[i] = "".join(parts) + (text or "")[last:] if text is not None else None
    return out


def test_pipeline_by_brute_force(spark, sf, docs):
    """Each stage on all its predecessor kept: near copies and contamination by brute force, secrets gone, pieces whole."""
    stage = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept, before = stage.columns, dict(docs), None
    items = [t for t, in duckdb.sql(f"SELECT text FROM '{sf}/benchmark.parquet'").fetchall()]
    judged = {r["doc_id"]: r["kept"] for r in rows(spark, sf, "op2_line_rules")}
    for name, fn in corpus_pipeline.STAGES[:-1]:
        stage = fn(spark, stage, sf)
        assert stage.columns == columns, name
        stage = spark.createDataFrame(stage.collect(), stage.schema)
        before, kept = kept, {r["doc_id"]: r["text"] for r in stage.collect()}
        assert stage.count() == len(kept)
        if name == "quality_rules":
            assert set(kept) == {i for i, good in judged.items() if good}
        elif name == "near_duplicates":
            assert kept == one_of_each(before)
        elif name == "benchmark_decontamination":
            assert kept == uncontaminated(before, items)
        else:
            assert set(kept) == set(before) and not any(base_spans(t) for t in kept.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, stage, sf).collect()
    assert {r["doc_id"] for r in packed} == set(kept)
    places = collections.defaultdict(list)
    for r in packed:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        assert [a for a, _ in sorted(own)] == np.cumsum([0, *(n for _, n in sorted(own))])[:-1].tolist()
        assert sum(n for _, n in own) <= 1024


def test_encoder_equals_the_tokenizer_widely():
    """All white space and control characters between letters and digits, every block of Unicode, and random mixtures."""
    import unicodedata

    from tokenizers import Tokenizer

    from tidymeter.llm.packing import Encoder, public_vocabulary

    v = public_vocabulary()
    coder, own = Encoder(v.vocabulary, v.ranks, v.pattern), Tokenizer.from_file(v.vocabulary)
    odd = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) in ("Zs", "Zl", "Zp", "Cc", "Cf")]
    rng = np.random.default_rng(11)
    texts = [f"a{c}b {c}{c} 1{c}\n{c} x{c}" for c in odd]
    texts += ["".join(map(chr, range(c, c + 64))) for c in range(0, 0x30000, 64) if not 0xD800 <= c < 0xE000]
    pool = [*odd[:90], *"abcXYZ019'’.,;!?-_/\\\"(){}<|>", "'s", "'ll", "don't", "é", "ß", "字", "ключ", "\U0001f600", "́", " ", "\n", "\t"]
    texts += ["".join(rng.choice(pool, rng.integers(1, 60))) for _ in range(4000)]
    for text in texts:
        want = own.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == want, repr(text)
