"""The mix against a brute-force version, odd rows, and the schedule's spread."""

import hashlib
import re

import pytest

from tidymeter.llm import mixing

SCHEMA = "doc_id long, source string, text string, size long, key string, place int"
WORD = re.compile("[^\x20\x09-\x0d]+")


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2) for r in rows], SCHEMA)


def shares(sizes, weights, most):
    """Targets by resharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped = set()
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        want = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if want[s] > most * sizes[s]}
        if not above:
            return {s: want.get(s, most * sizes[s]) for s in names}
        capped |= above


def brute_force(rows, most=3):
    docs = [(i, s, len(WORD.findall(t or "")), hashlib.md5(
        f"mix|{'-' if i is None else i}|{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()) for i, s, t in rows]
    sizes = {s: sum(d[2] for d in docs if d[1] == s) for s in {d[1] for d in docs}}
    target = shares(sizes, mixing.WEIGHTS, most)
    out = []
    for s in sizes:
        stream = [k for k, d in sorted(enumerate(docs), key=lambda x: (x[1][3], x[1][2], x[0])) if d[1] == s for _ in range(d[2])]
        taken = (stream * most)[: int(target[s] + 0.5)]
        out += [(d[0], d[2], sizes[s], target[s], taken.count(k)) for k, d in enumerate(docs) if d[1] == s]
    return sorted(out, key=str)


ROWS = [(i, f"s{i % 4}", " ".join(["word"] * (i * 7 % 23))) for i in range(60)]
ROWS += [(100, "tiny", "one two"), (None, None, "no id"), (None, "s1", "a b c"), (101, "s1", None), (102, "s1", ""), (103, "s2", " \n\t ")]
ROWS += [(104, "s0", "equal row")] * 5 + [(105, "s0", "same id, one"), (105, "s0", "same id, other text"), (106, "long", "x " * 30_000), (107, "s3", "ключ Ünïcödé \U0001f600")]


@pytest.mark.parametrize("block_words", [7, 2048])
def test_against_brute_force(spark, block_words):
    mixed = mixing.mix(table(spark, ROWS), block_words=block_words)
    got = [(r["id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in mixing.taken(mixed).collect()]
    want = brute_force(ROWS)
    assert [x[:3] + x[4:] for x in sorted(got, key=str)] == [x[:3] + x[4:] for x in want]
    assert [x[3] for x in sorted(got, key=str)] == pytest.approx([x[3] for x in want])
    again = mixing.taken(mixing.mix(table(spark, ROWS[::-1]).repartition(7), block_words=block_words)).collect()
    assert sorted(got, key=str) == sorted(((r["id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in again), key=str)


def test_blocks_are_equal_and_spread(spark):
    mixed = mixing.mix(table(spark, ROWS), block_words=16).where("slot IS NOT NULL")
    per_slot = mixed.groupBy("slot", "place", "rank").sum("words").collect()
    assert len({r["slot"] for r in per_slot}) == len(per_slot)
    order, n = {}, {}
    for r in sorted(per_slot, key=lambda r: r["slot"]):
        order.setdefault(r["place"], []).append(r)
        n[r["place"]] = n.get(r["place"], 0) + 1
    for place, own in order.items():
        assert [r["rank"] for r in own] == list(range(len(own)))
        assert all(r["sum(words)"] == 16 for r in own[:-1]) and 0 < own[-1]["sum(words)"] <= 16
    # In every beginning of the schedule, a source has its share of the slots to within a few.
    slots = [r["place"] for r in sorted(per_slot, key=lambda r: r["slot"])]
    big = max(n, key=n.get)
    for end in range(1, len(slots) + 1, 97):
        assert abs(slots[:end].count(big) - end * n[big] / len(slots)) <= len(bin(len(slots)))


def test_texts_hold_the_words_taken(spark):
    df = table(spark, ROWS)
    mixed = mixing.mix(df, block_words=16)
    words = sum(r["taken"] for r in mixing.taken(mixed).collect())
    assert sum(len(r["text"].split()) for r in mixing.texts(df, mixed).collect()) == words


@pytest.mark.parametrize("rows", [[], [(1, "a", None)], [(1, None, "one"), (None, None, None)]])
def test_empty_tables_and_texts(spark, rows):
    got = mixing.taken(mixing.mix(table(spark, rows))).collect()
    assert sorted((r["id"] or 0, r["size"], r["taken"]) for r in got) == sorted(
        (i or 0, len((t or "").split()), len((t or "").split())) for i, _, t in rows
    )
