"""Manifest and proofs against a brute-force tree, for odd rows and uneven sources."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidymeter.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, node int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]])


def climb(nodes, paths):
    """Root of a list of digests; every original index gets (before, after) of its runs."""
    at = {i: i for i in range(len(nodes))}
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for i, p in at.items():
            run = runs[p // 3]
            paths.setdefault(i, []).append(("".join(run[: p % 3]), "".join(run[p % 3 + 1 :])))
            at[i] = p // 3
        nodes = [h(*run) for run in runs]
    return nodes[0]


def brute_force(rows, claims):
    order = sorted(range(len(rows)), key=lambda k: (
        rows[k][1] is not None, (rows[k][1] or "").encode(), rows[k][0] is not None, rows[k][0] or 0, leaf_of(rows[k])))
    sources = []
    for k in order:
        if not sources or rows[sources[-1][0]][1] != rows[k][1]:
            sources.append([])
        sources[-1].append(k)
    paths, heads = [], []
    for own in sources:
        paths.append({})
        heads.append(climb([leaf_of(rows[k]) for k in own], paths[-1]))
    up = {}
    root = climb(heads, up)
    out = []
    for s, own in enumerate(sources):
        for i, k in enumerate(own):
            steps = paths[s].get(i, []) + up.get(s, [])
            folded = claims[k]
            for before, after in steps:
                folded = h(before, folded, after)
            out.append((rows[k][0], leaf_of(rows[k]), heads[s], root, h(*[a + b for a, b in steps]), folded, folded == root))
    return sorted(out, key=str)


ODD = [
    (1, "b", "en", 5, "text one\nmore"), (2, "b", None, None, None), (3, "b", "en", 0, ""), (None, "b", "en", 1, "no id"),
    (4, "b", "en", 1, "same id"), (4, "b", "en", 1, "same id, other text"), (5, None, "de", 2, "Ünïcödé \U0001f600"),
    (6, "", "de", 2, "empty source"), (7, "c", "x", 7, "long " * 50_000), (8, "é", "x", 7, "only leaf"),
]
MANY = [(i * 17 % 1000, "hot" if i % 3 else f"s{i % 7}", "en", i, f"line {i}\nnext") for i in range(400)]
CASES = {
    "odd": ODD, "many": ODD + MANY, "equal rows": ODD + [(9, "b", "en", 1, "copy")] * 7, "one source": MANY[1:3] + MANY[4:6],
    "singles": [(i, f"s{i:03}", "en", 1, "t") for i in range(30)], "two": ODD[:2], "one": ODD[:1], "none": [],
}


@pytest.mark.parametrize("name", CASES)
def test_against_brute_force(spark, name):
    rows = CASES[name]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    leaf = manifest.leaf_hash(*[F.col(c) for c in manifest.FIELDS])
    odd = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    claim = F.when(odd, manifest.leaf_hash(*[F.col(c) for c in manifest.FIELDS[:4]], F.translate("text", "\n", ""))).otherwise(leaf)
    claims = [leaf_of((*r[:4], r[4] and r[4].replace("\n", "")) if r[0] is not None and r[0] % 2 == 0 else r) for r in rows]
    got = manifest.verify(manifest.prove(df, leaf, claim)).collect()
    assert sorted(map(tuple, got), key=str) == (brute_force(rows, claims) if rows else [])
