"""Merkle manifest of a dataset, with proofs by pointer jumping.

Rows are leaves. The leaves of a source, by ascending id, are hashed in runs of
``ARITY`` up to the source's subroot; the subroots, by source, likewise up to the
root. Runs are built level by level, one aggregation each, on tables that shrink by
the arity.

Every node but the root then holds a pointer to its parent and a segment: its
siblings on the way there. A self-join of the nodes with the nodes they point at
doubles the distance of the pointer and appends the segment behind it; after
log2(depth) joins every leaf points at the root and its segment is its proof.
In each round only leaves and nodes that a later round asks for take part. High
ancestors are asked for by many: requests are salted by the number of leaves under
the ancestor, so no key has more than some ``SALT_LEAVES`` rows.

Segments are binary: per level position, size of the run, whether the run is one of
subroots, then the siblings' digests from left to right. Only the largest number of
leaves of a source, the number of sources and the root reach the driver.

Defined cases: a null value hashes as ``-``; an empty text as ``0:``; a null source
is the first source, a null id the first leaf of its source; rows with equal ids
stand by the digest of their leaf, equal rows are leaves of their own; one row is
its own root; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidymeter.llm.running import running_totals
from tidymeter.session import materialize

ARITY = 3
SALT_LEAVES = 128
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(*values: Column) -> Column:
    """Hex SHA-256 over the values, each as its UTF-8 length, a colon and itself, or ``-`` if null."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _digest(kids: Column) -> Column:
    """Digest of a run: SHA-256 over its digests as hex text."""
    return F.unhex(F.sha2(F.array_join(F.transform(kids, lambda k: F.lower(F.hex(k["hash"]))), "").cast("binary"), 256))


def _byte(value: Column) -> Column:
    return F.lpad(F.hex(value.cast("int")), 2, "0")


def _leaves(df: DataFrame, leaf: Column, claim: Column, id_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """Numbered leaves (grp, i, n, node, hash, leaves, row) and the sources (source, n, tree)."""
    slim = df.select(
        F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{id_col}`").alias("id"),
        F.unhex(leaf).alias("leaf"), F.unhex(claim).alias("claim"),
    )
    rows = materialize(slim.groupBy("source", "id", "leaf", "claim").agg(F.count(F.lit(1)).alias("copies")), "leaves")
    sized = rows.groupBy("source").agg(F.sum("copies").alias("n"))
    sources = materialize(running_totals(sized, [], [F.col("source").asc_nulls_first()], F.lit(1), "tree"), "sources")
    order = [F.col("id").asc_nulls_first(), F.col("leaf"), F.col("claim").asc_nulls_first()]
    placed = running_totals(rows, ["source"], order, F.col("copies"), "first", sources)
    one = placed.withColumn("i", F.explode(F.sequence("first", F.col("first") + F.col("copies") - 1)))
    return one.select(
        F.col("tree").alias("grp"), "i", "n", _node(F.col("tree"), 0, F.col("i")).alias("node"), F.col("leaf").alias("hash"),
        F.lit(1).cast("long").alias("leaves"), F.struct("id", "leaf", "claim").alias("row"),
    ), sources


def _node(tree: Column, level: int, i: Column) -> Column:
    return F.struct(tree.cast("long").alias("tree"), F.lit(level).alias("level"), i.cast("long").alias("i"))


def _runs(level: DataFrame, height: int, name: str) -> DataFrame:
    """Runs of consecutive nodes: (grp, n, p, kids, up), ``up`` being the node that a run becomes."""
    kids = F.sort_array(F.collect_list(F.struct("i", "hash", "node", "leaves", "row")))
    runs = level.groupBy("grp", "n", F.floor(F.col("i") / ARITY).alias("p")).agg(kids.alias("kids"))
    return materialize(runs.withColumn("up", _node(F.col("grp"), height, F.col("p"))), name)


def _parents(runs: DataFrame) -> DataFrame:
    leaves = F.aggregate("kids", F.lit(0).cast("long"), lambda a, k: a + k["leaves"])
    none = F.transform("kids", lambda k: F.when(F.lit(False), k["row"]))[0]
    return runs.select(
        "grp", F.col("p").alias("i"), F.floor((F.col("n") + (ARITY - 1)) / ARITY).alias("n"), F.col("up").alias("node"),
        _digest(F.col("kids")).alias("hash"), leaves.alias("leaves"), none.alias("row"),
    )


def _links(runs: DataFrame, top: bool) -> DataFrame:
    """Per node of a run: its parent, the leaves under that, and the segment of one level."""
    size = F.size("kids")
    under = F.aggregate("kids", F.lit(0).cast("long"), lambda a, k: a + k["leaves"])
    one = runs.select("kids", "up", size.alias("size"), under.alias("under"), F.posexplode("kids").alias("pos", "kid"))
    head = F.unhex(F.concat(_byte(F.col("pos")), _byte(F.col("size")), F.lit("01" if top else "00")))
    empty = F.unhex(F.lit(""))
    others = [F.when(F.col("pos") != j, F.coalesce(F.get("kids", F.lit(j))["hash"], empty)).otherwise(empty) for j in range(ARITY)]
    return one.select(
        F.col("kid")["node"].alias("node"), F.col("kid")["leaves"].alias("leaves"), F.col("kid")["row"].alias("row"),
        F.col("up").alias("anc"), F.col("under").alias("anc_leaves"), F.concat(head, *others).alias("seg"),
    )


def _levels(level: DataFrame, most: int, top: bool) -> tuple[list[DataFrame], DataFrame]:
    """Links of every level of the trees in ``level``, and the one node that is left of each."""
    links, done, height = [], [level.where("n = 1")], 0
    while most > 1:
        height += 1
        runs = _runs(level.where("n > 1"), height, "subroot-runs" if top else "runs")
        links.append(_links(runs, top))
        level, most = _parents(runs), -(-most // ARITY)
        done.append(level.where("n = 1"))
    return links, reduce(DataFrame.unionByName, done)


def prove(
    df: DataFrame,
    leaf: Column,
    claim: Column | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """Per row: (id, leaf, claim, proof, root); digests are binary, ``proof`` is the segment from leaf to root.

    ``leaf`` is the hex digest that enters the tree, ``claim`` one that is to be
    verified later (default: the leaf).
    """
    level, sources = _leaves(df, leaf, leaf if claim is None else claim, id_col, source_col)
    known = sources.agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("n")).first()
    links, subroots = _levels(materialize(level, "level"), known["most"] or 0, False)
    heads = subroots.withColumns({"i": F.col("grp"), "grp": F.lit(-1).cast("long"), "n": F.lit(known["n"]).cast("long")})
    top_links, root = _levels(materialize(heads, "subroots"), known["n"], True)
    last = root.first()
    if last is None:
        return _lonely(root, None)
    if not links and not top_links:
        return _lonely(root, last["hash"])
    return _jumped(links, top_links, last["node"], last["hash"])


def _lonely(root: DataFrame, digest: bytes | None) -> DataFrame:
    """The proofs of a table of one row, or of none."""
    return root.select("row.id", "row.leaf", "row.claim", F.unhex(F.lit("")).alias("proof"), F.lit(digest).cast("binary").alias("root"))


def _jumped(links: list[DataFrame], top_links: list[DataFrame], root, digest: bytes) -> DataFrame:
    """Doubles the distance of all pointers until every leaf points at the root."""
    depth = len(links) + len(top_links)
    paths = reduce(DataFrame.unionByName, [x.where("row IS NOT NULL") for x in links[:1] + top_links[:1]])
    # A node of height h is an ancestor at distance d only if h >= d; subroots may be as high as the highest tree.
    inner = [x.withColumn("height", F.lit(h)) for h, x in enumerate(links) if h]
    inner += [x.where("row IS NULL").withColumn("height", F.lit(len(links) + h)) for h, x in enumerate(top_links)]
    nodes = materialize(reduce(DataFrame.unionByName, inner), "nodes") if inner else None
    at_root = F.col("anc") == F.struct(F.lit(root["tree"]).alias("tree"), F.lit(root["level"]).alias("level"), F.lit(root["i"]).alias("i"))
    finished, distance = [], 1
    while True:
        finished.append(paths.where(at_root))
        if distance >= depth:
            break
        asked = nodes.where(F.col("height") >= distance)
        paths = materialize(_jump(paths.where(~at_root), asked), "paths")
        distance *= 2
        if distance < depth:
            later = asked.where(F.col("height") >= distance)
            nodes = materialize(later.where(at_root).unionByName(_jump(later.where(~at_root), asked)), "nodes")
    done = reduce(DataFrame.unionByName, finished)
    return done.select("row.id", "row.leaf", "row.claim", F.col("seg").alias("proof"), F.lit(digest).alias("root"))


def _jump(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each row's pointer moves on to where its ancestor points; the segments are joined.

    Rows that point at one ancestor are dealt over as many salts as the ancestor has
    ``SALT_LEAVES`` leaves; the ancestor stands once under each salt.
    """
    salts = F.ceil(F.col("anc_leaves") / SALT_LEAVES)
    asking = rows.withColumn("salt", F.pmod(F.xxhash64("node"), salts).cast("long"))
    own = F.ceil(F.col("leaves") / SALT_LEAVES).cast("long")
    given = nodes.select(
        F.col("node").alias("at"), F.explode(F.sequence(F.lit(0).cast("long"), own - 1)).alias("at_salt"),
        F.col("anc").alias("next"), F.col("anc_leaves").alias("next_leaves"), F.col("seg").alias("more"),
    )
    met = asking.join(given, (F.col("anc") == F.col("at")) & (F.col("salt") == F.col("at_salt")))
    moved = {"anc": F.col("next"), "anc_leaves": F.col("next_leaves"), "seg": F.concat("seg", "more")}
    return met.select(*[moved.get(c, F.col(c)).alias(c) for c in rows.columns])


def fold(value: bytes, proof: bytes) -> tuple[str, str, str]:
    """(subroot, root, siblings) that a digest folds to along a proof, as hex text."""
    value, subroot, siblings, at = value.hex(), None, [], 0
    while at < len(proof):
        pos, size, top = proof[at : at + 3]
        others = proof[at + 3 : at + 3 + 32 * (size - 1)].hex()
        at += 3 + 32 * (size - 1)
        if top and subroot is None:
            subroot = value
        siblings.append(others)
        value = hashlib.sha256((others[: 64 * pos] + value + others[64 * pos :]).encode()).hexdigest()
    return subroot or value, value, "".join(siblings)


def verify(proofs: DataFrame) -> DataFrame:
    """Per row of ``prove``: id, leaf, subroot, root, proof_sha256, folded_root of the claim, verified."""
    kind = proofs.schema["id"].dataType.simpleString()
    schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            leaf, claim, proof, root = (batch.column(c).to_pylist() for c in ("leaf", "claim", "proof", "root"))
            for own, said, path, top in zip(leaf, claim, proof, root):
                subroot, _, siblings = fold(own, path)
                folded = fold(said, path)[1]
                out.append((own.hex(), subroot, top.hex(), hashlib.sha256(siblings.encode()).hexdigest(), folded, folded == top.hex()))
            columns = [list(c) for c in zip(*out)] or [[]] * 6
            kinds = [pa.string()] * 5 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )

    return proofs.mapInArrow(run, schema)
