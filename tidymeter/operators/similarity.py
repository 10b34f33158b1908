"""Token fingerprints, exact similarity joins and leader clusters."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidymeter.functions.text import as_col
from tidymeter.session import LARGE_ROWS, discard, materialize

# Sets and tokens of a block; two blocks are paired inside one task.
BLOCK_ROWS = 20_000
BLOCK_TOKENS = 2_000_000
# Shared tokens and pairs of sets that a task holds at a time, beside those of one set.
CHUNK_PAIRS = 1 << 20
CHUNK_CELLS = 1 << 22
# Tokens that two near sets must be found to share before they are compared.
SHARED = 8
# Hash ranges by which the frequencies of tokens are told apart.
COUNTER_BITS = 20
# For rows that are blocks: one row per Arrow batch, and what a partition meets is held in memory that Spark can spill.
BLOCK_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1", "spark.sql.cartesianProductExec.buffer.in.memory.threshold": "1",
}


def token_hash(token) -> Column:
    """A 32-bit token hash that any engine can reproduce (leading digits of md5)."""
    return F.conv(F.substring(F.md5(as_col(token)), 1, 8), 16, 10).cast("bigint")


def count_fingerprint(df: DataFrame, key: str, tokens: str, width: int) -> DataFrame:
    """Sparse count fingerprint: (key, bit, count).

    Counting per (key, bit) combines before the shuffle, so at most ``width``
    rows per key travel. A key without tokens keeps one row with a null bit:
    the zero vector.
    """
    bits = df.select(key, F.explode_outer(tokens).alias("_t")).select(
        key, F.pmod(token_hash("_t"), F.lit(width)).alias("bit")
    )
    return bits.groupBy(key, "bit").agg(F.count("bit").alias("count"))


def fingerprint_features(df: DataFrame, key: str, tokens: str, width: int, prefix: str = "eMFP_") -> DataFrame:
    """Dense fingerprint columns, one row per key; the width is the number of columns."""
    sparse = count_fingerprint(df, key, tokens, width)
    return sparse.groupBy(key).agg(
        *[
            F.coalesce(F.sum(F.when(F.col("bit") == i, F.col("count"))), F.lit(0)).alias(f"{prefix}{i}")
            for i in range(width)
        ]
    )


def width_study(
    df: DataFrame, key: str, tokens: str, sizes: list[int], sample: int = 50
) -> DataFrame:
    """Occupancy, variance and similarity of fingerprints of several widths.

    Rows without tokens (null) are skipped. Implied zeros enter the variance by
    count. The mean pairwise similarity is taken over the first ``sample`` keys.
    """
    valid = df.where(F.col(tokens).isNotNull()).select(key, tokens)
    hashed = valid.select(key, F.explode_outer(tokens).alias("_t")).select(key, token_hash("_t").alias("_h"))
    # Written once, so that the tokens are hashed once for all figures below.
    counts = materialize(
        hashed.select(
            key,
            F.explode(F.array(*[F.lit(s) for s in sizes])).alias("nbits"),
            "_h",
        )
        .withColumn("bit", F.pmod("_h", "nbits"))
        .groupBy("nbits", key, "bit")
        .agg(F.count("bit").alias("c")),
        "width-counts",
    )
    rows = valid.agg(F.count(F.lit(1)).cast("double")).scalar()
    per_bit = (
        counts.where("bit is not null")
        .groupBy("nbits", "bit")
        .agg(
            F.sum("c").cast("decimal(38,0)").alias("s"),
            F.sum(F.col("c") * F.col("c")).cast("decimal(38,0)").alias("q"),
        )
    )
    mean = F.col("s").cast("double") / rows
    variance = F.col("q").cast("double") / rows - mean * mean
    flat = F.col("s").cast("double") * F.col("s").cast("double") == F.col("q").cast("double") * rows
    spread = per_bit.groupBy("nbits").agg(
        F.count(F.lit(1)).alias("occupied"),
        F.sum(F.when(flat, F.lit(0.0)).otherwise(variance)).alias("total_variance"),
        F.count_if(flat).alias("flat"),
    )
    first = valid.select(key).orderBy(key).limit(sample)
    picked = counts.join(first, key, "left_semi")
    norms = picked.groupBy("nbits", key).agg(F.sum(F.col("c") * F.col("c")).alias("norm"))
    left = picked.select("nbits", "bit", F.col(key).alias("a"), F.col("c").alias("ca"))
    right = picked.select("nbits", "bit", F.col(key).alias("b"), F.col("c").alias("cb"))
    dots = (
        left.join(right, ["nbits", "bit"])
        .where(F.col("a") < F.col("b"))
        .groupBy("nbits", "a", "b")
        .agg(F.sum(F.col("ca") * F.col("cb")).alias("dot"))
    )
    scored = (
        dots.join(norms.select("nbits", F.col(key).alias("a"), F.col("norm").alias("na")), ["nbits", "a"])
        .join(norms.select("nbits", F.col(key).alias("b"), F.col("norm").alias("nb")), ["nbits", "b"])
        .groupBy("nbits")
        .agg(F.sum(F.col("dot") / (F.col("na") + F.col("nb") - F.col("dot"))).alias("similarity"))
    )
    sampled = norms.groupBy("nbits").agg(
        F.count(F.lit(1)).alias("m"), F.count_if(F.col("norm") == 0).alias("z")
    )
    pairs = F.col("m") * (F.col("m") - 1) / 2
    empty_pairs = F.col("z") * (F.col("z") - 1) / 2
    out = spread.join(sampled, "nbits", "left").join(scored, "nbits", "left")
    zero_share = (F.col("nbits") - F.col("occupied") + F.col("flat")) / F.col("nbits")
    return out.select(
        "nbits",
        F.round(F.col("occupied") / F.col("nbits"), 4).alias("occupancy"),
        F.round(F.col("total_variance") / F.col("nbits"), 6).alias("mean_variance"),
        F.round(zero_share, 4).alias("zero_variance_frac"),
        F.round(
            F.coalesce(F.try_divide(F.coalesce("similarity", F.lit(0.0)) + empty_pairs, pairs), F.lit(0.0)), 4
        ).alias("mean_pairwise_tanimoto"),
    )


def recommended_width(study: DataFrame) -> DataFrame:
    score = F.struct(F.col("occupancy") - F.col("zero_variance_frac"), -F.col("nbits"))
    return study.agg(F.max_by("nbits", score).alias("recommended"))


# --- exact neighbours -------------------------------------------------------------------


def distinct_sets(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """(set_id, members, items): equal token sets folded together, set_id the smallest key.

    Copies combine before the shuffle, so a third of all rows being one text
    costs one row per task.
    """
    sets = df.where(F.size(tokens) > 0).select(key, F.array_sort(F.array_distinct(tokens)).alias("items"))
    return (
        sets.withColumn("_digest", F.sha2(F.to_json("items"), 256))
        .groupBy("_digest")
        .agg(F.min(key).alias("set_id"), F.count(F.lit(1)).alias("members"), F.first("items").alias("items"))
        .drop("_digest")
    )


def _frequencies(tokens: DataFrame) -> np.ndarray:
    """How often the tokens of each of 2 ** ``COUNTER_BITS`` hash ranges occur.

    It only gives the order of the tokens, so ranges that hold several tokens cost time and no pair.
    """
    at = F.shiftrightunsigned("token", 64 - COUNTER_BITS).cast("int").alias("at")
    counted = tokens.select(F.explode("tokens").alias("token")).groupBy(at).agg(F.count(F.lit(1)).alias("f")).toArrow()
    out = np.zeros(1 << COUNTER_BITS, np.uint64)
    out[counted["at"].to_numpy()] = counted["f"].to_numpy()
    return np.minimum(out, np.uint64((1 << 24) - 1))


def _blocks(tokens: DataFrame, shared) -> DataFrame:
    """Rows of up to ``BLOCK_ROWS`` sets (ids, sizes and tokens, rarest token first) for the pairing of blocks."""
    kind = tokens.schema["set_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency, ids, held = shared.value, [], []
        as_list = None

        def block() -> pa.RecordBatch:
            sizes = np.array([len(t) for t in held], "<i4").tobytes()
            columns = [pa.array([ids], as_list), pa.array([sizes], pa.binary()), pa.array([np.concatenate(held).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["ids", "sizes", "tokens"])

        full = 0
        for batch in batches:
            as_list = pa.list_(batch.schema.field("set_id").type)
            column = batch.column("tokens")
            values, ends = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
            for k, set_id in enumerate(batch.column("set_id").to_pylist()):
                own = np.unique(values[ends[k] : ends[k + 1]])
                rank = frequency[own >> np.uint64(64 - COUNTER_BITS)] << np.uint64(40) | own >> np.uint64(24)
                ids.append(set_id)
                held.append(own[np.argsort(rank, kind="stable")])
                full += len(own)
                if len(held) >= BLOCK_ROWS or full >= BLOCK_TOKENS:
                    yield block()
                    ids, held, full = [], [], 0
        if held:
            yield block()

    out = T.StructType([T.StructField("ids", T.ArrayType(kind)), T.StructField("sizes", T.BinaryType()), T.StructField("tokens", T.BinaryType())])
    return tokens.mapInArrow(run, out).withColumn("block", F.monotonically_increasing_id())


class _Block:
    """Sets of one block, and their prefixes as postings in the order of the sets."""

    def __init__(self, sizes: bytes, tokens: bytes, level: float):
        self.n = np.frombuffer(sizes, "<i4").astype(np.int64)
        self.tokens = np.frombuffer(tokens, "<u8")
        self.start = np.cumsum(self.n) - self.n
        # subtract a hair so that floating point never shortens a prefix
        least = np.ceil(self.n * level - 1e-9).astype(np.int64)
        self.wanted = np.maximum(1, np.minimum(SHARED, least))
        lengths = np.minimum(self.n, self.n - least + self.wanted)
        self.ends, self.rest = np.cumsum(lengths), self.n - lengths
        self.owner = np.repeat(np.arange(len(lengths)), lengths)
        token = self.tokens[np.arange(len(self.owner)) + np.repeat(self.start - self.ends + lengths, lengths)]
        self.order = np.argsort(token, kind="stable")
        self.listed, self.listed_owner = token[self.order], self.owner[self.order]
        # where the list of the token at each place ends
        changes = np.flatnonzero(np.append(self.listed[1:] != self.listed[:-1], True)) + 1
        self.list_end = np.repeat(changes, np.diff(changes, prepend=0))

    def set(self, k: int) -> np.ndarray:
        return self.tokens[self.start[k] : self.start[k] + self.n[k]]


def _candidates(left: _Block, right: _Block, same: bool, level: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the sets that share as many prefix tokens as near sets must, some left sets at a time."""
    at = np.searchsorted(right.listed, left.listed)  # both in order, so neighbours are found side by side
    inside = np.minimum(at, len(right.listed) - 1)
    low, met = np.empty_like(at), np.empty_like(at)
    low[left.order] = at
    met[left.order] = np.where(right.listed[inside] == left.listed, right.list_end[inside] - inside, 0)
    total = np.concatenate(([0], np.cumsum(met)))[left.ends]
    first, width = 0, len(right.n)
    while first < len(left.n):
        done = total[first - 1] if first else 0
        last = int(np.searchsorted(total, done + CHUNK_PAIRS, "right"))
        last = max(first + 1, min(last, first + CHUNK_CELLS // width))
        postings = slice(left.ends[first - 1] if first else 0, left.ends[last - 1])
        times = met[postings]
        place = np.repeat(low[postings] - np.cumsum(times) + times, times)
        place += np.arange(len(place))
        cell = np.repeat((left.owner[postings] - first) * width, times)
        cell += right.listed_owner[place]
        found = np.bincount(cell, minlength=(last - first) * width).reshape(-1, width)
        x, y = np.nonzero((found >= right.wanted) | (found >= left.wanted[first:last, None]))
        found, x = found[x, y], x + first
        nx, ny = left.n[x], right.n[y]
        # a common token that one prefix lacks lies behind the prefix that ends first
        fit = found + np.maximum(left.rest[x], right.rest[y]) >= (nx + ny) * (level / (1.0 + level)) - 1e-9
        fit &= np.minimum(nx, ny) >= np.maximum(nx, ny) * level - 1e-9
        if same:
            fit &= x < y
        yield x[fit], y[fit]
        first = last


def neighbor_sets(sets: DataFrame, cutoff: float) -> DataFrame:
    """Pairs of distinct sets with Jaccard similarity of at least 1 - cutoff, each once (a < b).

    Tokens are ordered by frequency, rarest first, and two sets that similar must
    share ``SHARED`` tokens (or all that are needed) in their prefixes, which are as
    many tokens longer; lengths prune the rest. Sets are packed into
    blocks and every two blocks meet in a task, which finds the pairs of its sets,
    some at a time, and compares them: pairs that are not near never leave it.
    Nothing but the blocks is written, so the disk grows as the sets and their near
    pairs, and the work with the square of the blocks.

    Tokens are compared by 64-bit hashes; among 100 million different tokens the
    chance that any two have one hash is about 3 in 10 000.
    """
    level = 1.0 - cutoff
    tokens = sets.where("set_id IS NOT NULL").select("set_id", F.transform("items", lambda t: F.xxhash64(t)).alias("tokens"))
    shared = sets.sparkSession.sparkContext.broadcast(_frequencies(tokens))  # its size is fixed
    blocks = materialize(_blocks(tokens, shared), "set-blocks", **LARGE_ROWS)
    kind = sets.schema["set_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[int, _Block]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                at = {c: batch.column(c)[row] for c in batch.schema.names}
                blocks = [at[f"{e}_block"].as_py() for e in "xy"]
                for e, block in zip("xy", blocks):
                    if e not in held or held[e][0] != block:
                        held[e] = block, _Block(at[f"{e}_sizes"].as_py(), at[f"{e}_tokens"].as_py(), level)
                left, right = held["x"][1], held["y"][1]
                ids = [at[f"{e}_ids"].values for e in "xy"]
                for x, y in _candidates(left, right, blocks[0] == blocks[1], level):
                    common = np.fromiter((_common(left.set(i), right.set(j)) for i, j in zip(x, y)), np.int64, len(x))
                    union = left.n[x] + right.n[y] - common
                    near = common / union >= level - 1e-9
                    if near.any():
                        yield pa.RecordBatch.from_arrays(
                            [ids[0].take(pa.array(x[near])), ids[1].take(pa.array(y[near])), pa.array(common[near]), pa.array(union[near])],
                            names=["x", "y", "common", "union"],
                        )

    ends = [blocks.select([F.col(c).alias(f"{e}_{c}") for c in blocks.columns]) for e in "xy"]
    out = T.StructType([T.StructField(c, k) for c, k in (("x", kind), ("y", kind), ("common", T.LongType()), ("union", T.LongType()))])
    conf = sets.sparkSession.conf
    before = {k: conf.get(k) for k in BLOCK_SETTINGS}
    for k, v in BLOCK_SETTINGS.items():
        conf.set(k, v)
    try:
        met = ends[0].join(ends[1], F.col("x_block") <= F.col("y_block")).mapInArrow(run, out)
        near = materialize(
            met.where("x <> y").select(
                F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.col("common") / F.col("union")).alias("similarity")
            ),
            "near-candidates",
        )
    finally:
        for k, v in before.items():
            conf.set(k, v)
    discard(blocks)
    return near


def _common(a: np.ndarray, b: np.ndarray) -> int:
    both = np.sort(np.concatenate((a, b)))
    return int((both[1:] == both[:-1]).sum())


def neighbors(df: DataFrame, key: str, tokens: str, cutoff: float = 0.4) -> DataFrame:
    """Neighbour pairs between distinct token sets, named by their smallest keys.

    Rows with equal sets share a ``set_id`` (see ``set_members``), so copies are
    listed once per row and never as pairs.
    """
    sets = materialize(distinct_sets(df, key, tokens), "token-sets")
    return neighbor_sets(sets, cutoff)


def set_members(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, set_id) of every row with tokens; set_id is the smallest key of its set."""
    # Written once, since both sides of the join below read it and tokens are dear to cut.
    rows = materialize(
        df.where(F.size(tokens) > 0).select(
            key, F.sha2(F.to_json(F.array_sort(F.array_distinct(tokens))), 256).alias("_digest")
        ),
        "set-digests",
    )
    first = rows.groupBy("_digest").agg(F.min(key).alias("set_id"))
    return rows.join(first, "_digest").select(key, "set_id")


def leader_sets(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """(set_id, leader): greedy clusters by neighbour count, largest first, then smallest key.

    The greedy order has a parallel form: in every round each undecided set that
    precedes all its undecided neighbours leads, and its neighbours are taken.
    Every round is written, and what it supersedes is deleted. A taken set joins its first leader.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weights = sets.select("set_id", "members")
    counted = (
        both.join(weights.withColumnRenamed("set_id", "b"), "b")
        .groupBy("a")
        .agg(F.sum("members").alias("near"))
    )
    rank = F.struct((-(F.col("members") - 1 + F.coalesce("near", F.lit(0)))).alias("size"), F.col("set_id"))
    nodes = materialize(
        weights.join(counted, F.col("set_id") == F.col("a"), "left").select("set_id", rank.alias("rank")), "leader-nodes"
    )
    graph = materialize(
        both.join(nodes.select(F.col("set_id").alias("a"), F.col("rank").alias("rank_a")), "a")
        .join(nodes.select(F.col("set_id").alias("b"), F.col("rank").alias("rank_b")), "b"),
        "leader-graph",
    )
    leads: list[DataFrame] = []
    open_nodes, open_graph = nodes, graph
    while not open_nodes.isEmpty():
        preceded = open_graph.where(F.col("rank_b") < F.col("rank_a")).select(F.col("a").alias("set_id"))
        leaders = materialize(open_nodes.join(preceded.distinct(), "set_id", "left_anti"), "leaders")
        leads.append(leaders)
        taken = open_graph.join(leaders.select(F.col("set_id").alias("b")), "b", "left_semi").select(
            F.col("a").alias("set_id")
        )
        closed = taken.union(leaders.select("set_id")).distinct()
        before, open_nodes = (open_nodes, open_graph), materialize(open_nodes.join(closed, "set_id", "left_anti"), "leader-nodes")
        still = open_nodes.select("set_id")
        open_graph = materialize(
            open_graph.join(still.withColumnRenamed("set_id", "a"), "a", "left_semi").join(
                still.withColumnRenamed("set_id", "b"), "b", "left_semi"
            ),
            "leader-graph",
        )
        if before[0] is not nodes:
            discard(*before)
    if not leads:
        return nodes.select("set_id", F.col("set_id").alias("leader"))
    chosen = reduce(lambda x, y: x.union(y), leads).select("set_id")
    joined = (
        graph.join(chosen.withColumnRenamed("set_id", "b"), "b", "left_semi")
        .groupBy(F.col("a").alias("set_id"))
        .agg(F.min_by("b", "rank_b").alias("leader"))
        .join(chosen, "set_id", "left_anti")
    )
    return joined.union(chosen.select("set_id", F.col("set_id").alias("leader")))


def leader_clusters(df: DataFrame, key: str, tokens: str, cutoff: float = 0.4) -> DataFrame:
    """(key, cluster) for every row; rows without tokens get a label of their own."""
    sets = materialize(distinct_sets(df, key, tokens), "token-sets")
    led = leader_sets(sets, materialize(neighbor_sets(sets, cutoff), "set-edges"))
    labelled = set_members(df, key, tokens).join(led, "set_id").select(
        key, F.concat(F.lit("cluster_"), F.col("leader").cast("string")).alias("cluster")
    )
    invalid = df.where(F.coalesce(F.size(tokens), F.lit(-1)) <= 0).select(
        key, F.concat(F.lit("__invalid_"), F.col(key).cast("string")).alias("cluster")
    )
    return labelled.unionByName(invalid)


def cluster_preview(df: DataFrame, key: str, settings: dict[str, tuple[str, float]]) -> DataFrame:
    """Groups and rows of alternative (token column, cutoff) settings."""
    parts = []
    for name, (tokens, cutoff) in settings.items():
        labels = leader_clusters(df, key, tokens, cutoff)
        parts.append(
            labels.agg(F.countDistinct("cluster").alias("groups"), F.count(F.lit(1)).alias("rows"))
            .select(F.lit(name).alias("setting"), "groups", "rows")
        )
    return reduce(lambda a, b: a.unionByName(b), parts)


def group_labels(df: DataFrame, group: str, ordinal: str, out: str = "group_label") -> DataFrame:
    """Group label, unique per row where the group is missing."""
    unique = F.concat(F.lit("__unique_"), F.col(ordinal).cast("string"))
    return df.withColumn(out, F.coalesce(F.nullif(F.col(group).cast("string"), F.lit("")), unique))
