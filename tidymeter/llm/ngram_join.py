"""N-gram Jaccard join with prefix filters under several global token orders.

A text is its set of distinct word 4-grams, as 64-bit hashes. Equal sets fold into
one class first. Two sets of Jaccard 0.85 or more share a token among the first
n - ceil(0.85 n) + 1 tokens of either, under *any* order of the tokens. Three
orders are used; all of them go by the frequency of a token (the lower estimate of two
sketches of fixed size, of words and of tokens: a token is never more frequent than a
word in it) and, within a class of frequencies, by another hash each.

1. Prefixes under all orders are written; those of the first order are the postings.
2. Of each posting list, two centres are paired with every member (linear, however
   long the list). Pairs whose sizes or whose prefixes under the second and third
   order do not meet are dropped, the rest is verified on the whole sets.
3. Verified links form components. Lists whose members lie in one component are
   settled. In the others, a member with little of its own is paired with the members
   of other components, a few times over.
4. In what is left, all members of different components are paired where their places
   in the first order allow it, filtered by the further orders, and verified.

No list, class or component is gathered in one task, and nothing is capped. Where
very many *different* texts consist almost wholly of the same frequent 4-grams,
step 4 is still quadratic in their number.

Defined cases: null and empty texts have no set, link with nothing and are their
own component; with fewer than four words the whole sequence is one token; rows
with equal ids are rows of their own; a row without an id takes the component of
its class; other columns are not read by ``link``.

Hashes: sets are named by 64 bits of a digest. Among a billion different sets the
chance of any clash is about 3 in 100.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidymeter.llm.bloom import bloom_filter, in_bloom
from tidymeter.llm.components import components
from tidymeter.llm.text import by_bytes, hashes, mix, ngram_hashes, utf8, words_of
from tidymeter.session import discard, materialize

WORDS = 4
PERCENT = 85
ORDERS = 3
ROUNDS = 2  # of further stars around members with little of their own
FURTHER = [f"p{k}" for k in range(1, ORDERS)]
SKETCH_BITS = (16, 21)  # least and most
BYTES_PER_COUNTER = 64
SLICES = 16
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1_000


@dataclass(frozen=True)
class Rule:
    words: int = WORDS
    percent: int = PERCENT

    def prefix(self, n: int) -> int:
        return n - (self.percent * n + 99) // 100 + 1

    def places_fit(self, a, b, at_a, at_b):
        """Whether sets of sizes a and b can be near if their first common token is number at_a and at_b.

        What stands before the first common token is in one set only. For later
        common tokens the bound is lower, so a pair passes if its first one does.
        """
        return (100 + self.percent) * F.least(a - at_a, b - at_b) >= self.percent * (a + b)

    def sizes_fit(self, a, b):
        return 100 * F.least(a, b) >= self.percent * F.greatest(a, b)


def token_set(raw: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text."""
    words = words_of(raw)
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(ngram_hashes(hashes(words), min(n, len(words))))


def _ranked_set(raw: bytes | None, n: int, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token set, and the frequency class of each token: that of its rarest word, or its own if that is lower."""
    words = words_of(raw)
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.uint8)
    h, n = hashes(words), min(n, len(words))
    by_word, by_token = classes
    own = by_word[_counter(h, by_word)]
    rarest = own[: len(h) - n + 1]
    for k in range(1, n):
        rarest = np.minimum(rarest, own[k : len(h) - n + 1 + k])
    tokens, at = np.unique(ngram_hashes(h, n), return_index=True)
    return tokens, np.minimum(rarest[at], by_token[_counter(tokens, by_token)])


def _counter(h: np.ndarray, counters: np.ndarray) -> np.ndarray:
    """Place of each word hash among a power of two of counters."""
    return (h >> np.uint64(65 - len(counters).bit_length())).astype(np.int64)


def set_name(tokens: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes()))))


def _prefix(tokens: np.ndarray, rarest: np.ndarray, rule: Rule, order: int) -> np.ndarray:
    """The first tokens under one order, sorted by it: frequency class first, then a scrambled hash."""
    rank = rarest.astype(np.uint64) << np.uint64(56) | mix(tokens, order) >> np.uint64(8)
    return tokens[np.argsort(rank)[: rule.prefix(len(tokens))]]


def _sketch_bits(df: DataFrame) -> int:
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max(size // BYTES_PER_COUNTER, 1).bit_length(), SKETCH_BITS[1]) if size >> SKETCH_BITS[0] else SKETCH_BITS[0]


def _signatures(slim: DataFrame, rule: Rule, bits: int) -> DataFrame:
    """Per row its set name and size; per task, ``SLICES`` rows that count the rows of each word and token hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << bits), np.int64)
        kind = None
        for batch in chain.from_iterable(map(by_bytes, batches)):
            kind = batch.schema.field("id").type
            names, sizes, seen = [], [], ([np.empty(0, np.int64)], [np.empty(0, np.int64)])
            for raw in utf8(batch.column("text")):
                words = words_of(raw)
                h = hashes(words)
                tokens = np.unique(ngram_hashes(h, min(rule.words, len(h)))) if words else h
                sizes.append(len(tokens))
                names.append(set_name(tokens) if len(tokens) else None)
                seen[0].append(np.unique(_counter(h, counts[0])))
                seen[1].append(_counter(tokens, counts[1]))
            n = batch.num_rows
            for own, places in zip(counts, seen):
                own += np.bincount(np.concatenate(places), minlength=len(own))
            yield _record(batch.column("id"), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), n)
        if kind is not None and counts.any():
            parts = np.minimum(counts, 255).astype(np.uint8).reshape(SLICES, -1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(SLICES, kind), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()),
                    pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary()),
                ],
                names=["id", "name", "n", "slice", "counts"],
            )

    def _record(ids, names, sizes, n):
        return pa.RecordBatch.from_arrays(
            [ids, names, sizes, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
            names=["id", "name", "n", "slice", "counts"],
        )

    schema = T.StructType(
        [T.StructField("id", slim.schema["id"].dataType), T.StructField("name", T.LongType()), T.StructField("n", T.LongType()),
         T.StructField("slice", T.IntegerType()), T.StructField("counts", T.BinaryType())]
    )
    return slim.mapInArrow(run, schema)


def _classes(signatures: DataFrame, bits: int) -> np.ndarray:
    """Frequency classes of the word counters and of the token counters, one byte each."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(raw, np.uint8).astype(np.int64)
        # Steps of about a fifth, so that rare words are told apart too.
        steps = [np.minimum(np.log2(np.maximum(x, 1)) * 4, 255).astype(np.uint8) for x in sums.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(sums, pa.int32()), pa.array([x.tobytes() for x in steps], pa.binary())], names=["slice", "classes"]
        )

    parts = signatures.filter("slice IS NOT NULL").select("slice", "counts")
    rows = parts.repartition(SLICES, "slice").mapInArrow(add, "slice int, classes binary").collect()  # one byte per counter
    classes = np.zeros(2 << bits, np.uint8)
    width = len(classes) // SLICES
    for r in rows:
        classes[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["classes"], np.uint8)
    return classes.reshape(2, -1)


def _prefixes(slim: DataFrame, rule: Rule, shared) -> DataFrame:
    """(name, n, p0, p1, ..), once per set and task: prefix tokens under every order.

    ``p0`` holds whole tokens; the others are cut to 16 bits, which lets a few
    pairs more through the filter but never drops one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, seen = shared.value, set()
        for batch in chain.from_iterable(map(by_bytes, batches)):
            rows: list[list] = [[] for _ in range(3 + len(FURTHER))]
            for raw in utf8(batch.column("text")):
                own, rarest = _ranked_set(raw, rule.words, classes)
                if not len(own) or (name := set_name(own)) in seen:
                    continue
                seen.add(name)
                further = [_prefix(own, rarest, rule, k) >> np.uint64(48) for k in range(1, ORDERS)]
                values = [
                    name, len(own), _prefix(own, rarest, rule, 0).view(np.int64),
                    *(np.unique(p).astype("<u2").tobytes() for p in further),
                ]
                for column, value in zip(rows, values):
                    column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * len(FURTHER)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(r, k) for r, k in zip(rows, kinds)], names=["name", "n", "p0", *FURTHER]
            )

    columns = ", ".join(f"{p} binary" for p in FURTHER)
    return slim.select("text").mapInArrow(run, f"name long, n int, p0 array<long>, {columns}")


def _of_pairs(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets that stand in a pair, so that no other set is shuffled for a join with the pairs."""
    names = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    shared = sets.sparkSession.sparkContext.broadcast(bloom_filter(names))  # its size is bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bloom(batch.column("name"), shared.value)))

    return sets.mapInArrow(run, sets.schema)


def _sets(slim: DataFrame, rule: Rule, shared) -> DataFrame:
    """(name, short, tokens) of the rows whose id the shared Bloom filter holds; ``short`` has 16 bits of each token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch.filter(pa.array(in_bloom(batch.column("key"), shared.value)))):
                sets = [t for t in (token_set(raw, rule.words) for raw in utf8(part.column("text"))) if len(t)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(map(set_name, sets), pa.int64()),
                        pa.array([(t >> np.uint64(48)).astype("<u2").tobytes() for t in sets], pa.binary()),
                        pa.array([t.tobytes() for t in sets], pa.binary()),
                    ],
                    names=["name", "short", "tokens"],
                )

    return slim.select(F.xxhash64("id").alias("key"), "text").mapInArrow(run, "name long, short binary, tokens binary")


def _beside(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of both ends of every pair, as a_x and b_x."""
    for end in ("a", "b"):
        side = sets.select(F.col("name").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns])
        pairs = pairs.join(side, end)
    return pairs


def _meeting(pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Pairs whose prefixes share a token under every further order too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(by_bytes, batches)):
            keep = np.ones(batch.num_rows, bool)
            for c in FURTHER:
                ends = zip(batch.column(f"a_{c}").to_pylist(), batch.column(f"b_{c}").to_pylist())
                keep &= np.fromiter((_overlap(x, y, "<u2") > 0 for x, y in ends), bool, batch.num_rows)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    both = _beside(pairs, prefixes, FURTHER).select("a", "b", *[f"{e}_{c}" for e in "ab" for c in FURTHER])
    return both.mapInArrow(run, "a long, b long")


def _overlap(x: bytes, y: bytes, kind: str) -> int:
    a, b = np.frombuffer(x, kind), np.frombuffer(y, kind)
    both = np.sort(np.concatenate((a, b)), kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _common(x: bytes, y: bytes, kind: str) -> int:
    """Size of the intersection of two sorted multisets."""
    a, b = np.frombuffer(x, kind), np.frombuffer(y, kind)
    # The k-th repeat of a value only meets the k-th repeat on the other side.
    keys = [(v.astype(np.uint64) << np.uint64(32)) + (np.arange(len(v)) - np.searchsorted(v, v)).astype(np.uint64) for v in (a, b)]
    both = np.sort(np.concatenate(keys), kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _reaching(pairs: DataFrame, sets: DataFrame, rule: Rule, column: str) -> DataFrame:
    """Pairs that reach the Jaccard bound on a column of the sets.

    On ``short``, tokens may meet that differ, so no pair is lost; on ``tokens`` the test is exact.
    """
    percent, size = rule.percent, 2 if column == "short" else 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(by_bytes, batches)):
            keep = []
            for x, y in zip(batch.column(f"a_{column}").to_pylist(), batch.column(f"b_{column}").to_pylist()):
                common = _common(x, y, "<u2") if size == 2 else _overlap(x, y, "<u8")
                keep.append(100 * common >= percent * ((len(x) + len(y)) // size - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = _beside(pairs, sets, [column]).select("a", "b", f"a_{column}", f"b_{column}")
    return both.mapInArrow(run, "a long, b long").distinct()


def _stars(lists: DataFrame) -> DataFrame:
    """Both centres of every list with each of its members, once."""
    pairs = lists.select(F.explode(F.array("low", "high")).alias("centre"), "name").filter("centre <> name")
    return pairs.select(F.least("centre", "name").alias("a"), F.greatest("centre", "name").alias("b")).distinct()


def _mixed(rows: DataFrame) -> DataFrame:
    """The lists whose members lie in more than one component."""
    mixed = rows.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y")
    return rows.join(mixed.select("token"), "token", "left_semi")


def _hub_stars(rows: DataFrame, rule: Rule, turn: int) -> DataFrame:
    """One member of every list, with the members of other components, once.

    First the member with the least of its own before the common token, then, turn
    by turn, any of those with little of their own.
    """
    little = F.floor(F.col("at") / (4 if turn else 1))
    any_one = F.xxhash64("name", "token", F.lit(turn)) if turn else -F.col("degree")
    hub = rows.groupBy("token").agg(
        F.min(F.struct(little.alias("own"), any_one.alias("turn"), "name", "component", "n", "at")).alias("hub")
    )
    pairs = rows.join(hub, "token").filter(
        (F.col("hub.component") != F.col("component"))
        & rule.places_fit(F.col("hub.n"), F.col("n"), F.col("hub.at"), F.col("at"))
    )
    return pairs.select(
        F.least("hub.name", "name").alias("a"), F.greatest("hub.name", "name").alias("b")
    ).distinct()


def _across(rows: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of members of one list that lie in different components, where sizes and places fit."""
    other = rows.select("token", *[F.col(c).alias(f"o_{c}") for c in ("name", "n", "at", "component")])
    pairs = rows.join(other, "token").filter(
        (F.col("name") < F.col("o_name")) & (F.col("component") != F.col("o_component"))
        & rule.places_fit(F.col("n"), F.col("o_n"), F.col("at"), F.col("o_at"))
    )
    return pairs.select(F.col("name").alias("a"), F.col("o_name").alias("b")).distinct()


def link(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """Per input row: id, n_shingles and component_id (least id reachable by links).

    The Python steps all run inside this call; while it lasts, Arrow batches are
    kept small, since texts and sets are wide rows.
    """
    conf = df.sparkSession.conf
    before = conf.get(BATCH_SETTING)
    conf.set(BATCH_SETTING, str(min(int(before), BATCH_ROWS)))
    try:
        return _linked(df, id_col, text_col, Rule(words, percent))
    finally:
        conf.set(BATCH_SETTING, before)


def _linked(df: DataFrame, id_col: str, text_col: str, rule: Rule) -> DataFrame:
    spark = df.sparkSession
    slim = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    bits = _sketch_bits(slim)
    signatures = materialize(_signatures(slim, rule, bits), "signatures")
    shared = spark.sparkContext.broadcast(_classes(signatures, bits))  # one byte per counter
    rows = signatures.filter("slice IS NULL").select("id", "name", "n")
    least = rows.filter("name IS NOT NULL").groupBy("name").agg(F.min("id").alias("least_id"))
    links = _links(spark, slim, least, rule, shared)
    grouped = least.join(components(links).withColumnRenamed("node", "name"), "name", "left")
    top = grouped.groupBy(F.coalesce("component", "name").alias("component")).agg(F.min("least_id").alias("component_id"))
    named = materialize(
        grouped.select("name", F.coalesce("component", "name").alias("component")).join(top, "component")
        .select("name", "component_id"),
        "named",
    )
    return rows.join(named, "name", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("name").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def _links(spark: SparkSession, slim: DataFrame, least: DataFrame, rule: Rule, shared) -> DataFrame:
    """Verified links between set names, enough to connect every component."""
    prefixes = materialize(_prefixes(slim, rule, shared), "prefixes")
    postings = prefixes.select("name", "n", F.posexplode("p0").alias("at", "token"))
    centre = postings.groupBy("token").agg(F.min("name").alias("low"), F.max("name").alias("high")).filter("low <> high")
    lists = materialize(postings.join(centre, "token").distinct(), "lists")
    # Sets copied into several tasks have several equal rows of prefixes.
    involved = lists.select("name").distinct()
    further = prefixes.select("name", "n", *FURTHER).join(involved, "name", "left_semi").dropDuplicates(["name"])
    further = materialize(further, "further")
    wanted = materialize(further.join(least, "name").select(F.xxhash64("least_id").alias("key")), "wanted")
    bloom = spark.sparkContext.broadcast(bloom_filter(wanted))  # its size is bounded
    sets = materialize(_sets(slim, rule, bloom), "sets")
    discard(prefixes, wanted)

    def linked(pairs: DataFrame) -> DataFrame:
        sized = _beside(pairs, further, ["n"]).filter(rule.sizes_fit(F.col("a_n"), F.col("b_n"))).select("a", "b")
        close = materialize(_meeting(sized, further), "close")
        likely = materialize(_reaching(close, _of_pairs(sets.select("name", "short"), close), rule, "short"), "likely")
        out = materialize(_reaching(likely, _of_pairs(sets.select("name", "tokens"), likely), rule, "tokens"), "links")
        discard(close, likely)
        return out

    def placed(links: DataFrame) -> DataFrame:
        """List members of lists that more components share, with component and number of links."""
        known = components(links).withColumnRenamed("node", "name")
        degree = links.select(F.explode(F.array("a", "b")).alias("name")).groupBy("name").agg(F.count("*").alias("degree"))
        rows = lists.select("token", "name", "n", "at").join(known, "name", "left").join(degree, "name", "left")
        return _mixed(rows.withColumn("component", F.coalesce("component", "name")).fillna(0, ["degree"]))

    tested = materialize(_stars(lists), "tested")
    links = linked(tested)
    for turn in range(ROUNDS):
        rows = materialize(placed(links), "placed")
        if rows.isEmpty():
            break
        pairs = materialize(_hub_stars(rows, rule, turn).join(tested, ["a", "b"], "left_anti"), "pairs")
        found = linked(pairs)
        tested, links = tested.union(pairs), links.union(found)
    # Two centres pair all members of a list of up to three; what the stars left over is paired in full.
    across = materialize(_across(placed(links), rule).join(tested, ["a", "b"], "left_anti"), "across")
    out = links if across.isEmpty() else links.union(linked(across))
    discard(lists, further, sets, across)
    return out


def deduplicate(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """One row of each component of ``df``: the least by (id, digest of the text), rows without an id last.

    Rows are told apart by id and text, so an id may stand on several texts or be
    null. Rows of one id and text with a set of shingles stay once; rows without a
    set all stay.
    """
    own_id, digest = F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`").cast("string"))
    key = F.struct(own_id.isNull().alias("no_id"), own_id.alias("id"), digest.alias("digest")).alias("key")
    keyed = df.select(key, F.col(f"`{text_col}`").alias("text"))
    linked = materialize(link(keyed, "key", "text", words, percent), "linked")
    first = F.col("key").eqNullSafe(F.col("component_id"))
    # The input row rides in a struct, so that its columns cannot clash with those of the joins.
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), own_id.alias("id"), digest.alias("digest"))
    kept = _lacking(whole, linked.filter(~first))
    repeated = linked.filter("n_shingles > 0").filter(first).groupBy("key").count().filter("count > 1")
    if not repeated.isEmpty():
        keys = _keys(repeated)
        once = whole.join(keys, _same(whole, keys), "left_semi").dropDuplicates(["id", "digest"])
        kept = _lacking(kept, repeated).unionByName(once)
    return kept.select(*[F.col("row")[c].alias(c) for c in df.columns])


def _keys(linked: DataFrame) -> DataFrame:
    return linked.select(F.col("key.id").alias("key_id"), F.col("key.digest").alias("key_digest")).distinct()


def _same(whole: DataFrame, keys: DataFrame):
    return whole["id"].eqNullSafe(keys["key_id"]) & (whole["digest"] == keys["key_digest"])


def _lacking(whole: DataFrame, linked: DataFrame) -> DataFrame:
    keys = _keys(linked)
    return whole.join(keys, _same(whole, keys), "left_anti")
