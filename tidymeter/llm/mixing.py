"""Mixing sources to target weights along a low-discrepancy schedule, with DataFrame functions only.

Each source gets a target: its share of all words by weight, at most ``MOST``
times its own words; what is above goes to the others by weight. Its documents,
in the order of a seeded digest, are one stream of words that starts over at its
end, cut into blocks of ``BLOCK_WORDS`` words, of which the target takes the first.

The sources lie side by side on an axis of as many units as they take blocks
(cumulative weights). The points of the van der Corput sequence on that axis, in
their order, are the slots of the schedule: slot i falls on the unit whose binary
digits are those of i reversed, so every unit is hit once and each source is spread
evenly at every scale. The slots of a source are ranked, and its k-th slot is
joined with its k-th block. The last block ends at the target, so the words taken
are the rounded target.

Streams and ranks are running totals over ranges, so a hot source is many tasks;
equal rows are counted before they are placed. Only the two sums of each round of
sharing and the number of units reach the driver.

Defined cases: a null or empty text has size 0 and is never taken; a null source is
a source of its own, the last; rows with equal ids and equal rows are documents of
their own; a null id is an id; an empty table gives no rows; only the id, source and
text columns are read, whatever the others are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidymeter.llm.running import running_totals
from tidymeter.session import materialize

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_WORDS = 2048
SEED = "mix"
CHUNK = 1 << 16
WORD = r"[^\x20\x09-\x0D]++"
_BLANK = " \t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    """Number of words of a text, without an array of them: each becomes one letter, white space goes."""
    return F.length(F.translate(F.regexp_replace(text, WORD, "w"), _BLANK, "")).cast("long")


def documents(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = SEED) -> DataFrame:
    """(id, source, size, key, copies): distinct rows; ``key`` is the digest that shuffles them."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    name = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("-"))
    slim = df.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), n_words(text).alias("size"),
        F.md5(F.concat_ws("|", F.lit(seed), name, F.md5(text))).alias("key"),
    )
    return materialize(slim.groupBy("id", "source", "size", "key").agg(F.count(F.lit(1)).alias("copies")), "mix-documents")


def targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, place, weight, source_size, target, quota) per source; ``quota`` is the target in whole words."""
    sized = docs.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    placed = running_totals(sized, [], [F.col("source").isNull(), F.col("source")], F.lit(1), "place")
    by_place = F.array(*map(F.lit, weights))[F.pmod(F.col("place"), F.lit(len(weights))).cast("int")]
    sources = materialize(placed.withColumn("weight", by_place.cast("long")), "mix-sources")
    level = share_level(sources, most)
    target = F.least((most * F.col("source_size")).cast("double"), F.col("weight") * F.lit(level))
    out = sources.withColumn("target", target)
    quota = F.least(F.floor(F.col("target") + 0.5).cast("long"), most * F.col("source_size"))
    return out.withColumn("quota", quota)


def share_level(sources: DataFrame, most: int = MOST) -> float:
    """Words per unit of weight when capped sources keep their cap and the others share the rest.

    Every round finds the sources above their cap and shares anew; the level only
    rises, so the rounds end when no further source is above.
    """
    cap, weight = most * F.col("source_size"), F.col("weight")
    level = None
    while True:
        above = F.lit(False) if level is None else cap < weight * F.lit(level)
        got = sources.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(above, cap)).alias("capped"),
            F.sum(F.when(~above, weight)).alias("weight"),
        ).first()
        if not got["all"] or not got["weight"]:
            return level or 0.0
        new = (got["all"] - (got["capped"] or 0)) / got["weight"]
        if new == level:
            return level
        level = new


def schedule(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(slot, place, rank): the schedule in the order of ``slot``; slots are unique, with gaps."""
    n = F.floor((F.col("quota") + (block_words - 1)) / block_words).cast("long")
    sized = sources.select("place", n.alias("n")).filter("n > 0")
    axis = materialize(running_totals(sized, [], [F.col("place")], F.col("n"), "first"), "mix-axis")
    total = axis.agg(F.sum("n")).first()[0] or 0
    bits = max(1, (total - 1).bit_length()) if total else 1
    # Units of a source are listed chunk by chunk, so that a hot source is many tasks.
    last = F.col("first") + F.col("n")
    chunks = axis.select("place", last.alias("last"), F.explode(F.sequence("first", last - 1, F.lit(CHUNK).cast("long"))).alias("from"))
    spread = chunks.repartition("place", "from")
    units = spread.select("place", F.explode(F.sequence("from", F.least(F.col("from") + (CHUNK - 1), F.col("last") - 1))).alias("unit"))
    slots = units.select("place", F.conv(F.reverse(F.lpad(F.bin("unit"), bits, "0")), 2, 10).cast("long").alias("slot"))
    return running_totals(slots, ["place"], [F.col("slot")], F.lit(1), "rank")


def blocks(docs: DataFrame, sources: DataFrame, block_words: int = BLOCK_WORDS, most: int = MOST) -> DataFrame:
    """Stretches of documents in the blocks that the targets take.

    One row per document, round through the stream and block: (id, source, size,
    key, copy, place, source_size, target, rank, first, words); ``rank`` is null
    for a document that no block takes.
    """
    about = sources.select("source", "place", "source_size", "target", "quota")
    placed = running_totals(docs, ["source"], [F.col("key"), F.col("size")], F.col("size") * F.col("copies"), "start", about)
    single = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    begin = F.col("start") + F.col("copy") * F.col("size")

    def stretches(turn: Column) -> Column:
        a = begin + turn * F.col("source_size")
        b = F.least(a + F.col("size"), F.col("quota"))

        def one(rank: Column) -> Column:
            low, high = F.greatest(a, rank * block_words), F.least(b, (rank + 1) * block_words)
            return F.struct(rank.alias("rank"), (low - a).alias("first"), (high - low).alias("words"))

        ranks = F.sequence(F.floor(a / block_words), F.floor((b - 1) / block_words))
        return F.when(a < b, F.transform(ranks, one)).otherwise(F.array().cast("array<struct<rank:bigint,first:bigint,words:bigint>>"))

    every = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long")), stretches))
    return single.select(
        "id", "source", "size", "key", "copy", "place", "source_size", "target", F.explode_outer(every).alias("s")
    ).select("id", "source", "size", "key", "copy", "place", "source_size", "target", "s.rank", "s.first", "s.words")


def mix(
    df: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    block_words: int = BLOCK_WORDS,
    seed: str = SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """The mix: one row per stretch of a document, with the slot it stands in.

    Columns: those of ``blocks`` and ``slot``. Within a slot, stretches follow each
    other by ``key`` and ``copy``. A document that is not taken has one row without slot.
    """
    docs = documents(df, id_col, source_col, text_col, seed)
    sources = materialize(targets(docs, weights, most), "mix-targets")
    slots = schedule(sources, block_words)
    cut = blocks(docs, sources, block_words, most)
    return cut.join(slots.select("place", "rank", "slot"), ["place", "rank"], "left")


def taken(mixed: DataFrame) -> DataFrame:
    """Per document: id, source, size, source_size, target, taken (words the mix takes, repeats counted)."""
    row = ["id", "source", "size", "key", "copy", "source_size", "target"]
    words = F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("words"))), F.lit(0).cast("long"))
    return mixed.groupBy(*row).agg(words.alias("taken")).drop("key", "copy")


def texts(df: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED) -> DataFrame:
    """(slot, source, text): the words of every slot in the order of the schedule, joined by blanks."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    name = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("-"))
    whole = df.select(F.md5(F.concat_ws("|", F.lit(seed), name, F.md5(text))).alias("key"), text.alias("text")).dropDuplicates(["key"])
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    part = F.array_join(F.slice(words, F.col("first").cast("int") + 1, F.col("words").cast("int")), " ")
    cut = mixed.filter("slot IS NOT NULL").join(whole, "key").select(
        "slot", "source", F.struct("rank", "key", "copy", "first", part.alias("text")).alias("part")
    )
    # A slot holds at most one block of words.
    parts = F.array_sort(F.collect_list("part"))
    return cut.groupBy("slot", "source").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))
