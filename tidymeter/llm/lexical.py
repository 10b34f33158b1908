"""Ranked lexical search with the Best Position Algorithm.

A first pass counts, per document, its terms and how often the terms of the items
occur; from these postings come the totals and document frequencies. The postings are
then searched in blocks: every block of documents has one impact list per term of
an item, ordered by the term's contribution, highest first. For each item the lists
are read from the top, some positions at a time; a document that comes up is looked
up in all lists of the item (direct access), which completes its score and marks its
place in each list as seen. The best position of a list is the end of its seen
prefix, and the contributions there bound every unseen document. Seen places include
those of direct accesses, so the bound is tighter than one from the positions last
read. The search of a block stops once the bound lies strictly below the score of
the item's last ranked document, so that ties are still decided by id.

A task carries each item's last ranked score from block to block and returns few
rows per item and block; these are ranked in two windows, one per item and group of
tasks and one per item. The work is split by documents, so a frequent term or a hot
source is spread evenly; no list is ever gathered. Items are taken in portions of at most
``BLOCK_TERMS`` terms, which bounds what is broadcast; all numbers are 64-bit.

Defined cases: a null or empty text holds no terms, as document or as item; an item
without terms or without a match has no rows; equal scores rank by ascending id, null
ids last; rows with equal ids are ranked one by one, items with equal ids too; an
empty table or an empty benchmark gives no rows; only id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tidymeter.llm.decontaminate import normalised
from tidymeter.llm.text import by_bytes, utf8
from tidymeter.session import materialize

TOP = 50
B_PERCENT = 50  # weight of the length in the score
BLOCK_TERMS = 100_000
BLOCK_POSTINGS = 2_000_000
FIRST_READ = 64
GROUPS = 256


def portions(items: DataFrame, item_col: str, text_col: str, block_terms: int = BLOCK_TERMS) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items with their distinct terms, in portions of about ``block_terms`` terms."""
    size = F.octet_length(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    slim = items.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # A term takes two bytes or more, with the blank behind it.
    blocks = max(1, -(-(items.agg(F.sum(size)).first()[0] or 0) // (2 * block_terms)))
    for b in range(blocks):
        own = slim.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        out = [(r["item"], sorted(set(normalised((r["text"] or "").encode()).split()))) for r in own.collect()]
        yield [(i, terms) for i, terms in out if terms]


def postings(df: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tfs) per document that has terms; only those of the vocabulary are listed."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    slim = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in (part for whole in batches for part in by_bytes(whole)):
            keep, sizes, terms, tfs, ends = [], [], [], [], [0]
            for row, raw in enumerate(utf8(batch.column("text"))):
                words = normalised(raw).split()
                if not words:
                    continue
                found = [i for i in map(known.get, words) if i is not None]
                ids, counts = np.unique(np.array(found, np.int32), return_counts=True)
                keep.append(row)
                sizes.append(len(words))
                terms.append(ids)
                tfs.append(counts.astype(np.int32))
                ends.append(ends[-1] + len(ids))
            at = pa.array(ends, pa.int32())
            joined = [np.concatenate(x) if x else np.empty(0, np.int32) for x in (terms, tfs)]
            lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in joined]
            ids = batch.column("id").take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), *lists], names=["id", "n", "terms", "tfs"])

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, n long, terms array<int>, tfs array<int>")


def document_frequencies(found: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """(documents, terms in all, documents per term); every task counts its own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total, rows = np.zeros(terms, np.int64), 0, 0
        for batch in batches:
            df += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=terms)
            total += pc.sum(batch.column("n")).as_py() or 0
            rows += batch.num_rows
        some = np.flatnonzero(df)
        names = np.concatenate((some, [-1, -2]))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(np.concatenate((df[some], [rows, total])), pa.int64())], names=["term", "df"])

    counted = found.select("n", "terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    out, rest = np.zeros(terms, np.int64), {-1: 0, -2: 0}
    for r in counted.collect():  # one row per term of the portion
        if r["term"] < 0:
            rest[r["term"]] = r["df"]
        else:
            out[r["term"]] = r["df"]
    return rest[-1], rest[-2], out


class Lists:
    """Impact lists of one block of documents.

    List t covers ``at[t]:at[t + 1]``. ``docs`` and ``place`` go by ascending
    document: the document and its place in the order by impact; ``by_impact``
    gives the entries by descending impact.
    """

    def __init__(self, n: np.ndarray, ends: np.ndarray, terms: np.ndarray, tfs: np.ndarray, size: int, n_docs: int, n_terms: int):
        m = 100 - B_PERCENT + (B_PERCENT * n * n_docs) // n_terms
        doc = np.repeat(np.arange(len(n), dtype=np.int64), np.diff(ends))
        impact = (1_000_000_000 * tfs) // (1000 * tfs + 20 * m[doc])
        order = np.lexsort((doc, terms))
        self.docs, self.impact, owner = doc[order], impact[order], terms[order]
        self.at = np.searchsorted(owner, np.arange(size + 1))
        self.by_impact = np.lexsort((self.docs, -self.impact, owner))
        self.place = np.empty(len(order), np.int64)
        self.place[self.by_impact] = np.arange(len(order))
        self.score = np.zeros(len(n), np.int64)
        self.known = np.zeros(len(n), bool)
        self.seen = np.zeros(len(order), bool)

    def best(self, query: list[tuple[int, int]], top: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) among which are the block's share of the ``top``, those below ``floor`` left out.

        ``query`` holds (term, weight), weights above 0.
        """
        lists = [(w, self.at[t], self.at[t + 1]) for t, w in query if self.at[t] < self.at[t + 1]]
        found, best, read = [], [a for _, a, _ in lists], 0
        step, last, marks = FIRST_READ, floor, []
        while True:
            # Sorted access: the next positions of every list.
            fresh = [self.docs[self.by_impact[a + read : min(a + read + step, b)]] for _, a, b in lists]
            new = np.unique(np.concatenate(fresh)) if fresh else np.empty(0, np.int64)
            new = new[~self.known[new]]
            self.known[new] = True
            # Direct access: the new documents in every list.
            total = np.zeros(len(new), np.int64)
            for w, a, b in lists:
                own = self.docs[a:b]
                spot = np.minimum(np.searchsorted(own, new), b - a - 1)
                hit = own[spot] == new
                entries = a + spot[hit]
                total[hit] += w * self.impact[entries]
                places = self.place[entries]
                self.seen[places] = True
                marks.append(places)
            self.score[new] = total
            found.append(new)
            read, step = read + step, step * 2
            every = np.concatenate(found)
            if len(every) >= top:
                last = max(last, int(np.partition(self.score[every], len(every) - top)[len(every) - top]))
            # Best positions, and the most that an unseen document can score.
            bound, open_lists = 0, False
            for k, (w, a, b) in enumerate(lists):
                gaps = np.flatnonzero(~self.seen[best[k] : b])
                best[k] = best[k] + gaps[0] if len(gaps) else b
                if best[k] < b:
                    open_lists = True
                    bound += w * int(self.impact[self.by_impact[max(best[k] - 1, a)]])
            if not open_lists or bound < last:
                break
        scores = self.score[every]
        good = (scores > 0) & (scores >= last if last > 0 else True)
        every, scores = every[good], scores[good]
        order = np.lexsort((every, -scores))[:top]
        chosen = every[order], scores[order]
        for places in marks:
            self.seen[places] = False
        self.known[np.concatenate(found)] = False
        return chosen


def _searched(found: DataFrame, shared, n_docs: int, n_terms: int, size: int, top: int, block_postings: int) -> DataFrame:
    """(item, id, score) candidates of every block."""
    kind = found.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        kept: list[np.ndarray] = [np.empty(0, np.int64)] * len(queries)
        for block in _blocks(batches, block_postings):
            # Documents in the order of their ids, so that ties go by position.
            block = block.take(pc.sort_indices(block, sort_keys=[("id", "ascending")], null_placement="at_end"))
            terms, tfs = block.column("terms").combine_chunks(), block.column("tfs").combine_chunks()
            ends = np.concatenate(([0], np.cumsum(pc.list_value_length(terms).to_numpy(zero_copy_only=False))))
            flat = [x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (terms, tfs)]
            lists = Lists(block.column("n").to_numpy(), ends, *flat, size, n_docs, n_terms)
            item, doc, score = [], [], []
            for k, query in enumerate(queries):
                floor = int(kept[k][-1]) if len(kept[k]) == top else 0
                docs, scores = lists.best(query, top, floor)
                kept[k] = -np.sort(-np.concatenate((kept[k], scores)))[:top]
                item.append(np.full(len(docs), k))
                doc.append(docs)
                score.append(scores)
            if not doc:
                continue
            ids = block.column("id").combine_chunks().take(pa.array(np.concatenate(doc), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(item), pa.int32()), ids, pa.array(np.concatenate(score), pa.int64())], names=["item", "id", "score"]
            )

    return found.mapInArrow(run, f"item int, id {kind}, score long")


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of about ``most`` postings."""
    held, size = [], 0
    for batch in (part for whole in batches for part in by_bytes(whole, 8 * most)):
        if not batch.num_rows:
            continue
        held.append(batch)
        size += len(batch.column("terms").flatten()) + batch.num_rows
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def search(
    df: DataFrame,
    items: DataFrame,
    top: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_terms: int = BLOCK_TERMS,
    block_postings: int = BLOCK_POSTINGS,
) -> DataFrame:
    """(item id, rank from 1, id, score): the ``top`` highest-scoring documents of every item."""
    spark = df.sparkSession
    out = None
    for portion in portions(items, item_col, item_text_col, block_terms):
        vocabulary: dict[bytes, int] = {}
        coded = [(item, [vocabulary.setdefault(t, len(vocabulary)) for t in terms]) for item, terms in portion]
        found = materialize(postings(df, vocabulary, id_col, text_col), "postings")
        n_docs, n_terms, df_of = document_frequencies(found, len(vocabulary))
        weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df_of]
        queries = [[(t, weight[t]) for t in terms if weight[t] > 0] for _, terms in coded]
        shared = spark.sparkContext.broadcast(queries)
        candidates = _searched(found, shared, n_docs, max(1, n_terms), len(vocabulary), top, block_postings)
        names = spark.createDataFrame(
            [(k, item) for k, (item, _) in enumerate(coded)], f"item int, item_id {items.schema[item_col].dataType.simpleString()}"
        )
        ranked = _ranked(candidates, top).join(F.broadcast(names), "item")  # at most BLOCK_TERMS rows
        part = ranked.select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")
        out = part if out is None else out.unionByName(part)
    return out


def _ranked(candidates: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of every item, among groups of tasks first."""
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    grouped = candidates.withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    some = grouped.withColumn("_n", F.row_number().over(Window.partitionBy("item", "_group").orderBy(*order))).where(F.col("_n") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
    return ranked.where(F.col("rank") <= top).select("item", "rank", "id", "score")
