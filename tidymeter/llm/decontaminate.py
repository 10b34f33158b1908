"""Benchmark decontamination with a generalised suffix automaton.

The automaton of all normalised items is built on the driver from a block of at
most ``BLOCK_WORDS`` words (a larger benchmark becomes more blocks, which the
documents pass one after another), and is broadcast; its size is bounded by the
block. Each task streams the words of its documents through it, tracks the
longest match that ends at every word, and marks the windows inside. Nothing is
shuffled.

Defined cases: a null or empty text has no words, no hits and is clean; an item
without words has no window; an empty benchmark hits nothing; rows with equal ids
are judged one by one, items with equal ids count once, and a null item id is the
empty string; other columns keep their values whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidymeter.llm.text import utf8
from tidymeter.session import cut_lineage

WINDOW = 13
COVERAGE = 20  # contaminated when COVERAGE * hit words >= words
BLOCK_WORDS = 100_000
PIECE_WORDS = 5_000

# Word bytes: digits, letters and all of non-ASCII; A-Z becomes a-z, the rest a blank.
_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def normalised(raw: bytes | None) -> bytes:
    """The text with one byte for each of its bytes, so that offsets stay."""
    return raw.translate(_TABLE) if raw else b""


class Automaton:
    """Suffix automaton of many word sequences, with the items behind each window.

    ``follow[v]`` maps a word id to a state, ``link`` and ``length`` are the
    suffix links and longest lengths. ``full[v]`` holds the items that contain
    the last ``window`` words of a match in ``v``; ``short[v]`` holds
    (length, item) of whole shorter items that end a match in ``v``.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.follow: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            coded.append((item, ids))
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.least = min((min(len(ids), window) for _, ids in coded if ids), default=0)
        self._mark(coded)

    def _extend(self, last: int, c: int) -> int:
        follow, link, length = self.follow, self.link, self.length
        if c in follow[last]:
            q = follow[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = self._state(length[last] + 1, {})
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = follow[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _state(self, length: int, follow: dict[int, int]) -> int:
        self.follow.append(follow)
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        twin = self._state(self.length[p] + 1, dict(self.follow[q]))
        self.link[twin], self.link[q] = self.link[q], twin
        while p >= 0 and self.follow[p].get(c) == q:
            self.follow[p][c] = twin
            p = self.link[p]
        return twin

    def _suffix(self, v: int, size: int) -> int:
        """The state of the last ``size`` words of a match in ``v``."""
        while self.length[self.link[v]] >= size:
            v = self.link[v]
        return v

    def _mark(self, coded: list[tuple[str, list[int]]]) -> None:
        n, window = len(self.link), self.window
        own: dict[int, set[str]] = {}
        ends: dict[int, list[tuple[int, str]]] = {}
        for item, ids in coded:
            v = 0
            for at, c in enumerate(ids, 1):
                v = self.follow[v][c]
                if at >= window:
                    own.setdefault(self._suffix(v, window), set()).add(item)
            if 0 < len(ids) < window:
                ends.setdefault(self._suffix(v, len(ids)), []).append((len(ids), item))
        self.full: list[tuple[str, ...]] = [()] * n
        self.short: list[tuple[tuple[int, str], ...]] = [()] * n
        sets = {v: tuple(sorted(x)) for v, x in own.items()}
        for v in sorted(range(1, n), key=self.length.__getitem__):
            self.short[v] = tuple(ends.get(v, ())) + self.short[self.link[v]]
            if self.length[v] >= window:
                self.full[v] = sets.get(self._suffix(v, window), ())

    def matches(self, words: list[bytes]) -> tuple[np.ndarray | None, set[str]]:
        """Which words lie in an occurring window (None: none), and the items behind."""
        n, least = len(words), self.least
        if not least or n < least:
            return None, set()
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32, n)
        # A word of no item leads back to the root, so only runs of known words count.
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).view(np.int8), [0]))))
        starts, stops = edges[::2], edges[1::2]
        long_enough = stops - starts >= least
        if not long_enough.any():
            return None, set()
        hit, items = None, set()
        for a, b in zip(starts[long_enough].tolist(), stops[long_enough].tolist()):
            for end, size, names in self._walk(ids[a:b].tolist()):
                if hit is None:
                    hit = np.zeros(n, bool)
                hit[a + end - size : a + end] = True
                items.update(names)
        return hit, items

    def _walk(self, ids: list[int]) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        """(end, window length, items) of every window in a run of known words."""
        follow, link, length, window = self.follow, self.link, self.length, self.window
        v = matched = 0
        for end, c in enumerate(ids, 1):
            while v and c not in follow[v]:
                v = link[v]
                matched = length[v]
            if c in follow[v]:
                v = follow[v][c]
                matched += 1
            if matched >= window and self.full[v]:
                yield end, window, self.full[v]
            for size, item in self.short[v]:
                if size <= matched:
                    yield end, size, (item,)


def _item_words(text: str):
    lowered = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), *_UPPER_LOWER)
    return F.filter(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


_UPPER_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def automata(
    benchmark: DataFrame,
    item_col: str = "item_id",
    text_col: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> Iterator[Automaton]:
    """One automaton per block of at most about ``block_words`` words.

    Long items are cut into overlapping pieces first, so that no window is lost
    and no single row is larger than a block.
    """
    size = min(PIECE_WORDS, block_words)
    pieces = (
        benchmark.select(
            F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), _item_words(text_col).alias("words")
        )
        .filter(F.size("words") > 0)
        .select(
            "item",
            F.explode(
                F.transform(
                    F.sequence(
                        F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(max(1, size - window + 1))
                    ),
                    lambda i: F.slice("words", i + 1, F.lit(size)),
                )
            ).alias("words"),
        )
    )
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = -(-total // block_words)
    for b in range(blocks):
        own = pieces if blocks == 1 else pieces.filter(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == b)
        rows = sorted((r["item"], r["words"]) for r in own.collect())  # bounded by block_words
        yield Automaton([(item, [w.encode() for w in words]) for item, words in rows], window)


def _judged(df: DataFrame, benchmark: DataFrame, text_col: str, window: int, block_words: int, **cols) -> DataFrame:
    """``row`` (the input row), ``n_words``, ``hit`` (spans of hit words) and ``items``."""
    out = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<struct<first:int,last:int>>").alias("hit"),
        F.array().cast("array<string>").alias("items"),
    )
    schema = out.schema
    blocks = 0
    for machine in automata(benchmark, window=window, block_words=block_words, **cols):
        shared = df.sparkSession.sparkContext.broadcast(machine)
        out = (cut_lineage(out) if blocks else out).mapInArrow(_scan(shared), schema)
        blocks += 1
    return out if blocks else out.mapInArrow(_scan(None), schema)


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value if shared else Automaton([])
        for batch in batches:
            counts, spans, items = [], [], []
            texts = utf8(batch.column("text"))
            for raw, old, known in zip(texts, batch.column("hit").to_pylist(), batch.column("items").to_pylist()):
                words = normalised(raw).split()
                hit, found = machine.matches(words)
                counts.append(len(words))
                spans.append(_merged(hit, old))
                items.append(sorted(found | set(known)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), batch.column("text"), pa.array(counts, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
                    pa.array(items, pa.list_(pa.string())),
                ],
                names=["row", "text", "n_words", "hit", "items"],
            )

    return run


def _merged(hit: np.ndarray | None, old: list[dict]) -> list[dict]:
    """Maximal spans of hit words, joined with those of earlier blocks."""
    if hit is None:
        return old
    for s in old:
        hit[s["first"] : s["last"] + 1] = True
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return [{"first": a, "last": b - 1} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]


def contamination(
    df: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    coverage: int = COVERAGE,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Per row: id, n_words, n_hit, n_items, items, hit spans (word numbers) and contaminated."""
    slim = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    done = _judged(slim, benchmark, text_col, window, block_words)
    n_hit = F.aggregate("hit", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    return done.select(
        F.col("row")[id_col].alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items",
        "hit",
        ((n_hit > 0) & (coverage * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(
    df: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    window: int = WINDOW,
    coverage: int = COVERAGE,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The rows below the coverage limit, in the columns of ``df``, without their hit spans."""
    done = _judged(df, benchmark, text_col, window, block_words)
    n_hit = F.aggregate("hit", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    kept = done.filter((n_hit == 0) | (coverage * n_hit < F.col("n_words")))
    cut = kept.mapInArrow(_cut, kept.schema)
    text = F.when(F.size("hit") > 0, F.col("text")).otherwise(F.col("row")[text_col])
    return cut.select(*[(text if c == text_col else F.col("row")[c]).alias(c) for c in df.columns])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop the hit spans from ``text``."""
    for batch in batches:
        texts = []
        for raw, spans in zip(utf8(batch.column("text")), batch.column("hit").to_pylist()):
            texts.append(without(raw, [(s["first"], s["last"]) for s in spans]) if spans else None)
        columns = [pa.array(texts, pa.binary()).cast(pa.string()) if n == "text" else batch.column(n) for n in batch.schema.names]
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the bytes from the first to the last word of each span."""
    at = [m.span() for m in re.finditer(rb"[^ ]+", normalised(raw))]
    out, last = [], 0
    for first, end in spans:
        out.append(raw[last : at[first][0]])
        last = at[end][1]
    out.append(raw[last:])
    return b"".join(out)


def items_digest(items: list[str]) -> str:
    """Lower-case SHA-256 of the sorted, comma-joined item ids."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
