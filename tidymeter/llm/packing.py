"""Best-fit packing: length patterns fitted to the length histogram by non-negative least squares.

Only the histogram of piece lengths (at most ``limit`` numbers) reaches the
driver. There the patterns (few lengths that fill a sequence), their repeat
counts and the packing of what rounding leaves over are settled in terms of
lengths. A piece then finds its place from its rank among the pieces of equal
length, which comes from counts per (length, salt) and a row number inside one
salt, so no task sees all pieces of a length. Sequence ids and offsets follow
from the rank alone.

Defined cases: a null text is empty and gives one piece, the closing id alone;
an empty table gives no rows; rows with equal ids are packed one by one; only the
id and text columns are read.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F, types as T
from tokenizers import Tokenizer

from tidymeter.llm.numbering import numbered
from tidymeter.session import materialize

LIMIT = 1024
END_ID = 2
CACHE = 400_000  # word encodings kept per task

# A blank that more white space or the end follows: cut there, some texts would
# be split otherwise than as a whole.
_ODD = re.compile(r" (?:\s|\Z)")


class Encoder(dict):
    """Ids of whole texts, as little-endian 32-bit bytes.

    The vocabulary never joins characters across a blank that a word follows, so
    a text is encoded word by word, and the words are remembered (at most
    ``CACHE``). Texts with other white space after a blank, or with the string of
    a special token, are encoded whole.
    """

    def __init__(self, vocabulary: str, ranks: str, pattern: str):
        super().__init__()
        self.whole = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        out = self[word] = self._ids(" " + word)
        return out

    def _ids(self, text: str) -> bytes:
        return np.array(self.core.encode_ordinary(text), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if _ODD.search(text):
            return self._ids(text)
        first, *rest = text.split(" ")
        return self._ids(first) + b"".join(map(self.__getitem__, rest))


@dataclass(frozen=True)
class Vocabulary:
    """Places of the tokenizer's files, the same on every machine."""

    vocabulary: str
    ranks: str
    pattern: str


def public_vocabulary() -> Vocabulary:
    import public_tokenizers as public

    return Vocabulary(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


def pieces(
    df: DataFrame,
    vocabulary: Vocabulary,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = LIMIT,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 and, on request, the ids themselves.

    A document's ids and ``end_id`` are cut into pieces of ``limit`` ids; the first may be shorter.
    """
    slim = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    extra = ", ids array<int>" if with_ids else ""
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(vocabulary.vocabulary, vocabulary.ranks, vocabulary.pattern)
        for batch in batches:
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                raw = coder.encode(text or "") + tail
                total = len(raw) // 4
                first = (total - 1) % limit + 1
                cuts = [0, *range(first, total + 1, limit)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    part = raw[4 * a : 4 * b]
                    at.append(row)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = [
                batch.column("id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
            ]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = slim.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long{extra}")
    return out.withColumnRenamed("id", id_col)


def patterns(limit: int) -> list[tuple[int, ...]]:
    """Length patterns of two, three and four documents that fill a sequence exactly."""
    out: set[tuple[int, ...]] = set()
    for a in range(1, limit):
        rest = limit - a
        if 0 < rest <= a:
            out.add((a, rest))
        for share in (0.5, 0.65, 0.8):
            b = int(rest * share)
            c = rest - b
            if min(b, c) > 0:
                out.add(tuple(sorted((a, b, c), reverse=True)))
                d = c // 2
                if d and c - d:
                    out.add(tuple(sorted((a, b, d, c - d), reverse=True)))
    return sorted(out, reverse=True)


def fit_counts(options: list[tuple[int, ...]], histogram: np.ndarray, sweeps: int = 40) -> np.ndarray:
    """Repeat counts x >= 0 with least squared distance between their pieces and the histogram.

    Cyclic coordinate descent: each count in turn takes its best value, or 0.
    """
    columns = [np.unique(o, return_counts=True) for o in options]
    norms = [float((m * m).sum()) for _, m in columns]
    left = histogram.astype(float).copy()
    x = np.zeros(len(options))
    for _ in range(sweeps):
        moved = 0.0
        for j, ((rows, m), norm) in enumerate(zip(columns, norms)):
            new = max(0.0, x[j] + float(left[rows] @ m) / norm)
            if new != x[j]:
                left[rows] -= (new - x[j]) * m
                moved = max(moved, abs(new - x[j]))
                x[j] = new
        if moved < 0.25:
            break
    return x


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use up the histogram exactly; index is the length, the last one the limit."""
    limit = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []

    def use(pattern: tuple[int, ...], wanted: int) -> None:
        rows, m = np.unique(pattern, return_counts=True)
        n = min(wanted, int((left[rows] // m).min()))
        if n > 0:
            left[rows] -= n * m
            out.append((pattern, n))

    use((limit,), int(left[limit]))
    options = [o for o in patterns(limit) if all(left[x] > 0 for x in o)]
    x = fit_counts(options, left)
    for j in np.argsort(-x, kind="stable"):
        use(options[j], int(round(x[j])))
    # What rounding leaves: longest first, then always the longest that still fits.
    while left.any():
        own = [int(np.flatnonzero(left)[-1])]
        room, taken = limit - own[0], left.copy()
        taken[own[0]] -= 1
        while room > 0:
            fits = np.flatnonzero(taken[: room + 1])
            if not len(fits):
                break
            own.append(int(fits[-1]))
            taken[own[-1]] -= 1
            room -= own[-1]
        rows, m = np.unique(own, return_counts=True)
        use(tuple(own), int((left[rows] // m).min()))
    return out


def _slots(settled: list[tuple[tuple[int, ...], int]], limit: int):
    """Per slot of every pattern: (length, first rank) as one key, first sequence id, offset; sorted by key."""
    used, base = np.zeros(limit + 1, np.int64), 0
    keys, sequences, offsets = [], [], []
    for pattern, repeats in settled:
        offset = 0
        for length in pattern:
            keys.append((length << 48) + int(used[length]))
            sequences.append(base)
            offsets.append(offset)
            used[length] += repeats
            offset += length
        base += repeats
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return tuple(np.array(x, np.int64)[order] for x in (keys, sequences, offsets))


def pack(cut: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a table of pieces with a ``length`` of 1 to ``limit``.

    ``cut`` is read three times: hand in a written table.
    """
    others = [c for c in cut.columns if c not in ("sequence_id", "offset")]
    rows = cut.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"))
    counts = rows.groupBy(F.col("row")["length"].alias("length")).count().collect()  # at most limit rows
    histogram = np.zeros(limit + 1, np.int64)
    for r in counts:
        histogram[r["length"]] = r["count"]
    table = _slots(plan(histogram), limit)

    placed = rows.withColumn("length", F.col("row")["length"])
    ranked = numbered(placed, "length", int(histogram.sum()), "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sequences, offsets = table
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            key = (length << 48) + rank
            at = np.searchsorted(keys, key, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(sequences[at] + key - keys[at]), pa.array(offsets[at])],
                names=["row", "sequence_id", "offset"],
            )

    schema = T.StructType([ranked.schema["row"], *(T.StructField(c, T.LongType()) for c in ("sequence_id", "offset"))])
    done = ranked.mapInArrow(run, schema)
    return done.select(*[F.col("row")[c].alias(c) for c in others], "sequence_id", "offset")


def pack_documents(df: DataFrame, vocabulary: Vocabulary | None = None, limit: int = LIMIT, **options) -> DataFrame:
    """Tokenise once into a written table of pieces, then pack it."""
    cut = pieces(df, vocabulary or public_vocabulary(), limit=limit, **options)
    return pack(materialize(cut, "pieces"), limit)
