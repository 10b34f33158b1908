"""Language-model scoring with a weighted backoff automaton.

The model is an n-gram model of order ``ORDER``, each order smoothed towards the next
shorter history:

    p(w)     = (c(w) + 1) / (N + V + 1)
    p(w | h) = (c(h w) + MASS * p(w | h')) / (c(h) + MASS),  h' = h without its first token

Its automaton has a state for the empty history and one for every n-gram of up to
ORDER - 1 tokens that was seen in training (the start of a text is a token of
histories). A seen n-gram h w is an arc from the state of h, with the log of
p(w | h), to the state of the longest seen history that ends in w. A failure arc
leads from h to h', with log(MASS / (c(h) + MASS)); a state without an arc for the
token is left by it. From the empty history every token has an arc, so a walk always
goes on. This gives the formula above exactly.

Nothing of the model is broadcast, since it grows with the corpus. Texts are dealt
to blocks of about ``BLOCK_BYTES``. Each block sends the sorted distinct hashes of
its n-grams with their training counts, cut by hash range, to the tasks that add up
these ranges; they answer each block with the corpus counts of just its n-grams. From
the answer a block builds its part of the automaton, and walks its texts once from left
to right, many stretches of texts abreast, each carrying its state and adding up
weights. A stretch begins in the state of the tokens before it, so cutting a long
text changes nothing.

There are as many ranges as the n-grams need at ``RANGE_KEYS`` each, and a row holds
the n-grams of a block and a range. Beyond ``FAN`` ranges these rows would get many
and small; then blocks first merge in bundles, by coarse ranges, and bundles ask the
ranges, so that rows grow as the corpus, not as its square. A range gets at most one
entry per block and n-gram, so frequent words are no hot keys.

All of it is one query: both uses of the dealt texts read the same shuffle, and the
corpus totals come to each block with its answers, since it asks every range of single
tokens, if need be for nothing.

Defined cases: a null or empty text is the end token alone; an empty table gives no
rows; without training rows every token is unknown; rows with equal ids are rows of
their own; other columns are not read. Rows of one id and one text are dealt to one
block.

Tokens are told apart by 64-bit hashes, longer n-grams by hashes of ``SPARE_BITS``
more bits than the number of tokens has (``LEAST_BITS`` at least), so that a chance of
about one in 65 000 remains that an n-gram passes for another one.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidymeter.llm.text import hashes, mix, words_of

ORDER = 3
MASS = 2.0
BLOCK_BYTES = 3 << 20
RANGE_KEYS = 4_000_000
FAN = 8192
LEAST_BITS, SPARE_BITS = 44, 16
STRETCH = 256
END = np.uint64(0x5E0D_0000_0000_0001)  # stands for the end; no word's text can name it
START = np.uint64(0x5E0D_0000_0000_0002)
CODEC = pa.Codec("zstd", compression_level=1)
HEAD = struct.Struct("<IBB")  # of packed values: how many, byte planes, those of them that are not compressed


def coded(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts one after another, and the number of tokens of each."""
    parts, sizes = [], []
    for text in texts:
        own = hashes(words_of(text.encode() if text else None))
        parts += [own, np.array([END])]
        sizes.append(len(own) + 1)
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.array(sizes, np.int64)


def distinct_grams(tokens: np.ndarray, sizes: np.ndarray, order: int, bits: int):
    """For each order k in turn: (k, keys, first, at).

    ``keys`` are the distinct hashes, sorted, and ``first`` has a token where each ends.
    ``at[i]`` says which of them ends at token i, or -1 where a text has fewer tokens
    before; its start counts as one.
    """
    place = np.arange(len(tokens), dtype=np.int32) - np.repeat(np.cumsum(sizes) - sizes, sizes).astype(np.int32)
    code = tokens
    for k in range(1, order + 1):
        if k > 1:
            # Hash of the last k tokens from that of the last k - 1, ending one token earlier.
            code = np.concatenate(([START], code[:-1])) if len(code) else code
            code[place == 0] = START
            code = mix(mix(code, 7 + k) + tokens, 8)
        values = code if k == 1 else code >> np.uint64(64 - bits)
        turn = np.argsort(values)
        turn = turn[(place >= k - 2)[turn]].astype(np.int32)
        values = values[turn]
        new = np.concatenate((np.ones(min(1, len(values)), bool), values[1:] != values[:-1]))
        at = np.full(len(tokens), -1, np.int32)
        at[turn] = np.cumsum(new, dtype=np.int32) - 1
        yield k, values[new], turn[new], at


class Grams:
    """``first`` and ``at`` of ``distinct_grams`` by order, and the number ``n`` of distinct n-grams."""

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, order: int, bits: int):
        self.sizes, self.begins, self.is_end, self.order = sizes, np.cumsum(sizes) - sizes, tokens == END, order
        self.at, self.first, self.n = {}, {}, {}
        for k, keys, first, at in distinct_grams(tokens, sizes, order, bits):
            self.first[k], self.at[k], self.n[k] = first, at, len(keys)


class Automaton:
    """States, arcs and failure arcs over the n-grams of a block.

    State 0 is the empty history, state 1 the start of a text, then come the seen
    histories of one token, two tokens, ... Arcs are numbered through all orders like
    the distinct n-grams; ``arc[k - 1, i]`` is the arc of the k-gram that ends at token i.
    """

    def __init__(self, grams: Grams, counts: dict[int, np.ndarray], starts: int, total: int, types: int, mass: float):
        order, n = grams.order, len(grams.is_end)
        offset = np.concatenate(([0], np.cumsum([grams.n[k] for k in range(1, order + 1)]))).astype(np.int64)
        last = offset[-1]  # stands for an n-gram that is none
        self.order = order
        self.arc = np.empty((order, n), np.int32)
        for k in range(1, order + 1):
            self.arc[k - 1] = np.where(grams.at[k] >= 0, grams.at[k] + offset[k - 1], last)
        self.seen = np.concatenate([*(counts[k] > 0 for k in range(1, order + 1)), [False]])
        self.seen[: offset[1]] = True  # the empty history has an arc for every token
        self.weight = np.zeros(last + 1)
        # ``target`` of an arc is the state of its n-gram, where that is one: seen, and not the end of a text.
        self.target = np.zeros(last + 1, np.int32)
        length, history, fail = [np.array([0, 1], np.int8)], [np.array([0, starts])], [np.zeros(2, np.int32)]
        made = 2
        for k in range(1, order + 1):
            first, own = grams.first[k], slice(offset[k - 1], offset[k])
            if k == 1:
                self.weight[own] = np.log10((counts[1] + 1) / (total + types + 1))
            else:
                # Every history of k - 1 tokens is among the states made so far.
                seen_before = np.concatenate(history)[self._prefix(grams, k)]
                lower = 10.0 ** self.weight[self.arc[k - 2, first]]
                self.weight[own] = np.log10((counts[k] + mass * lower) / (seen_before + mass))
            if k < order:
                known = np.flatnonzero((counts[k] > 0) & ~grams.is_end[first])
                self.target[offset[k - 1] + known] = made + np.arange(len(known))
                made += len(known)
                length.append(np.full(len(known), k, np.int8))
                history.append(counts[k][known])
                fail.append(np.zeros(len(known), np.int32) if k == 1 else self.target[self.arc[k - 2, first[known]]])
        # An arc of the highest order leads to the state of its last order - 1 tokens.
        self.target[offset[order - 1] : last] = self.target[self.arc[order - 2, grams.first[order]]]
        self.length, self.fail = np.concatenate(length), np.concatenate(fail)
        self.cost = np.log10(mass / (np.concatenate(history) + mass))
        self.cost[0] = 0.0

    def _prefix(self, grams: Grams, k: int) -> np.ndarray:
        """State of the first k - 1 tokens of every distinct k-gram (0 where it was not seen)."""
        first = grams.first[k]
        if k > 2:
            return self.target[self.arc[k - 2, first - 1]]
        begins = np.zeros(len(grams.is_end), bool)
        begins[grams.begins] = True
        return np.where(begins[first], 1, self.target[self.arc[0, first - 1]])

    def begin(self, at: np.ndarray, text_begin: np.ndarray) -> np.ndarray:
        """The state before the token ``at`` of a text that begins at ``text_begin``."""
        out = np.ones(len(at), np.int64)
        inside = np.flatnonzero(at > text_begin)
        found = np.zeros(len(inside), np.int64)
        for k in range(1, self.order):
            arc = self.arc[k - 1, at[inside] - 1]
            longer = np.where(self.seen[arc], self.target[arc], 0)
            found = np.where(self.length[longer] == k, longer, found)
        out[inside] = found
        return out

    def walk(self, grams: Grams) -> np.ndarray:
        """Log-probability of every text."""
        pieces = -(-grams.sizes // STRETCH)
        text = np.repeat(np.arange(len(pieces)), pieces)
        number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = grams.begins[text] + number * STRETCH
        stop = np.minimum(at + STRETCH, grams.begins[text] + grams.sizes[text])
        state, total = self.begin(at, grams.begins[text]), np.zeros(len(text))
        # Longest first, so that the stretches still walking are a prefix.
        order = np.argsort(at - stop, kind="stable")
        at, steps, state = at[order], (stop - at)[order], state[order]
        own = np.zeros(len(text))
        live = len(text)
        for step in range(int(steps[0]) if len(steps) else 0):
            live = int(np.searchsorted(-steps[:live], -step, side="left"))
            waiting = np.arange(live)
            while len(waiting):
                here = state[waiting]
                arc = self.arc[self.length[here], at[waiting] + step]
                on = self.seen[arc]
                go, stay = waiting[on], waiting[~on]
                own[go] += self.weight[arc[on]]
                state[go] = self.target[arc[on]]
                # Failure arcs: pay, and try the shorter history.
                own[stay] += self.cost[state[stay]]
                state[stay] = self.fail[state[stay]]
                waiting = stay
        total[order] = own
        return np.bincount(text, weights=total, minlength=len(pieces))


def _pack(values: np.ndarray) -> bytes:
    """64-bit values (no negative ones) as byte planes, lowest first, without those that are all zero.

    The lower planes of what is close to random are left as they are, those above are compressed.
    """
    n, width = len(values), -(-int(values.max()).bit_length() // 8) if len(values) else 0
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    plain = 0
    while plain < width and len(CODEC.compress(planes[plain], asbytes=True)) >= n:
        plain += 1
    rest = CODEC.compress(planes[plain:].ravel(), asbytes=True) if plain < width else b""
    return HEAD.pack(n, width, plain) + planes[:plain].tobytes() + rest


def _unpack(raw: bytes) -> np.ndarray:
    n, width, plain = HEAD.unpack_from(raw)
    planes, at = np.zeros((8, n), np.uint8), HEAD.size + plain * n
    planes[:plain] = np.frombuffer(raw, np.uint8, plain * n, HEAD.size).reshape(plain, n)
    if plain < width:
        rest = CODEC.decompress(memoryview(raw)[at:], (width - plain) * n, asbytes=True)
        planes[plain:width] = np.frombuffer(rest, np.uint8).reshape(-1, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct keys: the first, and the differences."""
    first = keys[:1] if len(keys) else np.zeros(1, np.uint64)
    return first.astype("<u8").tobytes() + _pack(np.diff(keys, prepend=first) if len(keys) else keys)


def _unpack_keys(raw: bytes) -> np.ndarray:
    out = _unpack(memoryview(raw)[8:])
    out[:1] = np.frombuffer(raw, "<u8", 1)[: len(out)]
    return np.cumsum(out, dtype=np.uint64)


def _unpack_counts(raw: bytes) -> np.ndarray:
    return _unpack(raw).astype(np.int64)


ASK = "{0} int, kind int, range int, keys binary, counts binary"
REPLY = "{0} int, kind int, range int, counts binary, tokens long, types long"


def _edges(ranges: int, bits: int) -> np.ndarray:
    """First value of each of so many equal ranges of values of ``bits`` bits."""
    return np.array([(i << bits) // ranges for i in range(ranges)], np.uint64)


def _cut(keys: np.ndarray, edges: np.ndarray, kind: int):
    """(range, from, to) of the ranges that sorted keys fall into; of single tokens all, since their answers tell the totals."""
    ends = [*np.searchsorted(keys, edges).tolist(), len(keys)]
    return [(r, a, b) for r, (a, b) in enumerate(zip(ends, ends[1:])) if b > a or kind == 1]


def _requests(order: int, bits: int, ranges: int):
    """Per block, order and range: the block's n-grams of that range and their training counts."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        tokens, sizes = coded(pdf["text"].tolist())
        train, out = np.repeat(pdf["train"].to_numpy(bool), sizes), []
        for k, keys, _, at in distinct_grams(tokens, sizes, order, bits):
            counts = np.bincount(at[(at >= 0) & train], minlength=len(keys))
            for r, a, b in _cut(keys, _edges(ranges, 64 if k == 1 else bits), k):
                out.append((key[0], k, r, _pack_keys(keys[a:b]), _pack(counts[a:b])))
        return pd.DataFrame(out, columns=["block", "kind", "range", "keys", "counts"])

    return run


def _merged(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys of some asks, their summed counts, and the place of each ask's keys among them."""
    keys = [_unpack_keys(x) for x in pdf["keys"]]
    ends = np.cumsum([len(k) for k in keys])
    keys = np.concatenate(keys)
    turn = np.argsort(keys).astype(np.int32)
    keys = keys[turn]
    new = np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]))
    at = np.empty(len(keys), np.int32)
    at[turn] = np.cumsum(new, dtype=np.int32) - 1
    keys = keys[new]
    counts = np.concatenate([_unpack_counts(x) for x in pdf["counts"]])[turn]
    return keys, np.add.reduceat(counts, np.flatnonzero(new)), np.split(at, ends[:-1])


def _bundled(bits: int, ranges: int):
    """The asks of a bundle of blocks in one of so many coarse ranges, merged and cut into as many fine ones; ``block`` is the bundle."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        bundle, kind, coarse = key
        every, sums, _ = _merged(pdf)
        begin = int(coarse) * ranges
        own = _edges(ranges * ranges, 64 if kind == 1 else bits)[begin : begin + ranges]
        out = [(bundle, kind, begin + r, _pack_keys(every[a:b]), _pack(sums[a:b])) for r, a, b in _cut(every, own, kind)]
        return pd.DataFrame(out, columns=["block", "kind", "range", "keys", "counts"])

    return run


def _answers(pdf: pd.DataFrame) -> pd.DataFrame:
    """Corpus counts of every asker's n-grams of one range, and the range's totals, which every asker gets."""
    pdf = pdf.sort_values("block", kind="stable").reset_index(drop=True)
    _, sums, at = _merged(pdf)
    out = pdf[["block", "kind", "range"]].copy()
    out["counts"] = [_pack(sums[a]) for a in at]
    out["tokens"] = int(sums.sum())
    out["types"] = int((sums > 0).sum())
    return out


def _passed_on(key, asks: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
    """The replies to a bundle in a coarse range, dealt to its blocks."""
    asks = asks.sort_values("block", kind="stable").reset_index(drop=True)
    _, _, at = _merged(asks)
    counts = np.concatenate([_unpack_counts(x) for x in replies.sort_values("range")["counts"]])
    out = asks[["block", "kind", "range"]].copy()
    out["counts"] = [_pack(counts[a]) for a in at]
    out["tokens"] = int(replies["tokens"].sum())
    out["types"] = int(replies["types"].sum())
    return out


def _scored(order: int, bits: int, starts: int, mass: float, columns: list[str]):
    """Scores of a block's texts on the part of the automaton that its answers describe."""

    def run(key, docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        tokens, sizes = coded(docs["text"].tolist())
        grams = Grams(tokens, sizes, order, bits)
        counts = {}
        for k in grams.n:
            own = answers[answers["kind"] == k].sort_values("range")
            counts[k] = np.concatenate([np.empty(0, np.int64), *(_unpack_counts(x) for x in own["counts"])])
        # The totals of all ranges of single tokens are those of the corpus.
        total, types = (int(answers.loc[answers["kind"] == 1, c].sum()) for c in ("tokens", "types"))
        known = counts[1][grams.at[1]]
        begins = grams.begins
        add = lambda x: np.add.reduceat(x, begins) if len(begins) else np.empty(0)
        out = docs[columns].copy()
        out["n_tokens"] = sizes
        out["n_known"] = add((known > 0).astype(np.int64))
        out["train_tokens"] = total
        out["base_score"] = add(np.log10((known + 1) / (total + types + 1)))
        out["score"] = Automaton(grams, counts, starts, total, types, mass).walk(grams)
        return out

    return run


def score(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    train_col: str = "train",
    mass: float = MASS,
    order: int = ORDER,
    block_bytes: int = BLOCK_BYTES,
    range_keys: int = RANGE_KEYS,
    fan: int = FAN,
) -> DataFrame:
    """Per row: id, train flag, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    slim = df.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"),
        F.coalesce(F.col(f"`{train_col}`"), F.lit(False)).alias("train"),
    )
    size, starts = slim.agg(
        F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 8), F.sum(F.col("train").cast("long"))
    ).first()
    size, starts = size or 0, starts or 0
    blocks = max(1, size // block_bytes)
    # A token with its blank takes some six bytes.
    bits = min(64, max(LEAST_BITS, (size // 6).bit_length() + SPARE_BITS))
    ranges = max(1, order * size // 6 // range_keys)
    dealt = slim.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))
    coarse = ranges if ranges <= fan else max(1, round(ranges**0.5))
    asked = dealt.groupBy("block").applyInPandas(_requests(order, bits, coarse), ASK.format("block"))
    if ranges <= fan:
        replies = asked.groupBy("kind", "range").applyInPandas(_answers, REPLY.format("block"))
    else:
        own = asked.withColumn("bundle", F.floor(F.col("block") / max(1, blocks // coarse)).cast("int")).groupBy("bundle", "kind", "range")
        bundled = own.applyInPandas(_bundled(bits, coarse), ASK.format("block"))
        answers = bundled.groupBy("kind", "range").applyInPandas(_answers, REPLY.format("block"))
        back = answers.select(
            F.col("block").alias("bundle"), "kind", F.floor(F.col("range") / coarse).cast("int").alias("coarse"), "range", "counts",
            "tokens", "types",
        )
        replies = own.cogroup(back.groupBy("bundle", "kind", "coarse")).applyInPandas(_passed_on, REPLY.format("block"))
    schema = T.StructType(
        [slim.schema["id"], slim.schema["train"], *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")),
         *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score"))]
    )
    done = dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(
        _scored(order, bits, starts, mass, ["id", "train"]), schema
    )
    return done.withColumnRenamed("id", id_col).withColumnRenamed("train", train_col)
