"""Sharding by minimax contiguous partition of ordered atomic groups.

Groups are equal texts, ordered by a hash of the text. The smallest shard capacity
is found by binary search; a capacity is checked greedily, filling one shard after
another. The search needs the sizes of single groups only where a cut can fall, so
it works on totals of hash ranges: a first table of ``2**FIRST_BITS`` totals, then
finer totals of the ranges that a cut may reach, until every such range is one
group. Then the result is exactly that of a search over all group sizes, but the
driver sees a few thousand totals a round.

Defined cases: a null text counts as empty (size 1, checksum 0); an empty table
gives no rows; rows with equal ids are rows of their own; with fewer groups than
shards some shards stay empty; only the id and text columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tidymeter.llm.numbering import numbered
from tidymeter.session import materialize

SHARDS = 8
FIRST_BITS = 12
NEXT_BITS = 8
LAW = "bytes"


@dataclass(frozen=True)
class Span:
    """Groups whose hash, shifted right by ``shift``, is ``code``."""

    code: int
    shift: int
    total: int
    groups: int

    @property
    def first(self) -> int:
        return self.code << self.shift

    @property
    def last(self) -> int:
        return ((self.code + 1) << self.shift) - 1


def cuts(spans: list[Span], capacity: int, loose: bool) -> list[tuple[int, int]]:
    """Greedy cuts as (span index, size before the cut); the last is the end.

    Each shard takes spans while they fit. A span of more groups stays whole, or
    with ``loose`` is cut anywhere. Empty if a whole span exceeds the capacity.
    """
    out, filled, before = [], 0, 0
    for i, s in enumerate(spans):
        left = s.total
        while filled + left > capacity:
            if loose and s.groups > 1:
                left -= capacity - filled
                before += capacity - filled
            elif s.total > capacity:
                return []
            out.append((i, before))
            filled = 0
        filled += left
        before += left
    return [*out, (len(spans), before)]


def least_capacity(spans: list[Span], shards: int, loose: bool) -> int:
    """Binary search for the least capacity that ``shards`` shards satisfy."""
    total = sum(s.total for s in spans)
    low, high = -(-total // shards), total
    while low < high:
        middle = (low + high) // 2
        if 0 < len(cuts(spans, middle, loose)) <= shards:
            high = middle
        else:
            low = middle + 1
    return low


def _reach(spans: list[Span], low: int, high: int, shards: int) -> list[int]:
    """Indices of spans of more groups that a cut of the best partition may fall into.

    Cut k lies at or after cut k of whole spans under the lower capacity, and at
    or before cut k of loose spans under the upper one.
    """
    early = _whole(spans, low)
    late = cuts(spans, high, True)
    total = sum(s.total for s in spans)
    out, start = [], 0
    bounds = []
    for k in range(shards - 1):
        first = early[k] if k < len(early) else total
        last = late[k][1] if k < len(late) else total
        bounds.append((min(first, last), last))
    for i, s in enumerate(spans):
        stop = start + s.total
        if s.groups > 1 and any(first < stop and last > start for first, last in bounds):
            out.append(i)
        start = stop
    return out


def _whole(spans: list[Span], capacity: int) -> list[int]:
    """Sizes before each cut when a shard ends before the span that overflows it; a too large span ends its shard."""
    out, filled, before = [], 0, 0
    for s in spans:
        if filled + s.total > capacity:
            out.append(before)
            filled = 0
        filled += s.total
        before += s.total
    return out


def _totals(groups: DataFrame, shift: int) -> list[Span]:
    code = F.shiftright("key", shift).alias("code")
    rows = groups.groupBy(code).agg(F.sum("size").alias("total"), F.count("*").alias("n")).collect()
    return sorted((Span(r["code"], shift, r["total"], r["n"]) for r in rows), key=lambda s: s.code)


def bounds(groups: DataFrame, shards: int = SHARDS) -> list[int]:
    """Last key of every shard but the last, for a table of (key, size)."""
    shift = 64 - FIRST_BITS
    spans = _totals(groups, shift)
    while spans:
        low, high = least_capacity(spans, shards, True), least_capacity(spans, shards, False)
        reached = _reach(spans, low, high, shards)
        if not reached:
            break
        shift = max(0, shift - NEXT_BITS)
        wide = [spans[i] for i in reached]
        inside = F.lit(False)
        for a, b in _ranges(wide):
            inside |= F.col("key").between(a, b)
        fine = _totals(groups.filter(inside), shift)
        coarse = [s for i, s in enumerate(spans) if i not in set(reached)]
        spans = sorted(coarse + [s for s in fine if s.total], key=lambda s: s.first)
    if not spans:
        return []
    ends = cuts(spans, least_capacity(spans, shards, False), False)[:-1]
    return [spans[i - 1].last if i else spans[0].first - 1 for i, _ in ends]


def _ranges(spans: list[Span]) -> list[tuple[int, int]]:
    """Key ranges, neighbours joined."""
    out: list[tuple[int, int]] = []
    for s in spans:
        if out and out[-1][1] + 1 == s.first:
            out[-1] = (out[-1][0], s.last)
        else:
            out.append((s.first, s.last))
    return out


def shard(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size, text_crc32, shard and slot (gapless inside the shard)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    slim = df.select(
        F.col(f"`{id_col}`").alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )
    rows = materialize(slim, "sizes")
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    place = F.lit(0)
    for last in bounds(groups, shards):
        place += (F.col("key") > last).cast("int")
    placed = rows.withColumn("shard", place)
    done = numbered(placed, "shard", rows.count(), "slot")
    return done.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")
