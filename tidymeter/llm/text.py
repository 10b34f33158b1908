"""Words and hashes of texts inside tasks, as bytes and numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

M1 = np.uint64(0x9E3779B97F4A7C15)
M2 = np.uint64(0xBF58476D1CE4E5B9)
M3 = np.uint64(0x94D049BB133111EB)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow column as UTF-8 bytes; null stays None."""
    return column.cast(pa.binary()).to_pylist()


def words_of(raw: bytes | None) -> list[bytes]:
    """Words between ASCII white space (blank, \\t to \\r), A-Z lower-cased."""
    return raw.lower().split() if raw else []


def hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values, another one for each seed."""
    z = x + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * M2
    z = (z ^ (z >> np.uint64(27))) * M3
    return z ^ (z >> np.uint64(31))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive values."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = mix(h[: len(h) - n + 1])
    for k in range(1, n):
        out = mix(out * M1 + h[k : len(h) - n + 1 + k], k)
    return out


def by_bytes(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of a batch that hold about so many bytes each."""
    rows = batch.num_rows
    if not rows:
        return
    step = max(1, int(rows * min(1.0, most / max(1, batch.nbytes))))
    for at in range(0, rows, step):
        yield batch.slice(at, step)
