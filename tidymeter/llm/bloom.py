"""Bloom filters of ids, built on the executors, for tests on the map side of a join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidymeter.llm.text import mix

BLOOM_BITS = 28  # at most 32 MB
SLICES = 16


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    """Four places of every key in a Bloom filter of so many bits."""
    return np.concatenate([mix(keys, 20 + k) & np.uint64(bits - 1) for k in range(4)])


def bloom_filter(ids: DataFrame) -> np.ndarray:
    """Bloom filter of an id column, about 16 bits an id and at most ``BLOOM_BITS``.

    A full filter lets more rows through, never fewer.
    """
    bits = 1 << min(max(16 * ids.count(), 1 << 16).bit_length(), BLOOM_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, bool)
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            own[_places(keys, bits).astype(np.int64)] = True
        if own.any():
            parts = np.packbits(own).reshape(SLICES, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())],
                names=["slice", "bits"],
            )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("slice").to_pylist(), batch.column("bits").to_pylist()):
                whole[k] = whole.get(k, 0) | np.frombuffer(raw, np.uint8)
        yield pa.RecordBatch.from_arrays(
            [pa.array(whole, pa.int32()), pa.array([x.tobytes() for x in whole.values()], pa.binary())],
            names=["slice", "bits"],
        )

    schema = "slice int, bits binary"
    parts = ids.mapInArrow(run, schema).repartition(SLICES, "slice").mapInArrow(join, schema).collect()
    out = np.zeros((SLICES, bits // 8 // SLICES), np.uint8)
    for r in parts:
        out[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def in_bloom(column: pa.Array, bloom: np.ndarray) -> np.ndarray:
    """Which values of a column the filter holds (a few more may pass)."""
    at = _places(column.to_numpy(zero_copy_only=False).view(np.uint64), 8 * len(bloom)).astype(np.int64)
    return (bloom[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).reshape(4, -1).all(axis=0)
