"""Sums of dense count tables whose size is fixed, whatever the number of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK = 4096  # cells a shuffled row
KIND = "chunk int, wide boolean, counts binary"


def _packed(rows: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    used = {i: r for i, r in rows.items() if r.any()}
    small = [r.astype(np.int32 if r.max() < 1 << 31 else np.int64) for r in used.values()]
    if used:
        yield pa.RecordBatch.from_pydict(
            {
                "chunk": pa.array(list(used), pa.int32()),
                "wide": pa.array([s.itemsize == 8 for s in small], pa.bool_()),
                "counts": pa.array([s.tobytes() for s in small], pa.binary()),
            }
        )


def _read(wide: bool, counts: bytes) -> np.ndarray:
    return np.frombuffer(counts, np.int64 if wide else np.int32).astype(np.int64)


def dense_sums(
    rows: DataFrame, add: Callable[[np.ndarray, pa.RecordBatch], None], cells: int
) -> np.ndarray:
    """The `cells` counts that `add` makes of all rows, batch by batch.

    A task sends one number per cell, in chunks; chunks are summed where they meet, one at
    a time, and the sums come to the driver.
    """
    width = -(-cells // CHUNK) * CHUNK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(width, np.int64)
        for batch in batches:
            add(held, batch)
        yield from _packed(dict(enumerate(held.reshape(-1, CHUNK))))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, wide, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held[i] = held.get(i, 0) + _read(wide, data)
        yield from _packed(held)

    out = np.zeros((width // CHUNK, CHUNK), np.int64)
    for row in rows.mapInArrow(count, KIND).repartition("chunk").mapInArrow(merge, KIND).collect():
        out[row.chunk] = _read(row.wide, row.counts)
    return out.ravel()[:cells]
