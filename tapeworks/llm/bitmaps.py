"""Bounded bitmaps over 64-bit hashes: the Bloom filters of this subpackage.

A bitmap has ``2**log2_bits`` cells; ``log2_bits`` follows the number of rows
but never exceeds ``max_log2_bits`` (30: 128 MB), which bounds what is sent to
the driver and to each Python worker whatever the corpus holds. A full bitmap
answers "possibly" too often, never "no" wrongly: the callers' results stay
the same, only more rows take their exact way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PROBES = 4
MAX_LOG2_BITS = 30
SEGMENT_LOG2 = 20
FLUSH_ROWS = 1 << 20


def log2_bits(rows: int, bits_per_row: int = 16, most: int = MAX_LOG2_BITS) -> int:
    return int(min(most, max(16, (max(rows, 1) * bits_per_row - 1).bit_length())))


def cells(hashes: np.ndarray, log2: int) -> np.ndarray:
    """``PROBES`` cell numbers of each hash (double hashing), one row each."""
    h = hashes.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    probes = np.arange(PROBES, dtype=np.uint64)[:, None]
    return (h[None, :] + probes * step[None, :]) & np.uint64((1 << log2) - 1)


def maybe_in(bitmap: np.ndarray, hashes: np.ndarray, log2: int) -> np.ndarray:
    """Whether all cells of each hash are set in a packed bitmap."""
    at = cells(hashes, log2)
    return ((bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def _parts(at: np.ndarray, twice: np.ndarray, log2: int) -> Iterator[pa.RecordBatch]:
    """Rows (segment, cells seen once, cells seen twice or more) of sorted cells."""
    low = min(log2, SEGMENT_LOG2)
    segment = (at >> np.uint64(low)).astype(np.int64)
    inside = (at & np.uint64((1 << low) - 1)).astype(np.uint32)
    names, starts = np.unique(segment, return_index=True)
    ends = np.append(starts[1:], len(segment))
    once = [inside[a:b][~twice[a:b]].tobytes() for a, b in zip(starts, ends)]
    more = [inside[a:b][twice[a:b]].tobytes() for a, b in zip(starts, ends)]
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], ["segment", "once", "more"])


def filled_cells(df: DataFrame, column: str, least: int, log2: int) -> np.ndarray:
    """The packed bitmap of cells that ``least`` rows (1 or 2) have hit.

    Pass one of the filter. Each task counts the cells of its own rows, up to
    two; the counts are added up by segment of 2**20 cells, so that what is
    shuffled is cell numbers, already combined within the task.
    """
    low = min(log2, SEGMENT_LOG2)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            at, n = np.unique(np.concatenate(held), return_counts=True)
            yield from _parts(at, n >= 2, log2)

        for batch in batches:
            h = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
            if not len(h):
                continue
            own = np.sort(cells(h, log2), axis=0)
            again = np.zeros(own.shape, bool)
            again[1:] = own[1:] == own[:-1]  # probes of one row that meet count once
            held.append(own[~again])
            rows += len(h)
            if rows >= FLUSH_ROWS:
                yield from flush()
                held, rows = [], 0
        if held:
            yield from flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, once, more in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own = counts.setdefault(segment, np.zeros(1 << low, np.uint8))
                at = np.frombuffer(once, np.uint32)
                own[at] = np.minimum(own[at] + 1, 2)
                own[np.frombuffer(more, np.uint32)] = 2
        for segment, own in counts.items():
            bits = np.packbits(own >= least, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), pa.array([bits], pa.binary())], ["segment", "bits"])

    segments = 1 << (log2 - low)
    merged = (
        df.select(column)
        .mapInArrow(count, "segment long, once binary, more binary")
        .repartition(max(1, segments // 16), "segment")
        .mapInArrow(add, "segment long, bits binary")
    )
    out = np.zeros(max(1, (1 << log2) // 8), np.uint8)
    size = (1 << low) // 8
    for row in merged.toLocalIterator():  # (1 << log2) / 8 bytes in all, 128 MB at most
        out[row.segment * size : (row.segment + 1) * size] = np.frombuffer(row.bits, np.uint8)
    return out
