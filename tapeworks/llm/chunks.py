"""Encoding of texts by blank-separated chunks, each distinct chunk once.

A tokenizer that never joins what stands on both sides of a blank gives the
same ids chunk by chunk as over the whole text. Each task keeps the ids of the
chunks it has seen in a table of bounded size and looks up the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 6 << 20


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with up to ``most`` bytes, one row at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        done = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + most, "right")))
        yield a, b
        a = b


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of all ranges one after the other."""
    total = int(sizes.sum())
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(total)


class Memo:
    """Ids (and scores) of chunks, by chunk; ``encode`` gives those of new ones.

    ``encode(chunks)`` returns (all ids one after the other, ids of each chunk,
    score of each chunk). With more than ``most`` chunks held, those that the
    latest slice did not use are forgotten.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]], most: int = 400_000):
        self.encode, self.most = encode, most
        self.at: dict[str, int] = {}
        self.ids, self.starts, self.sizes, self.scores = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def entries(self, chunks: list[str]) -> np.ndarray:
        new = [c for c in chunks if c not in self.at]
        if new:
            if len(self.at) + len(new) > self.most and self.at:
                held = [c for c in chunks if c in self.at]
                old = np.array([self.at[c] for c in held], np.int64)
                self.ids = self.ids[ranges(self.starts[old], self.sizes[old])]
                self.sizes, self.scores = self.sizes[old], self.scores[old]
                self.starts = np.cumsum(self.sizes) - self.sizes
                self.at = {c: i for i, c in enumerate(held)}
            ids, sizes, scores = self.encode(new)
            first = len(self.at)
            self.starts = np.append(self.starts, len(self.ids) + np.cumsum(sizes) - sizes)
            self.ids, self.sizes, self.scores = np.append(self.ids, ids), np.append(self.sizes, sizes), np.append(self.scores, scores)
            self.at.update((c, first + i) for i, c in enumerate(new))
        return np.fromiter(map(self.at.__getitem__, chunks), np.int64, len(chunks))

    def texts(self, chunks: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts given as ``counts`` chunks each: all ids, ids of each text, score of each text."""
        coded = chunks.dictionary_encode()
        entry = self.entries(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)] if len(chunks) else np.zeros(0, np.int64)
        sizes = self.sizes[entry]
        ids = self.ids[ranges(self.starts[entry], sizes)]
        ends = np.cumsum(counts)
        by_text = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])])
        return ids, by_text(sizes), by_text(self.scores[entry])


def interleaved(n: int, parts: list[tuple[np.ndarray, pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
    """Chunks in text order of ``parts``: (numbers of texts, their chunks, chunks of each)."""
    counts = np.zeros(n, np.int64)
    for rows, _, own in parts:
        counts[rows] = own
    chunks = pa.concat_arrays([c for _, c, _ in parts]) if parts else pa.array([], pa.string())
    begin, at = np.zeros(n, np.int64), 0
    for rows, own_chunks, own in parts:
        begin[rows] = at + np.cumsum(own) - own
        at += len(own_chunks)
    return chunks.take(pa.array(ranges(begin, counts))), counts
