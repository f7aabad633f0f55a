"""Content-chosen anchors: where equal byte strings of a given size meet.

The anchor of a string of ``size`` bytes is its k-gram of least hash (the
first of equals). Equal strings have equal anchors at equal places, and
strings that begin next to each other mostly share theirs, so that a run of
starts with one anchor travels as one segment of bytes.
"""

from __future__ import annotations

import numpy as np

from . import hashing

PLACE_BITS = 21
PIECE = (1 << PLACE_BITS) - 1


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i : i + w]) for every full window, by running minima within blocks of w."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.uint64(2**64 - 1))
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def segments(data: np.ndarray, ends: np.ndarray, size: int, k: int, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts with one anchor: (first start, number of starts, place of the anchor, its hash).

    ``ends`` has 0 and the end of each text in ``data``; only strings within a
    text count. Data beyond ``piece`` bytes (``PIECE`` at most, ``size`` at least)
    are handled in pieces that overlap by ``size - 1``, so that each start is in one.
    """
    out, n = [], len(data)
    for a in range(0, max(0, n - size + 1), piece - size + 1):
        part = data[a : a + piece]
        if len(part) < size:
            break
        sums = hashing.running(part)
        grams = np.arange(len(part) - k + 1)
        h = hashing.of_ranges(sums, grams, grams + k) if k else None
        low = np.uint64(PIECE)
        least = _sliding_min((h & ~low) | grams.astype(np.uint64), size - k + 1)
        own = ends[max(0, np.searchsorted(ends, a, "right") - 1) : np.searchsorted(ends, a + len(part), "left") + 1] - a
        valid = np.ones(len(least), bool)
        for e in own[(own > 0) & (own < len(part))]:
            valid[max(0, e - size + 1) : e] = False
        fresh = np.append(True, (least[1:] != least[:-1]) | (valid[1:] != valid[:-1]))
        first = np.flatnonzero(fresh)
        count = np.diff(np.append(first, len(least)))
        first, count = first[valid[first]], count[valid[first]]
        place = (least[first] & low).astype(np.int64)
        out.append((first + a, count, place + a, h[place]))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))  # type: ignore[return-value]
    return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]
