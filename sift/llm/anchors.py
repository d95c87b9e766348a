"""Content-defined anchors: positions that equal windows of text choose alike.

Every window of ``WINDOW`` bytes chooses, among the ``GRAM``-byte strings inside
it, the one with the smallest hash (the leftmost of equals).  The choice depends
on the window's bytes alone, so equal windows, wherever they stand, choose the
same string at the same offset.  Neighbouring windows mostly share a choice: the
starts that choose one position form an interval.
"""

from __future__ import annotations

import numpy as np

WINDOW = 200
GRAM = 32

_MULT = tuple(np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
#: Low bits of a selection key that hold the position; a block is at most this long.
_PLACE_BITS = 24
MAX_BLOCK = 1 << _PLACE_BITS


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a big-endian integer (zeros beyond the end)."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)]).tobytes()
    out = np.empty(len(data) + 8, np.uint64)
    for k in range(8):
        part = np.frombuffer(padded, ">u8", (len(padded) - k) // 8, k)
        out[k::8] = part[:len(out[k::8])]
    return out[:len(data)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes from each position that has as many."""
    n = len(data) - GRAM + 1
    words = words_at(data)
    words ^= words >> np.uint64(32)
    words *= _MULT[0]
    words ^= words >> np.uint64(29)
    total = words[:n] * _MULT[0]
    for k in range(1, GRAM // 8):
        total += words[8 * k:8 * k + n] * _MULT[k]
    total ^= total >> np.uint64(32)
    total *= _MULT[1]
    return total


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbouring keys, by doubling."""
    span = 1
    while 2 * span <= width:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    return keys if span == width else np.minimum(keys[:len(keys) - (width - span)], keys[width - span:])


def anchors(data: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, first start, last start, hash) of every anchor of texts laid end to end.

    ``end[p]``: where the text of p ends.  A start whose window would leave its text chooses nothing.
    """
    n = len(data) - WINDOW + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    if len(data) > MAX_BLOCK:
        raise ValueError("the block is too long")
    hashes = gram_hashes(data)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    keys = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    chosen = (_sliding_min(keys, WINDOW - GRAM + 1) & low).astype(np.int64)
    starts = np.flatnonzero(np.arange(n) + WINDOW <= end[:n])
    chosen = chosen[starts]
    if not len(starts):
        return starts, starts, starts, starts
    fresh = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)])
    at = np.flatnonzero(fresh)
    last = np.concatenate([at[1:], [len(starts)]]) - 1
    return chosen[at], starts[at], starts[last], hashes[chosen[at]].view(np.int64)
