"""Suffix arrays in numpy by Larsson-Sadakane refinement, for many texts at once.

Suffixes are grouped by their first symbols; each round sorts only the members
of groups with more than one suffix, by the group of the suffix ``h`` further
on, and doubles ``h``.  A suffix never reads past the end of its own text.
"""

from __future__ import annotations

import numpy as np

from sift.llm.anchors import words_at


class Suffixes:
    """``array``: suffix positions in sorted order; ``levels``: (h, rank) after each round.

    Two suffixes have equal rank at level h exactly when their first h symbols
    are equal and lie inside their texts (or they are the same suffix).
    """

    def __init__(self, array: np.ndarray, levels: list[tuple[int, np.ndarray]], end: np.ndarray):
        self.array, self.levels, self.end = array, levels, end

    def common_prefix(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at i and j (in symbols; below twice the top level)."""
        i, j = i.copy(), j.copy()
        length = np.zeros(len(i), np.int64)
        last = len(self.end) - 1
        for h, rank in reversed(self.levels):
            inside = (i < self.end[np.minimum(i - length, last)]) & (j < self.end[np.minimum(j - length, last)])
            same = inside & (rank[np.minimum(i, last)] == rank[np.minimum(j, last)])
            step = np.where(same, h, 0)
            length += step
            i += step
            j += step
        return length


#: Positions below this fit a third of a 63-bit key.
_PACKED = 1 << 21


def suffix_sort(keys: np.ndarray, end: np.ndarray, start_depth: int = 1, depth: int | None = None,
                keep_levels: bool = True) -> Suffixes:
    """Sort the suffixes of texts laid end to end.

    ``keys[p]``: integer that orders suffixes by their first ``start_depth``
    symbols (unlike for suffixes that have fewer left); ``end[p]``: where the
    text of p ends.  With ``depth``, rounds stop once that many symbols decide.
    Without ``keep_levels`` only the last ranks are kept.
    """
    n = len(keys)
    array = np.argsort(keys)     # the order of equal keys is settled below
    slots = np.arange(n)
    ordered = keys[array]
    fresh = np.ones(n, bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(n, np.int32)
    rank[array] = np.maximum.accumulate(np.where(fresh, slots, 0))
    levels, h = [(start_depth, rank.copy())], start_depth
    active = _members(slots, fresh)
    while active.size and (depth is None or h < depth):
        at = array[active]
        ahead = at + h
        beyond = np.where(ahead < end[at], rank[np.minimum(ahead, n - 1)], -1).astype(np.int64)
        if n < _PACKED:   # rank, rank ahead and position in one word: a plain sort, equal suffixes by position
            key = (rank[at].astype(np.uint64) << np.uint64(42)) | ((beyond + 1).astype(np.uint64) << np.uint64(21)) | at.astype(np.uint64)
            key.sort()
            at = (key & np.uint64(_PACKED - 1)).astype(np.int64)
            key >>= np.uint64(21)
        else:
            key = rank[at].astype(np.int64) * (n + 1) + beyond + 1
            order = np.lexsort((at, key))
            at, key = at[order], key[order]
        array[active] = at
        fresh = np.ones(len(at), bool)
        fresh[1:] = key[1:] != key[:-1]
        rank[at] = active[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        h *= 2
        levels = [*levels, (h, rank.copy())] if keep_levels else [(h, rank)]
        active = _members(active, fresh)
    return Suffixes(array, levels, end)


def _members(slots: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """The slots of groups with more than one member."""
    alone = fresh.copy()
    alone[:-1] &= fresh[1:]
    return slots[~alone]


def kasai(suffixes: Suffixes, data: np.ndarray, start: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the array, by slot, up to ``limit``.

    Suffixes with fewer than ``limit`` symbols left are not looked at and have 0.

    Kasai's scan goes through a text from left to right and keeps the length it
    has reached less one.  Here all texts (beginning at ``start``) are scanned in
    step, eight bytes at a time.
    """
    n = len(data)
    end, array = suffixes.end, suffixes.array
    slot = np.empty(n, np.int64)
    slot[array] = np.arange(n)
    words = words_at(data)
    common = np.zeros(n, np.int64)
    some = start + limit <= end[start]
    at, stop = start[some], end[start[some]]
    have = np.zeros(len(at), np.int64)
    while len(at):
        other = array[np.maximum(slot[at] - 1, 0)]
        room = np.minimum(np.minimum(stop - at, end[other] - other), limit)
        have = np.minimum(np.maximum(have - 1, 0), room)
        have[slot[at] == 0] = 0
        going = np.flatnonzero((have < room) & (slot[at] > 0))
        while len(going):
            here = have[going]
            differ = words[at[going] + here] ^ words[other[going] + here]
            # equal leading bytes of the two words: how often the difference can be halved to nothing, by byte
            equal = np.where(differ == 0, 8, _LEADING - np.searchsorted(_BYTE_STEPS, differ, side="right"))
            have[going] = np.minimum(here + equal, room[going])
            going = going[(equal == 8) & (have[going] < room[going])]
        common[slot[at]] = have
        at = at + 1
        alive = at + limit <= stop
        at, stop, have = at[alive], stop[alive], have[alive]
    return common


#: Smallest values of a word whose highest set byte is the k-th from below.
_BYTE_STEPS = np.array([1 << (8 * k) for k in range(8)], np.uint64)
_LEADING = 8


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in the union of the spans."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:-1]) > 0
