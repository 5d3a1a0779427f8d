"""Column-wise construction of the Burrows-Wheeler transform and the common prefixes of a collection of short strings.

Round j inserts the j-th last symbol of every string at once. The transform so far, read in order, tells where the longer
suffixes belong (symbols sort stably, ties keep the order of what follows); the common prefix of a new neighbour pair is one
more than the least common prefix between the places that their remainders hold. Transform, prefixes and owners lie in
sequential files that each round reads from front to back and writes anew.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Sorts behind every symbol; UTF-8 never holds it. Marks a suffix whose preceding symbol is not inserted yet.
END = 255


class SequentialFile:
    """One array that is written and read from front to back."""

    def __init__(self, dtype):
        self.file, self.dtype, self.size = tempfile.TemporaryFile(), dtype, 0

    def write(self, values: np.ndarray) -> None:
        self.file.seek(0)
        values.astype(self.dtype, copy=False).tofile(self.file)
        self.file.flush()
        self.size = len(values)

    def read(self) -> np.ndarray:
        self.file.seek(0)
        return np.fromfile(self.file, self.dtype, self.size)


def least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least value of each range [low, high), none of them empty."""
    length = high - low
    begin = np.concatenate([[0], np.cumsum(length)[:-1]])
    flat = np.repeat(low - begin, length) + np.arange(length.sum())
    return np.minimum.reduceat(values[flat], begin)


def column_bwt(strings: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, suffix length, common prefix with the suffix before) of all suffixes in order.

    ``strings`` holds a string a row, at the right; equal suffixes follow in the order of the strings.
    """
    m, width = strings.shape
    bwt_file, lcp_file, owner_file = SequentialFile(np.uint8), SequentialFile(np.uint8), SequentialFile(np.int64)
    bwt_file.write(np.full(m, END))
    lcp_file.write(np.zeros(m))
    owner_file.write(np.arange(m) << 16)
    place = np.arange(m)
    for j in range(1, int(lengths.max(initial=0)) + 1):
        going = np.flatnonzero(lengths >= j)
        bwt, lcp = bwt_file.read(), lcp_file.read()
        bwt[place[going]] = strings[going, width - j]
        order = np.argsort(bwt, kind="stable")[: len(bwt) - np.count_nonzero(bwt == END)]
        rank = np.empty(len(bwt), np.int64)
        rank[order] = np.arange(len(order))
        rank = rank[place[going]]
        size = m + len(order)
        old = np.ones(size, bool)
        old[m + rank] = False
        grown = np.full(size, END, np.uint8)
        grown[old] = bwt
        prefix = np.zeros(size, np.uint8)
        prefix[old] = lcp
        changed = np.unique(np.concatenate([rank, rank + 1]))
        changed = changed[(changed > 0) & (changed < len(order))]
        before, here = order[changed - 1], order[changed]
        same = bwt[before] == bwt[here]
        prefix[m + changed] = 0
        if same.any():
            prefix[m + changed[same]] = 1 + least_between(lcp, before[same] + 1, here[same] + 1)
        if len(rank) and rank.min() == 0:
            prefix[m] = 0
        owner = np.empty(size, np.int64)
        owner[old] = owner_file.read()
        owner[m + rank] = (going << 16) | j
        bwt_file.write(grown)
        lcp_file.write(prefix)
        owner_file.write(owner)
        place[going] = m + rank
    owner = owner_file.read()
    return owner >> 16, owner & 0xFFFF, lcp_file.read()
