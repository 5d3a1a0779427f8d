"""Locally consistent parsing by recompression: runs, then pairs, are replaced by names, round after round.

A name is a fingerprint of what it stands for, so every task of every job gives the same run or pair the same name and
no dictionary has to be exchanged. Whether two neighbours are joined depends on their names alone (one bit of a name
says whether it opens or closes a pair). For each symbol the parser also keeps the words left and right of it that
took part in any such decision: wherever these words stand, the same symbol is found.
"""

from __future__ import annotations

import numpy as np

from voxcohort.llm.common import U, Ranges, mix

#: Context of a decision that the end of a text took part in: elsewhere the text may go on.
FAR = 1 << 40


def _needs(length, left, right, head):
    """Context of each symbol plus its whole neighbour, on either side; what touches the end of a text fits no window."""
    before = np.full(len(length), FAR)
    after = np.full(len(length), FAR)
    before[1:] = np.where(head[1:], FAR, length[:-1] + left[:-1])
    after[:-1] = np.where(head[1:], FAR, length[1:] + right[1:])
    return before, after


def rounds(names: np.ndarray, text: np.ndarray, n: int):
    """Yield (level, name, start, length, left, right) of all symbols after each of ``n`` rounds; level 0 is the words."""
    size = len(names)
    start, length = np.arange(size), np.ones(size, np.int64)
    left = right = np.zeros(size, np.int64)
    head = np.ones(size, bool)
    head[1:] = text[1:] != text[:-1]
    yield 0, names, start, length, left, right
    for level in range(1, n + 1):
        # Runs of one symbol.
        fresh = head.copy()
        fresh[1:] |= names[1:] != names[:-1]
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(names)) - 1
        before, after = _needs(length, left, right, head)
        count = last - first + 1
        names, head = np.where(count > 1, mix(names[first] * U(3) + count.astype(U)), names[first]), head[first]
        left, right = np.maximum(left[first], before[first]), np.maximum(right[last], after[last])
        length = start[last] + length[last] - start[first]
        start = start[first]
        # Pairs of an opening and a closing symbol.
        closes = ((mix(names + U(level)) >> U(17)) & U(1)).astype(bool)
        before, after = _needs(length, left, right, head)
        left = np.where(closes, np.maximum(left, before), left)
        right = np.where(closes, right, np.maximum(right, after))
        joined = np.zeros(len(names), bool)  # with its left neighbour
        joined[1:] = closes[1:] & ~closes[:-1] & ~head[1:]
        first = np.flatnonzero(~joined)
        last = np.append(first[1:], len(names)) - 1
        names = np.where(last > first, mix(names[first] * U(5) + mix(names[last] + U(level))), names[first])
        left, right = np.maximum(left[first], left[last] - length[first]), np.maximum(right[last], right[first] - length[last])
        length = start[last] + length[last] - start[first]
        start, head = start[first], head[first]
        yield level, names, start, length, left, right


#: Words that are parsed at a time.
STEP = 1 << 22


def anchors(names: np.ndarray, text: np.ndarray, window: int, levels: int):
    """``_anchors`` of any number of words: as a window's symbol depends on the window alone, windows are taken ``STEP`` at a time."""
    if len(names) < STEP + window:
        return _anchors(names, text, window, levels)
    found = []
    for begin in range(0, len(names) - window + 1, STEP):
        at, key, first, last = _anchors(names[begin: begin + STEP + window - 1], text[begin: begin + STEP + window - 1], window, levels)
        found.append((at + begin, key, first + begin, last + begin))
    return tuple(np.concatenate(x) for x in zip(*found))


def _anchors(names: np.ndarray, text: np.ndarray, window: int, levels: int):
    """One symbol for every window of words, chosen by the window's content alone.

    The symbol is of the highest level whose context lies inside the window, among these the one of least name, the
    leftmost of equals. Returns (position, fingerprint, first window, last window) per anchor: the windows of equal content
    have an anchor of equal fingerprint at the same distance. Windows are numbered by their first word and stay in one text.
    """
    size = len(names)
    empty = np.zeros(0, np.int64)
    if size < window:
        return empty, empty.astype(U), empty, empty
    none = U(0xFFFFFFFFFFFFFFFF)
    by_length: dict[int, np.ndarray] = {}
    begin, end = [], []
    for level, name, start, length, left, right in rounds(names, text, levels):
        low, high = start - left, start + length + right
        fits = high - low <= window
        low, high, name = low[fits], high[fits], name[fits]
        order = (U(levels - level) << U(60)) | ((mix(name) >> U(28)) << U(24))
        for extent in np.unique(high - low):
            at = np.flatnonzero(high - low == extent)
            table = by_length.setdefault(int(extent), np.full(size, none))
            # symbols of one extent that begin at one word: the least of them (at most one a level)
            table[low[at]] = np.minimum(table[low[at]], order[at] | low[at].astype(U))
        begin.append(low)
        end.append(high)
    best = by_length.get(1, np.full(size, none)).copy()
    reach = np.where(best != none, 1, 0).astype(np.int8)  # extent of the chosen symbol
    for extent in range(2, window + 1):
        shorter, wide = best[: size - extent + 1], best[1: size - extent + 2]
        take = wide < shorter
        reach[: size - extent + 1] = np.where(take, reach[1: size - extent + 2], reach[: size - extent + 1])
        best = np.minimum(shorter, wide)
        table = by_length.get(extent)
        if table is not None:
            table = table[: size - extent + 1]
            take = table < best
            reach[: size - extent + 1][take] = extent
            best = np.minimum(best, table)
    windows = np.flatnonzero(text[: size - window + 1] == text[window - 1:])
    if not len(windows):
        return empty, empty.astype(U), empty, empty
    at = (best[windows] & U((1 << 24) - 1)).astype(np.int64)
    extent = reach[windows].astype(np.int64)
    fresh = np.ones(len(windows), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (extent[1:] != extent[:-1]) | (windows[1:] != windows[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(windows)) - 1
    at, extent = at[first], extent[first]
    return at, mix(Ranges(names).of(at, at + extent) + extent.astype(U)), windows[first], windows[last]
