"""Suffix trees of symbol sequences: online construction, order of the suffixes, and longest common extensions in constant time."""

from __future__ import annotations

import numpy as np


class SuffixTree:
    """Ukkonen's tree of ``symbols``; its last symbol occurs once, so that every suffix is a leaf.

    ``order`` lists the suffixes as a walk through the tree (children by ``rank`` of their first symbol) meets them. The walk passes
    an inner node between two of its children; the string depths of these passages are the part of the Euler tour in which the
    lowest common ancestor of two leaves lies, so its minimum between them is their longest common extension.
    """

    def __init__(self, symbols: np.ndarray):
        text = symbols.tolist()
        self.size = size = len(text)
        self.base = base = int(symbols.max(initial=0)) + 1
        far = size
        # node 0 is the root; an edge goes from the node and its first symbol to the node below
        begin, end, link, suffix, go = [0], [0], [0], [-1], {}
        node = edge = length = waiting = 0
        for i, c in enumerate(text):
            open_link = 0
            waiting += 1
            while waiting:
                if not length:
                    edge = i
                key = node * base + text[edge]
                child = go.get(key)
                if child is None:
                    go[key] = len(begin)
                    begin.append(i), end.append(far), link.append(0), suffix.append(i - waiting + 1)
                    if open_link:
                        link[open_link] = node
                    open_link = node
                else:
                    low = begin[child]
                    high = end[child]
                    extent = (high if high <= i else i + 1) - low
                    if length >= extent:
                        edge += extent
                        length -= extent
                        node = child
                        continue
                    if text[low + length] == c:
                        length += 1
                        if open_link:
                            link[open_link] = node
                        break
                    split = len(begin)
                    go[key] = split
                    begin.append(low), end.append(low + length), link.append(0), suffix.append(-1)
                    go[split * base + c] = split + 1
                    begin.append(i), end.append(far), link.append(0), suffix.append(i - waiting + 1)
                    begin[child] = low + length
                    go[split * base + text[low + length]] = child
                    if open_link:
                        link[open_link] = split
                    open_link = split
                waiting -= 1
                if not node and length:
                    length -= 1
                    edge = i - waiting + 1
                else:
                    node = link[node]
        keys = np.fromiter(go.keys(), np.int64, len(go))
        self.above, self.symbol, self.below = keys // base, keys % base, np.fromiter(go.values(), np.int64, len(go))
        self.suffix = suffix
        self.extent = (np.array(end) - np.array(begin)).tolist()

    def _walk(self, rank: np.ndarray, passages: bool) -> tuple[np.ndarray, np.ndarray]:
        """(suffixes in order, string depths of the passages between them)."""
        sort = np.lexsort((rank[self.symbol], self.above))
        below = self.below[sort].tolist()
        bounds = np.searchsorted(self.above[sort], np.arange(len(self.suffix) + 1)).tolist()
        suffix, extent, depth = self.suffix, self.extent, [0] * len(self.suffix)
        order, between, stack = [], [], [0]
        while stack:
            node = stack.pop()
            if node < 0:
                between.append(depth[~node])
                continue
            if suffix[node] >= 0:
                order.append(suffix[node])
                continue
            children = below[bounds[node]: bounds[node + 1]]
            if passages:
                reach = depth[node]
                for child in reversed(children):
                    depth[child] = reach + extent[child]
                    stack.append(child)
                    stack.append(~node)
                stack.pop()
            else:
                stack.extend(reversed(children))
        return np.array(order, np.int64), np.array(between, np.int32)

    def places(self, rank: np.ndarray) -> np.ndarray:
        """Place of every suffix when symbols are ordered by ``rank``."""
        place = np.empty(self.size, np.int64)
        place[self._walk(rank, False)[0]] = np.arange(self.size)
        return place

    def prepare(self) -> np.ndarray:
        """Get ready for ``extension``; returns the place of every suffix by rising symbols."""
        order, between = self._walk(np.arange(self.base), True)
        self.place = np.empty(self.size, np.int64)
        self.place[order] = np.arange(self.size)
        self.least, width = [between], 1
        while 2 * width <= len(between):  # minima of ranges of 1, 2, 4, ... passages
            last = self.least[-1]
            self.least.append(np.minimum(last[:-width], last[width:]))
            width *= 2
        return self.place

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes ``a`` and ``b`` (different ones), pair by pair."""
        low, high = np.minimum(self.place[a], self.place[b]), np.maximum(self.place[a], self.place[b])
        out = np.zeros(len(low), np.int64)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            table = self.least[k]
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << int(k))])
        return out
