"""Maximal periodic runs of words, by longest common extensions of suffix trees.

Every run contains a Lyndon root: for one of the two orders of the words, the longest Lyndon word at some place of the run is
one period long. So there are two candidates a place; each is extended right and left by longest common extensions (suffix
trees of the text and of its reversal, lowest common ancestors by Euler tour), and is a run if it spans two periods.

A run of n >= 2 q words with period q >= 1 and n >= ``shortest`` repeats every n - q >= shortest / 2 words at distance q. So all its words lie in
repeated windows of shortest / 2 words of one document: only stretches covered by such windows reach the trees, which loses no run.
Words are told apart by 64-bit fingerprints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxcohort.llm.common import Ranges, U, Words, chunks, int64, mix, prepare, utf8
from voxcohort.llm.suffix_tree import SuffixTree

SHORTEST = 12
#: Words of the stretches that share a pair of trees; a longer stretch has its own.
TREE = 20_000
_ROUNDS = 4


def _stretches(names: np.ndarray, text: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """[begin, end) of the stretches that can hold runs."""
    gram = (shortest + 1) // 2
    size = len(names)
    none = np.zeros(0, np.int64)
    if size < shortest:
        return none, none
    grams = Ranges(names).of(np.arange(size - gram + 1), np.arange(gram, size + 1))
    within, begins, ends = text.astype(np.int64), none, none
    for _ in range(_ROUNDS):  # a stretch broken up has fewer repeats; any number of rounds is right
        at = np.flatnonzero((within[: size - gram + 1] == within[gram - 1:]) & (within[: size - gram + 1] >= 0))
        keys = mix(grams[at] + mix(within[at].astype(U)))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(size + 1, np.int64)
        np.add.at(cover, at[twice], 1)
        np.add.at(cover, at[twice] + gram, -1)
        inside = np.cumsum(cover[:-1]) > 0
        edge = np.ones(size, bool)
        edge[1:] = (inside[1:] != inside[:-1]) | (within[1:] != within[:-1])
        begins = np.flatnonzero(edge)
        ends = np.append(begins[1:], size)
        keep = inside[begins] & (ends - begins >= shortest)
        before = np.count_nonzero(within >= 0)
        within = np.where(np.repeat(keep, ends - begins), np.repeat(np.arange(len(begins)), ends - begins), -1)
        begins, ends = begins[keep], ends[keep]
        if np.count_nonzero(within >= 0) == before:
            break
    return begins, ends


def _next_smaller(place: np.ndarray) -> np.ndarray:
    """The next index with a smaller value; the last one of all has none."""
    values, out, stack = place.tolist(), [len(place)] * len(place), []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out, np.int64)


def _runs(parts: list[np.ndarray], shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(part, start, length, period) of the runs of several sequences, which share two trees."""
    known, words = np.unique(np.concatenate(parts), return_inverse=True)
    count = len(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1  # each sequence ends in a symbol of its own, smaller than all words
    symbols = np.empty(int(ends[-1]) + 1, np.int64)
    inside = np.ones(len(symbols), bool)
    inside[ends] = False
    symbols[inside], symbols[ends] = words + count, np.arange(count)
    size = len(symbols)
    tree, back = SuffixTree(symbols), SuffixTree(np.append(symbols[::-1], symbols.max() + 1))
    rising = tree.prepare()
    back.prepare()
    rank = np.arange(tree.base)
    rank[count:] = rank[count:][::-1]
    at = np.flatnonzero(inside)
    found = []
    for place in (rising, tree.places(rank)):
        after = _next_smaller(place)[at]
        period = after - at
        right = tree.extension(at, after)
        left = np.zeros(len(at), np.int64)
        some = at > 0
        left[some] = back.extension(size - at[some], size - after[some])
        length = left + period + right
        good = (length >= 2 * period) & (length >= shortest)
        found.append(np.stack([at[good] - left[good], length[good], period[good]]))
    start, length, period = np.unique(np.concatenate(found, axis=1), axis=1)
    part = np.searchsorted(ends, start)
    return part, start - np.append(0, ends[:-1] + 1)[part], length, period


def runs_of(names: np.ndarray, text: np.ndarray, shortest: int = SHORTEST):
    """(start, length, period) in the joined texts, sorted; no run crosses from one text into another."""
    begins, ends = _stretches(names, text, shortest)
    out = [np.zeros((3, 0), np.int64)]
    first = 0
    while first < len(begins):
        last, held = first, 0
        while last < len(begins) and (last == first or held + ends[last] - begins[last] <= TREE):
            held += int(ends[last] - begins[last])
            last += 1
        part, start, length, period = _runs([names[a:b] for a, b in zip(begins[first:last], ends[first:last])], shortest)
        out.append(np.stack([start + begins[first + part], length, period]))
        first = last
    start, length, period = np.concatenate(out, axis=1)
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _describe(batches, shortest: int):
    for batch in batches:
        n_all, runs_all, kept_all = [], [], []
        for _, texts in chunks(utf8(batch.column(1))):
            words = Words(texts)
            start, length, period = runs_of(words.names, words.text, shortest)
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, start + period, 1)
            np.add.at(cover, start + length, -1)
            gone = np.cumsum(cover[:-1]) > 0
            bounds = np.searchsorted(start, words.first)
            for i, text in enumerate(texts):
                a, b = int(words.first[i]), int(words.first[i + 1])
                low, high = bounds[i], bounds[i + 1]
                n_all.append(b - a)
                runs_all.append([{"start": int(s) - a, "length": int(m), "period": int(p)}
                                 for s, m, p in zip(start[low:high], length[low:high], period[low:high])])
                split = text.split()
                kept_all.append(b" ".join(split if low == high else [w for w, g in zip(split, gone[a:b]) if not g]))
        kept = pa.array(kept_all, pa.large_binary()).cast(pa.large_string()).cast(pa.string())
        runs = pa.array(runs_all, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))
        yield pa.record_batch([batch.column(0), int64(n_all), runs, kept], ["doc", "n_words", "runs", "collapsed"])


def periodic_runs(documents: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """(key, n_words, runs, collapsed) per row: the maximal runs of at least ``shortest`` words and two periods by start and period, and
    the text without the words that a run holds after its first period, joined by one space.

    A run is a stretch of consecutive words ``[^\\x20\\x09-\\x0D]+`` with its smallest period that no neighbouring word extends. Rows are
    independent: keys may be null or repeat. Null text counts as empty and has no words; other columns are ignored.
    """
    if shortest < 2:
        raise ValueError("a run has at least two words")
    prepare(documents.sparkSession)
    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    runs = "array<struct<start: long, length: long, period: long>>"
    return rows.mapInArrow(lambda b: _describe(b, shortest), f"doc {kind}, n_words long, runs {runs}, collapsed string").withColumnRenamed("doc", key)
