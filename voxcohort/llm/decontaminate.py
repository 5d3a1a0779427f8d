"""Benchmark decontamination with an edit budget, filtered by the q-gram lemma.

An item of m characters with at most k edits shares at least m - q + 1 - k q q-grams with its copy, on diagonals (place in the text
less place in the item) that lie within k of one another. Shared q-grams are counted in overlapping bands of 2 (k + 1) diagonals;
a band that reaches the bound is a region, and a banded alignment of the region decides.

Texts are compared in lower case with white space runs as one space. The index of the items is sent to the tasks in blocks of at
most ``BLOCK`` characters, so its size is bounded; the documents are scanned once a block and are never shuffled.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxcohort.llm.common import CHUNK, Ranges, U, int64, mix, prepare

#: Edits allowed: one in so many characters. Longest q-gram.
EDITS, GRAM = 16, 10
BLOCK = 1 << 21
#: Pairs of equal q-grams that are counted at a time (one place of the text may hold more).
HITS = 1 << 20
_TABLE = 22


def normal(text: str) -> str:
    return re.sub(r"\s+", " ", text.lower()).strip()


def codes(text: str) -> np.ndarray:
    return mix(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(U))


class Index:
    """The q-grams of some items: where they stand in which item."""

    def __init__(self, items: list[tuple[int | None, str]], edits: int = EDITS, gram: int = GRAM):
        self.ids, self.texts = [i for i, _ in items], [t for _, t in items]
        length = np.array([len(t) for t in self.texts])
        self.budget = length // edits
        self.gram = np.minimum(gram, length // (self.budget + 1))  # short items need short grams for a bound of one or more
        self.need = length - self.gram + 1 - self.budget * self.gram
        self.tables = {}
        for q in np.unique(self.gram):
            key, item, place = [], [], []
            for n in np.flatnonzero(self.gram == q):
                at = np.arange(length[n] - q + 1)
                key.append(Ranges(codes(self.texts[n])).of(at, at + q))
                item.append(np.full(len(at), n))
                place.append(at)
            key, item, place = map(np.concatenate, (key, item, place))
            order = np.argsort(key, kind="stable")
            present = np.zeros(1 << _TABLE, bool)
            present[(key >> U(64 - _TABLE)).astype(np.int64)] = True
            self.tables[int(q)] = key[order], item[order], place[order], present

    def regions(self, text: str):
        """(item, band) that share enough q-grams."""
        values = Ranges(codes(text))
        for q, (key, item, place, present) in self.tables.items():
            at = np.arange(len(text) - q + 1)
            if not len(at):
                continue
            grams = values.of(at, at + q)
            at = np.flatnonzero(present[(grams >> U(64 - _TABLE)).astype(np.int64)])
            low, high = np.searchsorted(key, grams[at]), np.searchsorted(key, grams[at], "right")
            count = high - low
            if not count.any():
                continue
            # shared q-grams of each (item, band), some at a time: a periodic text meets a periodic item very often
            parts = np.searchsorted(np.cumsum(count), np.arange(HITS, count.sum() + HITS, HITS)) + 1
            bands = [self._bands(at[a:b], low[a:b], count[a:b], item, place) for a, b in zip([0, *parts[:-1]], parts) if b > a]
            pair, which = np.unique(np.concatenate([p for p, _ in bands], axis=1), axis=1, return_inverse=True)
            found = np.bincount(which.reshape(-1), np.concatenate([c for _, c in bands]))
            # a region is two neighbouring bands
            after = np.flatnonzero((pair[0, 1:] == pair[0, :-1]) & (pair[1, 1:] == pair[1, :-1] + 1))
            both = found.copy()
            both[after] += found[after + 1]
            alone = np.ones(len(found), bool)
            alone[after + 1] = False  # its region with the band before it has been counted
            regions = np.concatenate([pair, pair[:, alone] - [[0], [1]]], axis=1)
            shared = np.concatenate([both, found[alone]])
            regions = regions[:, shared >= self.need[regions[0]]]
            for which in np.lexsort(regions[::-1]):
                yield int(regions[0, which]), int(regions[1, which])

    def _bands(self, at, low, count, item, place) -> tuple[np.ndarray, np.ndarray]:
        """((item, band) pairs, q-grams that both share there); bands are k + 1 diagonals wide."""
        hit = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        n = item[hit]
        return np.unique([n, (np.repeat(at, count) - place[hit]) // (self.budget[n] + 1)], axis=1, return_counts=True)


def banded_distance(item: str, text: str, slack: int, missing: int = 0) -> tuple[int, int]:
    """(least edits that turn ``item`` into a part of ``text``, where the part ends) on diagonals -``missing`` to ``slack``.

    A diagonal is a place in the text less the place in the item; on one below 0 the item begins before the text does.
    """
    a, b = np.frombuffer(item.encode("utf-32-le", "surrogatepass"), "<u4"), np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    b = np.concatenate([np.zeros(missing, b.dtype), b])  # cells in front of the text: no part begins there, so none is ever used
    far, width = len(a) + len(b) + 1, slack + missing + 1
    padded = np.concatenate([b, np.zeros(len(a) + width + 1, b.dtype)])
    beyond = np.arange(len(a) + width) > len(b)  # ends behind the text
    steps = np.arange(width)
    row = np.where(beyond[:width] | (steps < missing), far, 0)  # item not begun: the part may begin on any diagonal
    for i, c in enumerate(a, 1):
        change = row + (padded[i - 1: i - 1 + width] != c)
        drop = np.append(row[1:] + 1, far)
        best = np.where(beyond[i: i + width], far, np.minimum(change, drop))
        row = np.minimum.accumulate(best - steps) + steps  # characters of the text that the item lacks
        row = np.minimum(row, far)
    end = int(row.argmin())
    return int(row[end]), len(a) + end - missing


def _pieces(text: str, most: int, overlap: int):
    """Overlapping pieces of a very long text, so that memory stays bounded."""
    begin = 0
    while True:
        yield begin, text[begin: begin + most + overlap]
        begin += most
        if begin >= len(text):
            return


def _found(raw: str | None, index: Index):
    """(item, edits, where the passage ends in the compared form) for every band of the text that holds an item.

    After a place without edits, later places of the item are not looked at: none is better.
    """
    longest = max((len(t) for t in index.texts), default=0)
    exactly: set[int] = set()
    for offset, piece in _pieces(normal(raw or ""), CHUNK, 2 * longest):
        for n, band in index.regions(piece):
            if n in exactly:
                continue
            k, item = int(index.budget[n]), index.texts[n]
            low = band * (k + 1) - k
            area = piece[max(0, low): (band + 2) * (k + 1) + k + len(item)]
            exact = area.find(item)
            if exact >= 0:
                exactly.add(n)
                distance, end = 0, exact + len(item)
            else:
                # in front of the text an item can lack its first characters, up to k of them
                distance, end = banded_distance(item, area, max(0, len(area) - len(item) + k), min(k, max(0, -low)))
            if distance <= k:
                yield n, distance, offset + max(0, low) + end


def _hits(batches, index: Index):
    names = ["doc", "item_id", "distance", "start", "end"]
    for batch in batches:
        out = {}
        for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for n, *found in _found(raw, index):
                out[doc, n] = min(found, out.get((doc, n), found))
        rows = [(doc, index.ids[n], d, max(0, e - len(index.texts[n])), e) for (doc, n), (d, e) in out.items()]
        if rows:
            doc, item, *numbers = zip(*rows)
            yield pa.record_batch([pa.array(doc, batch.column(0).type), pa.array(item, pa.int64()), *map(int64, numbers)], names)


def _indices(benchmark: DataFrame, key: str, text: str, edits: int, gram: int):
    """The items as indices of at most ``BLOCK`` characters, or of one longer item."""
    block, size = [], 0
    for row in benchmark.select(F.col(key).cast("long"), F.col(text)).where(F.col(text).isNotNull()).toLocalIterator():
        item = normal(row[1])
        if not item:
            continue
        if block and size + len(item) > BLOCK:
            yield Index(block, edits, gram)
            block, size = [], 0
        block.append((row[0], item))
        size += len(item)
    if block:
        yield Index(block, edits, gram)


def contaminated(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                 item_text: str = "text", edits: int = EDITS, gram: int = GRAM) -> DataFrame:
    """(key, item_id, distance, start, end): documents that hold an item with at most one edit in ``edits`` characters.

    One row per document row and item, its best place (ends of the passage in the compared form of the text; start is that end less
    the item's length). Null or blank texts and items match nothing; equal items are reported each; keys may be null or repeat.
    """
    spark = documents.sparkSession
    prepare(spark)
    kind = documents.schema[key].dataType.simpleString()
    docs = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.col(text))
    schema = f"doc {kind}, item_id long, distance long, start long, end long"
    out = spark.createDataFrame([], schema)
    for index in _indices(benchmark, item_key, item_text, edits, gram):
        out = out.unionByName(docs.mapInArrow(lambda b, index=index: _hits(b, index), schema))
    return out.withColumnRenamed("doc", key)


def without_leaks(documents: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", edits: int = EDITS,
                  gram: int = GRAM) -> DataFrame:
    """The rows that hold no item in the sense of ``contaminated``, with all their columns.

    Every row is judged by its own text, where it lies: nothing is shuffled, and null or repeated keys do not matter. A row that one
    block of items removes is not read for the next. Null and blank texts stay.
    """
    prepare(documents.sparkSession)
    for index in _indices(benchmark.withColumn("_none", F.lit(None)), "_none", item_text, edits, gram):
        leak = F.pandas_udf(lambda texts, index=index: texts.map(lambda t: next(_found(t, index), None) is not None).astype(bool), "boolean")
        documents = documents.where(~leak(F.col(text)))
    return documents
