"""Substring deduplication over words: every later copy of a run of ``window`` words goes.

1. Each text is parsed by recompression (see ``recompression``). Every window of words gets an anchor: a high-level symbol
   that depends on the window's content alone. About one word in six is an anchor, so this is what is shuffled, not windows.
2. Anchors that occur once in the corpus are dropped. An anchor whose occurrences all have the same surroundings is *plain*:
   all its windows are repeats of one another and stand and fall together. Around the others each window is judged on its own.
3. What is left is compared by 128-bit fingerprints of its words; the first place (least document, least start) is kept.
4. Words that a repeated window covers are cut out.

Every group is pre-aggregated before it is shuffled (counts, extremes, first place), so a passage that a third of all
documents share costs one row a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxcohort.llm.common import Ranges, Shelf, U, Words, chunks, int64, mix, prepare, utf8
from voxcohort.llm.recompression import anchors

WINDOW, LEVELS = 20, 2


def _anchor_rows(batches: Iterator[pa.RecordBatch], window: int, levels: int) -> Iterator[pa.RecordBatch]:
    """(doc, key, seg, n): anchors of each document with a fingerprint of all words that the anchor's windows hold."""
    for batch in batches:
        docs = np.asarray(batch.column(0))
        for begin, texts in chunks(utf8(batch.column(1))):
            words = Words(texts)
            at, key, first, last = anchors(words.names, words.text, window, levels)
            if not len(at):
                continue
            seg = mix(Ranges(words.names).of(first, last + window) + (at - first).astype(U))
            doc = docs[begin + words.text[at]]
            order = np.lexsort((seg, key, doc))
            doc, key, seg = doc[order], key[order], seg[order]
            fresh = np.ones(len(doc), bool)
            fresh[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (seg[1:] != seg[:-1])
            where = np.flatnonzero(fresh)
            count = np.diff(np.append(where, len(doc)))
            yield pa.record_batch([int64(doc[where]), int64(key[where]), int64(seg[where]), int64(count)], ["doc", "key", "seg", "n"])


def _items(words: Words, hits: pa.ListArray, begin: int, window: int, levels: int):
    """What is compared: (text, first window, last window, fingerprint, second fingerprint) per plain anchor or single window."""
    at, key, first, last = anchors(words.names, words.text, window, levels)
    text = words.text[at]
    size = words.first.size - 1
    known, mixed, owner = [], [], []
    for i in range(size):
        row = hits[begin + i]
        if row.is_valid:
            keys = np.asarray(row.values.field(0)).view(U)
            known.append(keys)
            mixed.append(row.values.field(1).to_numpy(zero_copy_only=False))
            owner.append(np.full(len(keys), i))
    none = np.zeros(0, np.int64)
    if not known or not len(at):
        return none, none, none, none.astype(U), none.astype(U)
    known, mixed, owner = np.concatenate(known), np.concatenate(mixed), np.concatenate(owner)
    # an anchor is looked up by (text, key)
    order = np.lexsort((known, owner))
    table = mix(known[order] + mix(owner[order].astype(U)))
    rank = np.argsort(table)
    table, mixed = table[rank], mixed[order][rank]
    asked = mix(key + mix(text.astype(U)))
    place = np.minimum(np.searchsorted(table, asked), len(table) - 1)
    found = table[place] == asked
    first, last, text, loose = first[found], last[found], text[found], mixed[place[found]]
    plain = ~loose
    n = last[loose] - first[loose] + 1
    single = np.repeat(first[loose] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if loose.any() else none
    low = np.concatenate([first[plain], single])
    high = np.concatenate([last[plain], single])
    text = np.concatenate([text[plain], np.repeat(text[loose], n)])
    one = Ranges(words.names).of(low, high + window)
    two = Ranges(mix(words.names ^ U(0x5851F42D4C957F2D))).of(low, high + window)
    return text, low, high, one, two


def _item_rows(batches, window: int, levels: int):
    for batch in batches:
        docs = np.asarray(batch.column(0))
        for begin, texts in chunks(utf8(batch.column(1))):
            words = Words(texts)
            text, low, _, one, two = _items(words, batch.column(2), begin, window, levels)
            if len(text):
                yield pa.record_batch([int64(docs[begin + text]), int64(low - words.first[text]), int64(one), int64(two)], ["doc", "pos", "one", "two"])


def _cut(batches, window: int, levels: int):
    """Documents with their kept words and the removed word ranges."""
    for batch in batches:
        where = {name: i for i, name in enumerate(batch.schema.names)}
        texts_all, kept_all, n_all, spans_all = utf8(batch.column(where["_text"])), [], [], []
        hits, firsts = batch.column(where["_hits"]), batch.column(where["_firsts"])
        for begin, texts in chunks(texts_all):
            words = Words(texts)
            text, low, high, one, _ = _items(words, hits, begin, window, levels)
            cover = np.zeros(len(words) + 1, np.int64)
            if len(text):
                keep = []
                for i in range(len(texts)):
                    row = firsts[begin + i]
                    if row.is_valid:
                        pos, mark = np.asarray(row.values.field(0)), np.asarray(row.values.field(1)).view(U)
                        keep.append(mix(mark + mix((pos + words.first[i]).astype(U))))
                keep = np.sort(np.concatenate(keep)) if keep else np.zeros(0, U)
                asked = mix(one + mix(low.astype(U)))
                again = ~np.isin(asked, keep)
                np.add.at(cover, low[again], 1)
                np.add.at(cover, high[again] + window, -1)
            gone = np.cumsum(cover[:-1]) > 0
            for i in range(len(texts)):
                a, b = words.first[i], words.first[i + 1]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone[a:b], [False]]).astype(np.int8)))
                n_all.append(b - a)
                spans_all.append([{"start": int(s), "end": int(e)} for s, e in zip(edges[::2], edges[1::2])])
                kept_all.append(b" ".join(texts[i].split() if not len(edges) else [w for w, g in zip(texts[i].split(), gone[a:b]) if not g]))
        rest = [batch.column(i) for name, i in where.items() if not name.startswith("_")]
        names = [name for name in where if not name.startswith("_")]
        kept = pa.array(kept_all, pa.large_binary()).cast(pa.large_string()).cast(pa.string())
        spans = pa.array(spans_all, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        yield pa.record_batch([*rest, int64(n_all), kept, spans], [*names, "n_words", "kept", "removed"])


def remove_repeated_words(documents: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
                          levels: int = LEVELS) -> DataFrame:
    """(key, n_words, kept, removed) per row: kept words joined by a space, and removed word ranges [start, end).

    A window that starts at a smaller (key, position) elsewhere is removed. Null text counts as empty. A row without a key
    has no place in that order: it is kept whole and removes nothing. Rows that repeat a key count as that one document:
    they keep what starts at the same position. Other columns are ignored.
    """
    spark = documents.sparkSession
    prepare(spark)
    shelf = Shelf(spark)
    docs = documents.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("_text"))
    named = docs.where("doc is not null and _text is not null")
    found = shelf.put(named.mapInArrow(lambda b: _anchor_rows(b, window, levels), "doc long, key long, seg long, n long"))
    repeated = shelf.put(found.groupBy("key").agg(F.sum("n").alias("n"), F.min("seg").alias("low"), F.max("seg").alias("high"))
                         .where("n > 1").select("key", (F.col("low") != F.col("high")).alias("mixed")))
    hits = shelf.put(found.select("key", "doc").join(repeated.hint("shuffle_hash"), "key").groupBy("doc")
                     .agg(F.collect_set(F.struct("key", "mixed")).alias("_hits")))
    shelf.drop(found, repeated)
    firsts = shelf.put(
        named.join(hits, "doc").mapInArrow(lambda b: _item_rows(b, window, levels), "doc long, pos long, one long, two long")
        .groupBy("one", "two").agg(F.min(F.struct("doc", "pos")).alias("place"))
        .groupBy(F.col("place.doc").alias("doc")).agg(F.collect_list(F.struct("place.pos", "one")).alias("_firsts")))
    joined = docs.join(hits, "doc", "left").join(firsts, "doc", "left")
    spans = "array<struct<start: long, end: long>>"
    return joined.mapInArrow(lambda b: _cut(b, window, levels), f"doc long, n_words long, kept string, removed {spans}") \
        .withColumnRenamed("doc", key)
