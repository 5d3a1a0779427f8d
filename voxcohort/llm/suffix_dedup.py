"""Exact substring deduplication over bytes: what a repeated run of ``window`` bytes covers goes, wherever it stands.

1. Every window of bytes has an anchor, its 32-byte gram of least fingerprint; one byte in about 185 is an anchor. Anchors that
   occur once in the corpus cannot lie in a repeat. If all occurrences of one have the same surroundings, all its windows repeat.
2. Around the other anchors, windows are taken in bands of 64 neighbouring starts. The bytes common to a band (the core) name
   the group in which it is compared; a probe holds what the band adds on the left and on the right. Equal probes collapse
   to one with a count before they are shuffled.
3. The probes of a group are strings over bytes with the core as one name. Their collection Burrows-Wheeler transform and
   common prefixes are built column by column (``column_bwt``); a window repeats where a common prefix spans it.
4. A group of more than ``largest`` different probes (one passage in very many contexts: more than a task builds a transform of at
   once) is counted window by window in Spark with the same result, so that no task holds such a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voxcohort.llm.column_bwt import column_bwt
from voxcohort.llm.common import CHUNK, Ranges, Shelf, U, byte_values, chunks, int64, mix, prepare, shuffle_partitions, utf8

WINDOW, GRAM, BAND = 400, 32, 64
#: Probes whose transform is built at once; a group of more is counted instead.
BLOCK = LARGEST = 20_000
#: A window that very many different probes hold is looked up by so many tasks.
SALTS = 16
_LOW = U((1 << 24) - 1)


class Bytes:
    """Several texts as one array, with their anchors: at, key, first and last window (all absolute), text index."""

    def __init__(self, texts: list[bytes], window: int):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.window = window
        size = len(self.data)
        none = np.zeros(0, np.int64)
        self.at, self.key, self.first, self.last, self.text = none, none.astype(U), none, none, none
        if size < window:
            return
        text = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(self.offsets))
        self.ranges = Ranges(byte_values(self.data))
        found = [self._anchors(a, min(a + 8 * CHUNK, size - window + 1), text) for a in range(0, size - window + 1, 8 * CHUNK)]
        self.at, self.first, self.last = (np.concatenate(x) for x in zip(*found))
        self.key = self.ranges.of(self.at, self.at + GRAM)
        self.text = text[self.at]

    def _anchors(self, begin: int, end: int, text: np.ndarray):
        """Anchors of the windows that start in [begin, end)."""
        start = np.arange(begin, end + self.window - GRAM)
        least = (self.ranges.of(start, start + GRAM) & ~_LOW) | (start - begin).astype(U)
        width, span = self.window - GRAM + 1, 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[: end - begin], least[width - span: width - span + end - begin])
        windows = np.flatnonzero(text[begin:end] == text[begin + self.window - 1: end + self.window - 1])
        at = (least[windows] & _LOW).astype(np.int64)
        if not len(at):
            return at, at, at
        fresh = np.ones(len(at), bool)
        fresh[1:] = (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(at)) - 1
        return at[first] + begin, windows[first] + begin, windows[last] + begin

    def pick(self, hits, begin: int) -> tuple[np.ndarray, np.ndarray]:
        """(anchors that ``hits`` names for their text, whether each needs a closer look)."""
        known, loose = [], []
        for i in range(len(self.offsets) - 1):
            row = hits[begin + i]
            if row.is_valid:
                known.append(mix(np.asarray(row.values.field(0)).view(U) + mix(np.full(len(row.values), i, U))))
                loose.append(row.values.field(1).to_numpy(zero_copy_only=False))
        if not known or not len(self.at):
            return np.zeros(0, np.int64), np.zeros(0, bool)
        known, loose = np.concatenate(known), np.concatenate(loose)
        order = np.argsort(known)
        asked = mix(self.key + mix(self.text.astype(U)))
        place = np.minimum(np.searchsorted(known[order], asked), len(known) - 1)
        found = np.flatnonzero(known[order][place] == asked)
        return found, loose[order][place[found]]


def _anchor_rows(batches, window: int):
    for batch in batches:
        docs = np.asarray(batch.column(0))
        for begin, texts in chunks(utf8(batch.column(1))):
            b = Bytes(texts, window)
            if not len(b.at):
                continue
            seg = mix(b.ranges.of(b.first, b.last + window) + (b.at - b.first).astype(U))
            doc = docs[begin + b.text]
            order = np.lexsort((seg, b.key, doc))
            doc, key, seg = doc[order], b.key[order], seg[order]
            fresh = np.ones(len(doc), bool)
            fresh[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (seg[1:] != seg[:-1])
            where = np.flatnonzero(fresh)
            count = np.diff(np.append(where, len(doc)))
            yield pa.record_batch([int64(doc[where]), int64(key[where]), int64(seg[where]), int64(count)], ["doc", "key", "seg", "n"])


def _probe_rows(batches, window: int, band: int):
    """(doc, start, one, two, lead, trail): the windows of an anchor that lie in one band, by core and flanks."""
    for batch in batches:
        docs = np.asarray(batch.column(0))
        for begin, texts in chunks(utf8(batch.column(1))):
            b = Bytes(texts, window)
            found, loose = b.pick(batch.column(2), begin)
            found = found[loose]
            if not len(found):
                continue
            at, near, far = b.at[found], b.at[found] - b.last[found], b.at[found] - b.first[found]
            n = far // band - near // band + 1
            row = np.repeat(np.arange(len(found)), n)
            grid = (near[row] // band + np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)) * band
            at, low, high = at[row], np.maximum(near[row], grid), np.minimum(far[row], grid + band - 1)
            core, core_end = at - grid, at - grid - (band - 1) + window
            salt = mix(b.key[found][row] + grid.astype(U))
            one = mix(b.ranges.of(core, core_end) ^ salt)
            two = mix(Ranges(mix(byte_values(b.data))).of(core, core_end) + salt)
            raw = b.data.tobytes()
            lead = [raw[x:y] for x, y in zip((at - high).tolist(), core.tolist())]
            trail = [raw[x:y] for x, y in zip(core_end.tolist(), (at - low + window).tolist())]
            text = b.text[found][row]
            yield pa.record_batch(
                [int64(docs[begin + text]), int64(at - high - b.offsets[text]), int64(one), int64(two),
                 pa.array(lead, pa.binary()), pa.array(trail, pa.binary())], ["doc", "start", "one", "two", "lead", "trail"])


def _judge(table: pa.Table, band: int) -> pa.RecordBatch:
    """Which windows of each probe repeat, as bits; ``table`` holds whole groups."""
    one, two = np.asarray(table["one"].combine_chunks()), np.asarray(table["two"].combine_chunks())
    fresh = np.ones(len(one), bool)
    fresh[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    group = np.cumsum(fresh) - 1
    lead, trail = table["lead"].to_pylist(), table["trail"].to_pylist()
    core = 3
    width = 2 * (band - 1) + core
    strings = np.full((len(one), width), 254, np.uint8)
    lengths, ahead = np.zeros(len(one), np.int64), np.array([len(x) for x in lead])
    for i, (x, y) in enumerate(zip(lead, trail)):
        g = int(group[i])
        whole = x + bytes((g % 250, g // 250 % 250, g // 62500)) + y
        strings[i, width - len(whole):] = np.frombuffer(whole, np.uint8)
        lengths[i] = len(whole)
    owner, length, prefix = column_bwt(strings, lengths)
    need = band - 1 + core
    again = prefix >= need
    again[:-1] |= again[1:]
    window = lengths[owner] - length
    count = ahead + np.array([len(y) for y in trail]) - (band - 1) + 1
    hit = again & (length > 0) & (window < count[owner])
    bits = np.zeros(len(one), U)
    np.bitwise_or.at(bits, owner[hit], U(1) << window[hit].astype(U))
    copies = np.asarray(table["n"].combine_chunks()) > 1
    bits[copies] = ~U(0) >> (64 - count[copies]).astype(U)
    return pa.record_batch([table["one"].combine_chunks(), table["two"].combine_chunks(), table["lead"].combine_chunks(),
                            table["trail"].combine_chunks(), int64(bits)], ["one", "two", "lead", "trail", "bits"])


def _judge_groups(batches, band: int):
    """Cut the sorted stream of probes into blocks of whole groups."""
    waiting: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        waiting.append(batch)
        held += batch.num_rows
        if held < BLOCK:
            continue
        table = pa.Table.from_batches(waiting)
        one, two = np.asarray(table["one"].combine_chunks()), np.asarray(table["two"].combine_chunks())
        last = int(np.flatnonzero((one != one[-1]) | (two != two[-1]))[-1]) + 1 if ((one != one[-1]) | (two != two[-1])).any() else 0
        if last:
            yield _judge(table.slice(0, last), band)
        waiting = table.slice(last).to_batches()
        held = table.num_rows - last
    if held:
        yield _judge(pa.Table.from_batches(waiting), band)


def _cut(batches, window: int, carry: list[str]):
    for batch in batches:
        where = {name: i for i, name in enumerate(batch.schema.names)}
        texts_all, kept_all, n_all, spans_all = utf8(batch.column(where["_text"])), [], [], []
        hits, marks = batch.column(where["_hits"]), batch.column(where["_marks"])
        for begin, texts in chunks(texts_all):
            b = Bytes(texts, window)
            found, loose = b.pick(hits, begin)
            plain = found[~loose]
            low, high = [b.first[plain]], [b.last[plain] + window]
            for i in range(len(texts)):
                row = marks[begin + i]
                if row.is_valid:
                    start, bits = np.asarray(row.values.field(0)), np.asarray(row.values.field(1))
                    probe, window_no = np.nonzero((bits[:, None] >> np.arange(BAND)) & 1)  # bit 63 is the sign
                    at = b.offsets[i] + start[probe] + window_no
                    low.append(at)
                    high.append(at + window)
            cover = np.zeros(len(b.data) + 1, np.int32)
            np.add.at(cover, np.concatenate(low), 1)
            np.add.at(cover, np.concatenate(high), -1)
            gone = np.cumsum(cover[:-1]) > 0
            for i, text in enumerate(texts):
                own = gone[b.offsets[i]: b.offsets[i + 1]]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
                n_all.append(len(text))
                spans_all.append([{"start": int(s), "end": int(e)} for s, e in zip(edges[::2], edges[1::2])])
                kept_all.append(text if not len(edges) else np.frombuffer(text, np.uint8)[~own].tobytes())
        spans = pa.array(spans_all, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        yield pa.record_batch([*(batch.column(where[c]) for c in carry), int64(n_all), pa.array(kept_all, pa.binary()), spans],
                              [*carry, "n_bytes", "kept", "removed"])


def _repeated_windows(probes: DataFrame, shelf: Shelf, band: int, largest: int) -> DataFrame:
    """(one, two, lead, trail, bits) of the probes that hold a repeated window."""
    group, probe = ["one", "two"], ["one", "two", "lead", "trail"]
    distinct = shelf.put(probes.groupBy(*probe).agg(F.count("*").alias("n")))
    sizes = distinct.groupBy(*group).agg(F.sum("n").alias("total"), F.count("*").alias("different")).where("total > 1")
    sized = shelf.put(distinct.join(sizes.hint("shuffle_hash"), group).select(*probe, "n", (F.col("different") > largest).alias("large")))
    small = sized.where("not large").drop("large").repartition(shuffle_partitions(shelf.spark), *group).sortWithinPartitions(*group)
    schema = "one long, two long, lead binary, trail binary, bits long"
    judged = small.mapInArrow(lambda b: _judge_groups(b, band), schema)
    ahead = F.length("lead")
    windows = (sized.where("large").select(*probe, "n", F.explode(F.sequence(F.lit(0), ahead + F.length("trail") - (band - 1))).alias("i"))
               .withColumn("head", F.expr("substring(lead, i + 1, length(lead) - i)"))
               .withColumn("tail", F.expr(f"substring(trail, 1, {band - 1} - length(lead) + i)")))
    again = windows.groupBy(*group, "head", "tail").agg(F.sum("n").alias("total")).where("total > 1").drop("total")
    again = again.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    counted = (windows.withColumn("salt", F.pmod(F.hash("lead", "trail"), F.lit(SALTS))).join(again, [*group, "head", "tail", "salt"])
               .groupBy(*probe).agg(F.expr("bit_or(shiftleft(1L, i))").alias("bits")))
    return judged.unionByName(counted).where("bits <> 0")


def remove_repeated_bytes(documents: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
                          largest: int = LARGEST, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, n_bytes, kept binary, removed) per row; removed holds the byte ranges [start, end) of the UTF-8 text. The columns in
    ``carry`` come along between key and n_bytes; ``window`` is at least 128.

    Null text counts as empty. Rows that repeat a key, and rows without a key, count as documents of their own, so equal texts
    remove each other. Other columns are ignored.
    """
    if window < GRAM + BAND + 32:
        raise ValueError("windows of fewer bytes have no common core")
    spark = documents.sparkSession
    prepare(spark)
    shelf = Shelf(spark)
    # A row is known by key and text together: keys may repeat or be missing, and rows equal in both have equal results.
    carried = [f"_c{i}" for i in range(len(carry) + 1)]
    docs = documents.select(*(F.col(c).alias(a) for c, a in zip((key, *carry), carried)), F.xxhash64(key, text).alias("doc"), F.col(text).alias("_text"))
    found = shelf.put(docs.select("doc", "_text").mapInArrow(lambda b: _anchor_rows(b, window), "doc long, key long, seg long, n long"))
    repeated = shelf.put(found.groupBy("key").agg(F.sum("n").alias("n"), F.min("seg").alias("low"), F.max("seg").alias("high"))
                         .where("n > 1").select("key", (F.col("low") != F.col("high")).alias("mixed")))
    hits = shelf.put(found.select("doc", "key").join(repeated.hint("shuffle_hash"), "key").groupBy("doc")
                     .agg(F.collect_set(F.struct("key", "mixed")).alias("_hits")))
    shelf.drop(found, repeated)
    mixed = hits.where(F.exists("_hits", lambda h: h["mixed"]))
    probes = shelf.put(docs.select("doc", "_text").join(mixed, "doc").mapInArrow(
        lambda b: _probe_rows(b, window, BAND), "doc long, start long, one long, two long, lead binary, trail binary"))
    marks = (probes.join(_repeated_windows(probes, shelf, BAND, largest), ["one", "two", "lead", "trail"])
             .groupBy("doc").agg(F.collect_set(F.struct("start", "bits")).alias("_marks")))
    joined = docs.join(hits, "doc", "left").join(shelf.put(marks), "doc", "left")
    made = StructType.fromDDL("n_bytes long, kept binary, removed array<struct<start: long, end: long>>")
    schema = StructType([docs.schema[c] for c in carried] + made.fields)
    out = joined.select(*carried, "_text", "_hits", "_marks").mapInArrow(lambda b: _cut(b, window, carried), schema)
    return out.select(*(F.col(a).alias(c) for c, a in zip((key, *carry), carried)), "n_bytes", "kept", "removed")
