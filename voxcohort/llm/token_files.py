"""Token ids of documents as files of independently coded, checksummed blocks, and back.

Documents are sorted by key in ranges; each range becomes one run of ids, cut into blocks of at most ``BLOCK`` ids. A block is one
frame of bytes (``pack``): it is coded by ``mixing_coder`` from an empty model, lists the parts of documents that it holds and
ends in a checksum, so any block can be read without the others and damage is found before it is used. Frames are stored one a row
in Parquet: Spark commits them whole, any store that Spark reads can hold them, and a lost executor's frames are written again.

Frame: ``VXT1``, then five 32-bit numbers (ids, alphabet size, document parts, bytes of the alphabet, bytes of the payload) and the
64-bit place of the first id in its range; the alphabet as gaps of 7 bits a byte; per part the row in the range, the key, a flag for a
null key and the number of ids; the payload; CRC-32 of all before. All numbers are little-endian.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxcohort.llm import mixing_coder
from voxcohort.llm.common import Shelf, int64, prepare, shuffle_partitions

_HEAD = struct.Struct("<4s5Iq")
_PART = np.dtype([("row", "<i8"), ("key", "<i8"), ("null", "u1"), ("ids", "<u4")])
#: Different pieces of text whose ids a task remembers.
_PIECES = 1 << 19
_SPLIT = re.compile(r"(?<=\S) (?=\S)")


class _Numbers(dict):
    """Numbers pieces of text as they are first asked for."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.new.append(piece)
        return number


class _Memory:
    """Ids of the pieces with one beginning (a space, or nothing), in one array."""

    def __init__(self, tokenizer, begins: str):
        self.tokenizer, self.begins, self.numbers = tokenizer, begins, _Numbers()
        self.first, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def __call__(self, pieces) -> np.ndarray:
        """The number of each piece; ids of piece n lie from ``first[n]`` to ``first[n + 1]``."""
        found = np.fromiter(map(self.numbers.__getitem__, pieces), np.int64)
        new, self.numbers.new = self.numbers.new, []
        if new:
            made = [e.ids for e in self.tokenizer.encode_batch([self.begins + p for p in new], add_special_tokens=False)]
            self.first = np.append(self.first, self.first[-1] + np.cumsum([len(m) for m in made]))
            self.ids = np.append(self.ids, np.fromiter(chain.from_iterable(made), np.uint32))
        return found


class Encoder:
    """Ids of texts by a tokenizer file. A byte-level pre-tokenizer always cuts before a single space between two other characters,
    so such pieces are encoded once and remembered; with any other pre-tokenizer a text is one piece."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        cut = made.get("pre_tokenizer") or {}
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])) for t in made["added_tokens"])
        self.cuts = (cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"] and not made["normalizer"]
                     and plain and not made["truncation"] and not made["padding"])
        self._forget()

    def _forget(self) -> None:
        self.head, self.rest = _Memory(self.tokenizer, ""), _Memory(self.tokenizer, " ")

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One a worker process: reading the vocabulary takes longer than many a task."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.cuts:
            return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        if len(self.rest.numbers) + len(self.head.numbers) > _PIECES:
            self._forget()
        cut = [_pieces(text) for text in texts]
        heads, rest = self.head([c[0] for c in cut]), self.rest(chain.from_iterable(c[1:] for c in cut))
        n = np.array([len(c) for c in cut])
        place = np.cumsum(n) - n
        inner = np.ones(int(n.sum()), bool)
        inner[place] = False
        begin, size = np.empty(len(inner), np.int64), np.empty(len(inner), np.int64)
        # ids of first pieces lie behind those of the others
        for at, memory, found, offset in ((inner, self.rest, rest, 0), (~inner, self.head, heads, len(self.rest.ids))):
            begin[at], size[at] = memory.first[found] + offset, memory.first[found + 1] - memory.first[found]
        ends = np.cumsum(size)
        every = np.repeat(begin - (ends - size), size) + np.arange(int(size.sum()))
        ids = np.concatenate([self.rest.ids, self.head.ids])[every]
        return np.split(ids, ends[place[1:] - 1]) if len(texts) else []


def _pieces(text: str) -> list[str]:
    """The text cut at single spaces between other characters than white space."""
    # a printable text has no white space but spaces
    if text.isprintable() and "  " not in text and text[:1] != " " and text[-1:] != " ":
        return text.split(" ")
    return _SPLIT.split(text)


def _gaps(alphabet: np.ndarray) -> bytes:
    """Differences of rising numbers, 7 bits a byte, the low ones first; the high bit says that more follow."""
    gap = np.diff(alphabet.astype(np.int64), prepend=0)
    more = np.stack([gap >> (7 * k) for k in range(5)], axis=1)
    used = np.maximum((more > 0).sum(axis=1), 1)
    place = np.arange(5)
    return ((more & 127) | ((place < used[:, None] - 1) << 7))[place < used[:, None]].astype(np.uint8).tobytes()


def _rising(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    if not len(raw):
        return raw
    ends = np.flatnonzero(raw < 128)
    begins = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(begins, ends - begins + 1)
    return np.cumsum(np.add.reduceat((raw & 127) << (7 * place), begins))


def pack(first: int, count: int, alphabet: np.ndarray, payload: bytes, parts: np.ndarray) -> bytes:
    gaps = _gaps(alphabet) if len(alphabet) else b""
    body = _HEAD.pack(b"VXT1", count, len(alphabet), len(parts), len(gaps), len(payload), first) + gaps + parts.tobytes() + payload
    return body + struct.pack("<I", zlib.crc32(body))


def unpack(frame: bytes):
    """(first, count, alphabet, payload, parts) of a frame; raises ValueError if it is damaged."""
    if len(frame) < _HEAD.size + 4 or zlib.crc32(frame[:-4]) != struct.unpack("<I", frame[-4:])[0]:
        raise ValueError("block checksum does not match")
    magic, count, size, n, gaps, payload, first = _HEAD.unpack_from(frame)
    at = _HEAD.size
    table = at + gaps + n * _PART.itemsize
    if magic != b"VXT1" or table + payload + 4 != len(frame):
        raise ValueError("not a block of token ids")
    return first, count, _rising(frame[at: at + gaps]), frame[table: table + payload], np.frombuffer(frame[at + gaps: table], _PART)


def _frames(batches: Iterator[pa.RecordBatch], path: str, end: int, block: int, lanes: int):
    """(part, first, n, frame) of the rows (key, text) of a task, in their order."""
    part, encoder = TaskContext.get().partitionId(), Encoder.of(path)
    ids: list[np.ndarray] = []  # waiting documents
    rows: list[tuple[int, int | None, int]] = []
    held = first = number = 0

    def write(whole: np.ndarray, table: list[tuple[int, int | None, int]], first: int):
        begins = np.concatenate([[0], np.cumsum([r[2] for r in table])])
        cuts = [whole[i: i + block] for i in range(0, len(whole), block)]
        frames = []
        for i, (b, (alphabet, payload)) in enumerate(zip(cuts, mixing_coder.encode(cuts))):
            low, high = i * block, i * block + len(b)
            a, z = np.searchsorted(begins, low, side="right") - 1, np.searchsorted(begins, high, side="left")
            parts = np.zeros(z - a, _PART)
            for j, k in enumerate(range(a, z)):
                row, key, _ = table[k]
                parts[j] = (row, 0 if key is None else key, key is None, min(begins[k + 1], high) - max(begins[k], low))
            frames.append(pack(first + low, len(b), alphabet, payload, parts))
        return pa.record_batch([int64(np.full(len(cuts), part)), int64(first + block * np.arange(len(cuts))), int64([len(c) for c in cuts]),
                                pa.array(frames, pa.binary())], ["part", "first", "n", "frame"])

    for batch in batches:
        keys = batch.column(0).to_pylist()
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for key, found in zip(keys, encoder.encode(texts)):
            ids.append(np.append(found, np.uint32(end)))
            rows.append((number, key, len(found) + 1))
            number += 1
            held += len(found) + 1
        while held >= block * lanes:
            whole = np.concatenate(ids)
            size = block * lanes
            begins = np.cumsum([r[2] for r in rows])
            k = int(np.searchsorted(begins, size))  # the document in which these blocks end
            over = int(begins[k]) - size
            row, key, n = rows[k]
            yield write(whole[:size], [*rows[:k], (row, key, n - over)], first)
            ids, rows = [whole[size:]], [(row, key, over)] * (over > 0) + rows[k + 1:]
            first, held = first + size, held - size
    if held:
        yield write(np.concatenate(ids), rows, first)


def _times(a: int, b: int) -> int:
    """Product modulo the CRC-32 polynomial; bit 31 is the constant term."""
    out = 0
    while b:
        if b & 0x80000000:
            out ^= a
        b = b << 1 & 0xFFFFFFFF
        a = a >> 1 ^ (0xEDB88320 if a & 1 else 0)
    return out


def _shifts() -> list[int]:
    """x to the power of 8, 16, 32, ...: what one, two, four, ... further bytes multiply a checksum by."""
    out = [0x80000000 >> 8]
    for _ in range(62):
        out.append(_times(out[-1], out[-1]))
    return out


_SHIFTS = _shifts()


def joined_checksum(crcs, sizes) -> int:
    """CRC-32 of several strings of bytes after one another, from their own."""
    whole = 0
    for crc, size in zip(crcs, sizes):
        k = 0
        while size:
            if whole and size & 1:
                whole = _times(whole, _SHIFTS[k])
            size >>= 1
            k += 1
        whole ^= crc
    return whole


def _documents(batches: Iterator[pa.RecordBatch], lanes: int):
    """Parts of documents: (part, row, key, place in the range, n, checksum) from (part, frame)."""
    def read(waiting: list[tuple[int, bytes]]):
        opened = [unpack(f) for _, f in waiting]
        blocks = mixing_coder.decode([(o[2], o[3]) for o in opened], [o[1] for o in opened])
        out: tuple[list, ...] = ([], [], [], [], [], [])
        for (part, _), (first, _, _, _, table), ids in zip(waiting, opened, blocks):
            raw, low = memoryview(ids.astype("<u4").tobytes()), 0
            for row, key, null, n in table.tolist():
                for column, x in zip(out, (part, row, None if null else key, first + low, n, zlib.crc32(raw[4 * low: 4 * (low + n)]))):
                    column.append(x)
                low += n
        return pa.record_batch([pa.array(c, pa.int64()) for c in out], ["part", "row", "key", "place", "n", "crc"])

    waiting: list[tuple[int, bytes]] = []
    for batch in batches:
        waiting += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        while len(waiting) >= lanes:
            yield read(waiting[:lanes])
            waiting = waiting[lanes:]
    if waiting:
        yield read(waiting)


def write_token_files(documents: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = 0,
                      block: int = mixing_coder.BLOCK, lanes: int = mixing_coder.LANES) -> None:
    """Write the ids of every whole text, ``end`` after each document, in rising order of the key to the folder ``path``.

    ``tokenizer`` is the path of a file of the tokenizers library on the executors. Null texts count as empty, a null key comes
    first, rows of equal key follow one another in the order of their texts; an empty table makes a folder without blocks.
    Other columns are ignored. Documents may be longer than a block.
    """
    spark = documents.sparkSession
    prepare(spark)
    if not 0 < block <= mixing_coder.BLOCK:
        raise ValueError(f"a block holds 1 to {mixing_coder.BLOCK} ids")
    rows = documents.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    ranges = rows.repartitionByRange(shuffle_partitions(spark), "key").sortWithinPartitions("key", "text")
    # frames are coded already
    ranges.mapInArrow(lambda b: _frames(b, tokenizer, end, block, lanes), "part long, first long, n long, frame binary") \
        .write.option("compression", "none").parquet(path)


def read_token_files(documents: DataFrame, lanes: int = mixing_coder.LANES) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) per document of a table of frames, as ``write_token_files`` leaves it.

    ``start`` counts the ids of all documents before it, ``ids_crc32`` is the CRC-32 of its ids as little-endian 32-bit numbers,
    the end id included. Damaged blocks raise an error.
    """
    parts = documents.select("part", "frame").mapInArrow(
        lambda b: _documents(b, lanes), "part long, row long, key long, place long, n long, crc long")
    join = F.udf(lambda pieces: joined_checksum([p["crc"] for p in pieces], [4 * p["n"] for p in pieces]), "long")
    # one row a document and block that it touches
    pieces = F.array_sort(F.collect_list(F.struct("place", "n", "crc")))
    whole = parts.groupBy("part", "row").agg(F.first("key").alias("key"), F.min("place").alias("place"), F.sum("n").alias("n_tokens"),
                                             pieces.alias("pieces")).withColumn("ids_crc32", join("pieces"))
    # one row a range: their number is that of the writing tasks
    sizes = documents.groupBy("part").agg(F.sum("n").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("part", before.alias("base"))
    return whole.join(F.broadcast(bases), "part").select("key", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def coded_tokens(documents: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = 0) -> DataFrame:
    """Write the token files of the documents into the shared folder and describe each document from what is read back."""
    spark = documents.sparkSession
    path = Shelf(spark).path()
    write_token_files(documents, path, tokenizer, key, text, end)
    frames = spark.read.schema("part long, first long, n long, frame binary").parquet(path)
    return read_token_files(frames).withColumnRenamed("key", key)
