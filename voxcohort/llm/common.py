"""Shared helpers: session settings, stored intermediate tables, words and fingerprints of whole batches of text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step holds at a time; a longer document is a step of its own.
CHUNK = 1 << 18

U = np.uint64

# Memory that Arrow frees goes back at once; several workers share an executor.
pa.set_memory_pool(pa.system_memory_pool())
np.seterr(over="ignore")  # fingerprints wrap around
_BASE, _INVERSE = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def prepare(spark: SparkSession) -> None:
    """Session setting of the text operators: small Arrow batches, as a row may hold a long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only a local session without that setting gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="voxcohort-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Shelf:
    """Intermediate tables as compressed Parquet in the shared folder, so that lost executors cost nothing.

    Once a table is stored, the shuffle files of the plan behind it are needed no more, so ``put`` lets Spark remove them with the
    end of its job. Otherwise they stay until the driver collects its garbage, maybe half an hour later. The caller's session
    keeps its own setting.
    """

    CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}", []

    def path(self) -> str:
        """A new place for files."""
        self.paths.append(f"{self.root}/{len(self.paths)}")
        return self.paths[-1]

    def put(self, df: DataFrame) -> DataFrame:
        path = self.path()
        before = self.spark.conf.get(self.CLEAN)
        try:
            self.spark.conf.set(self.CLEAN, "true")
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(self.CLEAN, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Free the files of tables that nothing reads any more."""
        for table in tables:
            for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
                self.spark.createDataFrame([], "gone int").write.mode("overwrite").parquet(path)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Powers:
    """Powers of the hash base and of its inverse, extended when a longer step needs them."""

    def __init__(self):
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                size = 1 << int(n).bit_length()
                self.up = np.cumprod(np.concatenate([[U(1)], np.full(size - 1, U(_BASE))]), dtype=U)
                self.down = np.cumprod(np.concatenate([[U(1)], np.full(size - 1, U(_INVERSE))]), dtype=U)
        return self.up, self.down


POWERS = Powers()


class Ranges:
    """Fingerprints of any range of a sequence of 64-bit values, by differences of prefix sums."""

    def __init__(self, values: np.ndarray):
        up, self.down = POWERS.upto(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * up[: len(values)], dtype=U, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of several texts: 64-bit names, text index, and where each text's words begin."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)]) + 1
        inside = ~_SPACE[self.data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, self.end = edges[::2], edges[1::2]
        self.names = Ranges(byte_values(self.data)).of(self.start, self.end)
        self.first = np.searchsorted(self.start, self.offsets)  # first word of each text, and the end
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def at(self, i: int) -> bytes:
        return self.data[self.start[i]: self.end[i]].tobytes()


def chunks(texts: list[bytes], most: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts) in steps of about ``most`` bytes."""
    begin = size = 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text) > most:
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, texts[begin:]


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def lower_ascii(text: bytes) -> bytes:
    return text.lower()  # bytes.lower() changes A-Z alone


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def int64(values) -> pa.Array:
    return pa.array(np.asarray(values).astype(np.int64) if np.asarray(values).dtype != U else np.asarray(values).view(np.int64), pa.int64())
