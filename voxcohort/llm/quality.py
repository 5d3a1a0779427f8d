"""Quality classifier: kernel ridge regression on document statistics by random Fourier features, with isotonic calibration.

Every text becomes a row of statistics (lengths, character classes, repetition, line shapes). Random cosines of the standardised
statistics approximate a Gaussian kernel. Every partition sums its part of the normal equations, Spark adds the parts, and the
driver solves one system of fixed size. A monotone step function, fitted by pooling adjacent violators on labelled rows that the
regression has not seen, turns the ridge score into a probability.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxcohort.llm.common import Shelf, Words, chunks, prepare

FEATURES, RIDGE, BINS, SEED = 256, 1e-3, 512, 7
#: Labelled rows of one partial sum of the normal equations.
ROWS = 20_000

_CLASS = np.zeros(256, np.int64)
for _n, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".", b",", b"!?", b"|", b"#$%&*+<=>@^_~\\/",
                             b"'\"`", b"()[]{}", b";:-", b"\n", b" \t\r\x0b\x0c", bytes(range(128, 256))), 1):
    _CLASS[list(_bytes)] = _n
_CLASSES = 15


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of statistics a text; an empty text has zeros."""
    out = []
    for _, part in chunks(texts):
        words = Words(part)
        length = np.array([len(t) for t in part])
        spans = words.end - words.start
        first = words.first
        owner = np.repeat(np.arange(len(part)), length)
        data = np.frombuffer(b"".join(part), np.uint8)
        shares = np.bincount(owner * _CLASSES + _CLASS[data], minlength=len(part) * _CLASSES).reshape(-1, _CLASSES) / np.maximum(length, 1)[:, None]
        head, tail = _CLASS[words.data[words.start]], _CLASS[words.data[words.end - 1]]
        n = np.diff(first)
        mean = lambda x: np.bincount(words.text, x, len(part)) / np.maximum(n, 1)
        average = mean(spans)
        rows = [np.log1p(length), np.log1p(n), average, np.sqrt(np.maximum(mean(spans ** 2) - average ** 2, 0)), mean(spans == 1), mean(spans > 12),
                mean(head == 1), mean(tail == 4), mean(tail == 5), mean((tail == 8) | (tail == 6)), mean((head == tail) & (head > 2))]
        again = np.zeros(len(words), bool)
        again[1:] = (words.names[1:] == words.names[:-1]) & (words.text[1:] == words.text[:-1])
        rows.append(mean(again))
        distinct, top, lines, lines_again = (np.zeros(len(part)) for _ in range(4))
        for i, text in enumerate(part):
            if n[i]:
                counts = np.unique(words.names[first[i]: first[i + 1]], return_counts=True)[1]
                distinct[i], top[i] = len(counts) / n[i], counts.max() / n[i]
            cut = [x for x in text.split(b"\n") if x.strip()]
            lines[i], lines_again[i] = np.log1p(len(cut)), 1 - len(set(cut)) / max(len(cut), 1)
        out.append(np.column_stack([*rows, distinct, top, lines, lines_again, shares]))
    return np.concatenate(out) if out else np.zeros((0, 0))


class Kernel:
    """Random Fourier features of standardised statistics, with a constant."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int = FEATURES):
        random = np.random.default_rng(SEED)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.weights = random.normal(size=(len(mean), features)) / np.sqrt(len(mean))
        self.phases = random.uniform(0, 2 * np.pi, features)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        x = np.clip((rows - self.mean) / self.deviation, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.phases)) * np.cos(x @ self.weights + self.phases), np.ones((len(x), 1))])


def _sums(batches, kernel: Kernel):
    """(i, j, value): this partition's part of the normal equations; column j = number of features + 1 is the right side."""
    total = None
    for batch in batches:
        z = kernel(np.array(batch.column(0).to_pylist(), float).reshape(batch.num_rows, -1))
        part = z.T @ np.column_stack([z, np.asarray(batch.column(1), float)])
        total = part if total is None else total + part
    if total is not None:
        i, j = np.indices(total.shape)
        yield pa.record_batch([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "value"])


def pool_adjacent(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The nondecreasing sequence closest to ``value`` under ``weight``."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def score_quality(documents: DataFrame, labels: DataFrame, train: Column, calibrate: Column, key: str = "doc_id", text: str = "text",
                  label: str = "quality", into: str = "score") -> DataFrame:
    """All columns of ``documents`` and ``into``: the probability of label 1, from the text alone.

    ``train`` and ``calibrate`` pick labelled rows by the columns of ``documents``. Several labels of a key count as their mean;
    rows without key or label teach nothing. Null text counts as empty. Without any labelled row every score is 0.5. A column that
    is named like ``into`` is replaced.
    """
    spark = documents.sparkSession
    prepare(spark)
    shelf = Shelf(spark)
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.avg(label).alias("_y"))
    use = F.when(train, "train").when(calibrate, "calibrate")
    facts = F.pandas_udf(lambda s: pd.Series(list(statistics([(t or "").encode("utf-8", "surrogatepass") for t in s]))), "array<double>")
    # the statistics are shuffled to the labels, not the texts
    rows = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text"), use.alias("_use")).where("_use is not null and _key is not null")
    taught = shelf.put(rows.select("_key", "_use", facts("_text").alias("x"))).join(known, "_key").select("x", "_y", "_use")
    taught = shelf.put(taught)
    learn = taught.where("_use = 'train'")
    count = learn.count()
    if not count:
        return documents.withColumn(into, F.lit(0.5))
    moments = {r["d"]: r for r in learn.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation")).collect()}  # one row a statistic
    kernel = Kernel(*(np.array([moments[d][name] for d in range(len(moments))]) for name in ("mean", "deviation")))
    parts = learn.select("x", "_y").repartition(-(-count // ROWS)).mapInArrow(lambda b: _sums(b, kernel), "i int, j int, value double")
    size = FEATURES + 1
    system = np.zeros((size, size + 1))
    for r in parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect():  # the size of the system, whatever the corpus
        system[r["i"], r["j"]] = r["value"]
    beta = np.linalg.solve(system[:, :size] + RIDGE * count / FEATURES * np.eye(size), system[:, size])

    ridge = F.pandas_udf(lambda s: pd.Series(kernel(np.stack(s.to_numpy())) @ beta), "double")
    bins = (taught.where("_use = 'calibrate'").select(ridge("x").alias("s"), "_y").groupBy(F.floor(F.col("s") * (BINS / 2)).alias("bin"))
            .agg(F.count("*").alias("n"), F.avg("_y").alias("y"), F.avg("s").alias("s")))
    steps = bins.where(f"bin between {-BINS} and {2 * BINS}").orderBy("bin").collect()  # at most 3 BINS rows
    at, level = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    if steps:
        at, weight = np.array([r["s"] for r in steps]), np.array([r["n"] for r in steps], float)
        level = pool_adjacent(np.array([r["y"] for r in steps], float), weight)

    def final(texts: pd.Series) -> pd.Series:
        s = kernel(statistics([(t or "").encode("utf-8", "surrogatepass") for t in texts])) @ beta if len(texts) else np.zeros(0)
        # the steps, with a slight slope so that equal steps keep the order of the ridge scores
        return pd.Series(np.clip(0.99 * np.interp(s, at, level) + 0.01 * np.clip(s, 0, 1), 0, 1))

    return documents.withColumn(into, F.pandas_udf(final, "double")(F.col(text)))
