"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word is the sum of two embeddings, chosen by hashes of the whole word and of its first bytes. Filters of widths 1, 2 and 3 slide over the words; each
filter's largest answer in the text feeds a logistic unit. Training takes a bounded sample of labelled rows (``most`` a class,
by hash of the key); scores are corrected to the classes' true shares. Scoring runs in Spark over every whole text. Thresholds are
calibrated per language on labelled rows that training has not seen; the language is no input of a score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxcohort.llm.common import Ranges, Shelf, byte_values, chunks, prepare

HASHES, PREFIX, DIM, WIDTHS, FILTERS, EPOCHS, BATCH = (1 << 18, 1 << 16), 6, 8, (1, 2, 3), 8, 8, 32
#: A small sample is gone through more often, until so many batches are done.
STEPS = 2000
#: Labelled rows of either class that the network is trained on, at most.
MOST = 6000
#: Words of fewer sampled rows have no embedding.
LEAST = 4
BINS = 400
_LETTER = np.zeros(256, bool)
_LETTER[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_LETTER[128:] = True


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(codes of the runs of letters, A-Z lowered, of the word above 24 bits of its beginning; how many each text has)."""
    data = np.frombuffer(b" ".join([b"", *(t.lower() for t in texts), b""]), np.uint8)
    inside = _LETTER[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]) + 1
    ranges = Ranges(byte_values(data))
    codes = (ranges.of(start, end) & ~np.uint64(0xFFFFFF)) | (ranges.of(start, np.minimum(end, start + PREFIX)) >> np.uint64(40))
    return codes, np.diff(np.searchsorted(start, offsets))


class Network:
    def __init__(self, seed: int = 11):
        random = np.random.default_rng(seed)
        # small, so that a word says nothing until training says otherwise
        self.tables = [random.normal(0, 0.02, (size, DIM)).astype(np.float32) for size in HASHES]
        self.known = np.zeros(1 << 22, bool)
        self.filters = [random.normal(0, 0.4, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = random.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.base = np.float32(0)
        self.shift = 0.0

    def embed(self, codes: np.ndarray) -> np.ndarray:
        word, begin = self.slots(codes)
        x = self.tables[0][word]
        x[~self.known[(codes >> np.uint64(42)).astype(np.int64)]] = 0
        return x + self.tables[1][begin]

    @staticmethod
    def slots(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the two tables."""
        return (codes >> np.uint64(24)).astype(np.int64) % HASHES[0], codes.astype(np.int64) % HASHES[1]

    def pooled(self, x: np.ndarray, ends: np.ndarray, places: bool = False):
        """Largest answer of every filter in each text (0 if it has no place), and the place if asked."""
        starts = np.concatenate([[0], ends[:-1]])
        best, where = [], []
        for width, filters, bias in zip(WIDTHS, self.filters, self.bias):
            n = len(x) - width + 1
            answer = sum((x[k: n + k] @ filters[k] for k in range(width)), np.zeros((max(n, 0), FILTERS), np.float32)) if n > 0 else np.zeros((0, FILTERS), np.float32)
            top = np.zeros((len(ends), FILTERS), np.float32)
            at = np.full((len(ends), FILTERS), -1)
            room = ends - starts >= width
            low, high = starts[room], ends[room] - width + 1
            if len(low):
                if places:
                    found = np.stack([answer[a:b].argmax(axis=0) + a for a, b in zip(low, high)])
                    at[room], top[room] = found, answer[found, np.arange(FILTERS)] + bias
                else:
                    cuts = np.column_stack([low, high]).ravel()
                    padded = np.vstack([answer, np.full((1, FILTERS), -np.inf, np.float32)])
                    top[room] = np.maximum.reduceat(padded, cuts, axis=0)[::2] + bias
            best.append(np.maximum(top, 0))
            where.append(at)
        return (np.hstack(best), where) if places else np.hstack(best)

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = []
        for _, part in chunks(texts):
            codes, counts = word_codes(part)
            out.append(self.pooled(self.embed(codes), np.cumsum(counts)) @ self.out + self.base)
        logit = np.concatenate(out).astype(float) + self.shift if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def train(self, codes: list[np.ndarray], labels: np.ndarray, seed: int = 5) -> None:
        """Adagrad on single batches; only the place of each filter's largest answer is corrected."""
        random = np.random.default_rng(seed)
        seen, often = np.unique(np.concatenate([np.unique(c >> np.uint64(42)) for c in codes]), return_counts=True)
        self.known[seen[often >= LEAST].astype(np.int64)] = True
        weight = np.where(labels > 0, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9)).astype(np.float32)
        table_squares = [np.full_like(t, 1e-2) for t in self.tables]
        squares = [*(np.full_like(f, 1e-2) for f in self.filters), *(np.full_like(b, 1e-2) for b in self.bias)]
        out_square, base_square = np.full_like(self.out, 1e-2), np.float32(1e-2)
        n = len(WIDTHS)
        epochs = max(EPOCHS, -(-STEPS * BATCH // len(codes)))
        for epoch in range(epochs):
            order, rate = random.permutation(len(codes)), 0.15 / (1 + 4 * epoch / epochs)
            for begin in range(0, len(order), BATCH):
                chosen = order[begin: begin + BATCH]
                ends = np.cumsum([len(codes[i]) for i in chosen])
                flat = np.concatenate([codes[i] for i in chosen])
                x = self.embed(flat)
                top, where = self.pooled(x, ends, places=True)
                error = (1 / (1 + np.exp(-np.clip(top @ self.out + self.base, -30, 30))) - labels[chosen]).astype(np.float32) * weight[chosen] / len(chosen)
                back = error[:, None] * self.out * (top > 0)
                step = error @ top
                out_square += step ** 2
                self.out -= rate * step / np.sqrt(out_square)
                base_square += error.sum() ** 2
                self.base -= np.float32(rate * error.sum() / np.sqrt(base_square))
                words, moves = [], []
                for f, width in enumerate(WIDTHS):
                    part = back[:, f * FILTERS: (f + 1) * FILTERS]
                    doc, filt = np.nonzero((part != 0) & (where[f] >= 0))
                    g, at = part[doc, filt], where[f][doc, filt]
                    for k in range(width):
                        grad = np.zeros((FILTERS, DIM), np.float32)
                        np.add.at(grad, filt, g[:, None] * x[at + k])
                        words.append(flat[at + k])
                        moves.append(g[:, None] * self.filters[f][k].T[filt])
                        squares[f][k] += grad.T ** 2
                        self.filters[f][k] -= rate * grad.T / np.sqrt(squares[f][k])
                    grad = np.bincount(filt, g, FILTERS).astype(np.float32)
                    squares[n + f] += grad ** 2
                    self.bias[f] -= rate * grad / np.sqrt(squares[n + f])
                words, moves = np.concatenate(words), np.concatenate(moves)
                for table, square, slot in zip(self.tables, table_squares, self.slots(words)):
                    rows, inverse = np.unique(slot, return_inverse=True)
                    grad = np.zeros((len(rows), DIM), np.float32)
                    np.add.at(grad, inverse, moves)
                    square[rows] += grad ** 2
                    table[rows] -= rate * grad / np.sqrt(square[rows])


def _bytes(texts: pd.Series) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def fit_network(documents: DataFrame, labels: DataFrame, train: Column, key: str = "doc_id", text: str = "text", label: str = "toxic",
                most: int = MOST) -> Network:
    """The trained network, from ``most`` labelled keys of either class at most, those of least hash.

    ``train`` picks labelled rows by their key. Without both classes the network stays untrained and scores the same for every text.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias("_y")).where(train)
    share = known.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("_y") > 0).cast("long")), F.lit(0)).alias("ones")).first()
    network = Network()
    if not 0 < share["ones"] < share["n"]:
        network.out[:] = 0
        return network
    coded = F.pandas_udf(lambda s: pd.Series([x for t in _bytes(s) for x in [word_codes([t])[0].view(np.int64)]]), "array<long>")
    part = lambda one: known.where(F.col("_y") > 0 if one else F.col("_y") <= 0).orderBy(F.xxhash64(key), key).limit(most)
    sample = part(True).union(part(False)).withColumnRenamed(key, "_key")
    # the sample has at most 2 * most keys, so it can be sent to the documents
    rows = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(sample), "_key")
    taken = rows.select(coded("_text").alias("codes"), (F.col("_y") > 0).cast("int").alias("y"), "_key").toArrow().sort_by([("_key", "ascending")])
    if not 0 < sum(taken["y"].to_pylist()) < taken.num_rows:
        network.out[:] = 0
        return network
    codes = [np.asarray(row.values).view(np.uint64) for chunk in taken["codes"].chunks for row in chunk]
    y = np.asarray(taken["y"]).astype(np.float32)
    network.train(codes, y)
    ones = share["ones"] / share["n"]
    network.shift = float(np.log(ones / (1 - ones)))  # training weighs both classes alike
    return network


def score_toxicity(documents: DataFrame, network: Network, text: str = "text", into: str = "score") -> DataFrame:
    """All columns of ``documents`` and ``into``: the probability of label 1. Null text counts as empty."""
    prepare(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast(network)  # 15 MB, whatever the corpus
    return documents.withColumn(into, F.pandas_udf(lambda s: pd.Series(held.value.score(_bytes(s))), "double")(F.col(text)))


def language_thresholds(scored: DataFrame, labels: DataFrame, calibrate: Column, key: str = "doc_id", lang: str = "lang", label: str = "toxic",
                        score: str = "score") -> DataFrame:
    """(lang, threshold): the score that gives the best F1 on the labelled rows of a language; null is a language of its own."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg((F.max(label) > 0).cast("long").alias("_y"))
    rows = scored.where(calibrate).select(F.col(key).alias("_key"), F.col(lang).alias("lang"), F.floor(F.col(score) * BINS).alias("bin")).join(known, "_key")
    bins = rows.groupBy("lang", "bin").agg(F.count("*").alias("n"), F.sum("_y").alias("ones"))  # at most BINS rows a language
    above = Window.partitionBy("lang").orderBy(F.desc("bin"))
    f1 = 2 * F.sum("ones").over(above) / (F.sum("n").over(above) + F.sum("ones").over(Window.partitionBy("lang")))
    return bins.withColumn("f1", f1).groupBy("lang").agg((F.max_by("bin", F.struct("f1", "bin")) / BINS).alias("threshold"))


def flag_toxic(documents: DataFrame, labels: DataFrame, train: Column, calibrate: Column, key: str = "doc_id", text: str = "text",
               lang: str = "lang", label: str = "toxic") -> DataFrame:
    """All columns of ``documents`` with score, threshold (0.5 for a language without labelled rows) and flagged."""
    network = fit_network(documents, labels, train, key, text, label)
    scored = Shelf(documents.sparkSession).put(score_toxicity(documents, network, text).select(key, lang, "score"))
    limits = language_thresholds(scored, labels, calibrate, key, lang, label)
    joined = scored.join(limits.withColumnRenamed("lang", "_lang"), F.col(lang).eqNullSafe(F.col("_lang")), "left").drop("_lang")
    threshold = F.coalesce("threshold", F.lit(0.5))
    return joined.withColumn("threshold", threshold).withColumn("flagged", F.col("score") >= threshold)
