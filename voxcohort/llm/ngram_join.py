"""Similarity join of documents on word n-grams: Jaccard similarity of at least ``percent`` / 100, and its components.

1. A document is the set of its distinct n-grams, as 64-bit fingerprints. Equal sets are one class, so copies cost one member.
2. N-grams are ordered rarest first. Frequencies come from a count of all n-grams in 2^18 hashed buckets: a fixed size at any
   corpus size, and any order of n-grams gives the same result.
3. Two similar sets share an n-gram among their first n - ceil(t n) + 1 (prefix filter). Prefix n-grams of one class only go.
4. Members of a prefix n-gram are compared with pivots, the smallest members first. Lengths and positions bound the overlap
   before a pair is built, a split at the middle (suffix filter) before it is counted; each pair is verified once.
5. Links make components. An n-gram whose members are all in one component is done; the others go on with 64, 1024, ... more
   pivots until no pair of different components is left. So no group is ever expanded into all its pairs unless none of them
   are linked, and no link between components is lost. A round joins the components of the one before, not documents.

The set of a class is read from a text once, in the first round that compares it; later rounds take what is stored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from voxcohort.llm.common import Ranges, Shelf, U, Words, chunks, int64, lower_ascii, mix, prepare, utf8
from voxcohort.llm.components import components

GRAM, PERCENT, BUCKETS = 5, 80, 18


def gram_sets(texts: list[bytes], gram: int):
    """The sorted distinct n-gram fingerprints of each text."""
    words = Words([lower_ascii(t) for t in texts])
    ranges = Ranges(words.names)
    size = len(words)
    full = ranges.of(np.arange(max(size - gram + 1, 0)), np.arange(gram, size + 1)) if size >= gram else np.zeros(0, U)
    for i in range(len(texts)):
        a, b = int(words.first[i]), int(words.first[i + 1])
        if b - a >= gram:
            yield np.unique(full[a: b - gram + 1])
        elif b > a:
            yield ranges.of(np.array([a]), np.array([b]))
        else:
            yield np.zeros(0, U)


def _class_of(grams: np.ndarray) -> int:
    return int(mix(np.array([mix(grams ^ U(0x9E3779B97F4A7C15)).sum(dtype=U) + U(len(grams))], U)).view(np.int64)[0])


def _describe(batches, gram: int, carry: list[tuple[str, pa.DataType]]):
    """Per document (doc, carried columns, n, cls); at the end of a task also its n-gram counts by bucket."""
    counts = np.zeros(1 << BUCKETS, np.int64)
    names = ["doc", *(c for c, _ in carry), "n", "cls", "bucket", "count"]
    for batch in batches:
        n, cls = [], []
        for _, texts in chunks(utf8(batch.column(1))):
            for grams in gram_sets(texts, gram):
                n.append(len(grams))
                cls.append(_class_of(grams) if len(grams) else None)
                np.add.at(counts, (grams >> U(64 - BUCKETS)).astype(np.int64), 1)
        nothing = pa.nulls(len(n), pa.int64())
        carried = [batch.column(2 + i) for i in range(len(carry))]
        yield pa.record_batch([batch.column(0), *carried, int64(n), pa.array(cls, pa.int64()), nothing, nothing], names)
    used = np.flatnonzero(counts)
    nothing = pa.nulls(len(used), pa.int64())
    yield pa.record_batch([nothing, *(pa.nulls(len(used), kind) for _, kind in carry), nothing, nothing, int64(used), int64(counts[used])], names)


def _prefix_rows(batches, gram: int, percent: int, level: np.ndarray):
    for batch in batches:
        for _, texts in chunks(utf8(batch.column(0))):
            key, cls, n, pos = [], [], [], []
            for grams in gram_sets(texts, gram):
                if not len(grams):
                    continue
                order = np.argsort((level[(grams >> U(64 - BUCKETS)).astype(np.int64)] << U(56)) | (grams >> U(8)), kind="stable")
                size = len(grams) - (percent * len(grams) + 99) // 100 + 1
                key.append(grams[order[:size]])
                cls.append(np.full(size, _class_of(grams)))
                n.append(np.full(size, len(grams)))
                pos.append(np.arange(size))
            if key:
                yield pa.record_batch([int64(np.concatenate(x)) for x in (key, cls, n, pos)], ["key", "cls", "n", "pos"])


def _set_rows(batches, gram: int):
    for batch in batches:
        for _, texts in chunks(utf8(batch.column(0))):
            sets = [s for s in gram_sets(texts, gram) if len(s)]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            values = int64(np.concatenate(sets) if sets else np.zeros(0, U))
            yield pa.record_batch([pa.array([_class_of(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)],
                                  ["node", "grams"])


def _overlap_bound(x: np.ndarray, y: np.ndarray, depth: int) -> int:
    """Most elements that two sorted sets can share, from their sizes left and right of middle elements."""
    if depth == 0 or len(x) < 2 or len(y) < 2:
        return min(len(x), len(y))
    middle = len(y) // 2
    cut = int(np.searchsorted(x, y[middle]))
    return _overlap_bound(x[:cut], y[:middle], depth - 1) + _overlap_bound(x[cut:], y[middle:], depth - 1)


def _links(batches, percent: int):
    for batch in batches:
        keep = []
        for i in range(batch.num_rows):
            x, y = np.asarray(batch.column(2)[i].values).view(U), np.asarray(batch.column(3)[i].values).view(U)
            need = (percent * (len(x) + len(y)) + 99 + percent) // (100 + percent)
            if _overlap_bound(x, y, 3) < need:
                continue
            shared = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * shared >= percent * (len(x) + len(y) - shared):
                keep.append(i)
        keep = pa.array(keep, pa.int64())
        yield pa.record_batch([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])


def _levels(counts: DataFrame) -> np.ndarray:
    """Rarity of each bucket in 200 steps; 2^18 sums whatever the corpus."""
    total = np.zeros(1 << BUCKETS)
    sums = counts.groupBy("bucket").agg(F.sum("count").alias("n")).toArrow()
    total[np.asarray(sums["bucket"])] = np.asarray(sums["n"])
    return np.minimum(np.floor(6 * np.log2(total + 1)), 200).astype(U)


def similar_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", gram: int = GRAM,
                      percent: int = PERCENT, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, n_shingles, class_id, component_id) per row. The columns in ``carry`` come along between key and n_shingles.

    class_id is the least key with the same set, component_id the least key that links lead to. Words are
    ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; fewer than ``gram`` words are one shingle. Null and empty texts have no shingle
    and no link. Rows that repeat a key are one node of the graph; a row without a key has n_shingles and null ids.
    """
    spark = documents.sparkSession
    prepare(spark)
    shelf = Shelf(spark)
    carried = [f"_c{i}" for i in range(len(carry))]
    whole = documents.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"), *(F.col(c).alias(a) for c, a in zip(carry, carried)))
    docs = whole.select("doc", "text")
    kinds = [(a, to_arrow_type(whole.schema[a].dataType)) for a in carried]
    schema = StructType([StructField(a, whole.schema[a].dataType if a in carried else LongType()) for a in ("doc", *carried, "n", "cls", "bucket", "count")])
    seen = shelf.put(whole.mapInArrow(lambda b: _describe(b, gram, kinds), schema))
    level = _levels(seen.where("bucket is not null"))
    rows = seen.where("n is not null")
    classes = shelf.put(rows.where("cls is not null and doc is not null").groupBy("cls").agg(F.min("doc").alias("node")))

    prefixes = shelf.put(docs.where("doc is not null and text is not null").select("text").mapInArrow(
        lambda b: _prefix_rows(b, gram, percent, level), "key long, cls long, n long, pos long"))
    shared = shelf.put(prefixes.groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low <> high").select("key"))
    # before: how many of a set's shared prefix n-grams come earlier; all others before pos are in no other set
    members = shelf.put(prefixes.join(shared.hint("shuffle_hash"), "key").distinct().withColumn(
        "before", F.row_number().over(Window.partitionBy("cls").orderBy("pos")) - 1))
    shelf.drop(prefixes, shared)

    def fetch(nodes: DataFrame) -> DataFrame:
        """The sets of some classes, from the text of one document each (of all its rows, if its key repeats)."""
        wanted = classes.join(nodes.withColumnRenamed("node", "cls"), "cls", "left_semi").select(F.col("node").alias("doc")).distinct()
        # stored, so that the join knows its size: texts are not shuffled for a few documents
        return docs.join(shelf.put(wanted), "doc").select("text").mapInArrow(lambda b: _set_rows(b, gram), "node long, grams array<long>")

    # copies are in one class, linked classes in one component, which is named by its least key
    joined = classes.withColumn("label", F.col("cls"))
    for merged in _linked(members.withColumnRenamed("cls", "node"), fetch, shelf, percent):
        joined = _relabelled(joined, merged)
    joined = shelf.put(joined)
    least = joined.groupBy("label").agg(F.min("node").alias("component"))
    names = joined.join(least, "label").select("cls", "node", "component")
    own = rows.join(names, "cls", "left")
    return own.select(F.col("doc").alias(key), *(F.col(a).alias(c) for c, a in zip(carry, carried)), F.col("n").alias("n_shingles"),
                      *(F.when(F.col("doc").isNotNull(), F.coalesce(x, "doc")).alias(y) for x, y in (("node", "class_id"), ("component", "component_id"))))


def _relabelled(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """Rows with the labels that theirs have become in ``merged`` (node, label)."""
    new = merged.select(F.col("node").alias("label"), F.col("label").alias("new"))
    return rows.join(new, "label", "left").withColumn("label", F.coalesce("new", "label")).drop("new")


def _linked(members: DataFrame, fetch, shelf: Shelf, percent: int) -> list[DataFrame]:
    """What each round makes of the labels before it (node, label); a node is its own label at first, at last linked ones share
    theirs. ``fetch`` reads the sets of nodes."""
    spark = shelf.spark
    rounds: list[DataFrame] = []
    checked = spark.createDataFrame([], "a long, b long")
    stored, sets = members, None
    # In a linked pair the smaller set shares at least 2 t / (1 + t) of itself, so only an early n-gram can find its partners.
    labelled = members.withColumn("label", F.col("node")).withColumn(
        "leads", F.expr(f"{100 + percent} * (before + n - pos) >= {2 * percent} * n"))
    begin, many = 0, 4
    order = Window.partitionBy("key").orderBy("n", "node")
    while True:
        groups = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count_if("leads").alias("leads"))
        open_keys = groups.where(f"low <> high and leads > {begin}").select("key")
        live = shelf.put(labelled.join(open_keys.hint("shuffle_hash"), "key"))
        shelf.drop(stored)
        if live.isEmpty():
            if sets is not None:
                shelf.drop(sets)
            return rounds
        stored = live
        pivots = (live.where("leads").withColumn("rank", F.row_number().over(order)).where(f"rank <= {begin + many}").where(f"rank > {begin}")
                  .select("key", F.col("node").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("before").alias("ba"),
                          F.col("label").alias("la")))
        # length filter, and the positional bound: what both can share before this n-gram, and from it on
        found = (live.join(pivots, "key").where(
            f"label <> la and (na < n or (na = n and a < node)) and 100 * na >= {percent} * n and "
            f"{100 + percent} * (least(ba, before) + least(na - pa, n - pos)) >= {percent} * (na + n)")
            .select("a", F.col("node").alias("b"), "la", F.col("label").alias("lb")).distinct().join(checked, ["a", "b"], "left_anti"))
        found = shelf.put(found)
        labelled, begin, many = live, begin + many, 16 * many
        if found.isEmpty():  # nothing to compare: on to more pivots
            continue
        nodes = found.select(F.col("a").alias("node")).union(found.select("b")).distinct()
        if sets is None:
            sets = shelf.put(fetch(nodes))
        else:
            sets = sets.union(shelf.put(fetch(nodes.join(sets.select("node"), "node", "left_anti"))))
        # a is the smaller set of the two, so it is the one that travels
        held = found.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a").select("b", "la", "lb", "ga")
        both = held.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b").select("la", "lb", "ga", "gb")
        links = shelf.put(both.mapInArrow(lambda b: _links(b, percent), "a long, b long"))
        checked = checked.union(found.select("a", "b"))
        if links.isEmpty():
            continue
        rounds.append(components(links, shelf))
        labelled = _relabelled(live, rounds[-1])
