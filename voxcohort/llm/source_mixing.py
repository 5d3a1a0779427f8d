"""Mixing sources to target weights by entropy balancing.

Documents start with equal rates a token. The rates that meet every source's token target and stay closest to that in relative
entropy are exponential tilts, rate = exp(tilt of the source); the tilts minimise a convex dual. Its gradient and curvature are
sums over documents, formed per source in Spark; Newton steps run until every constraint holds. Rates become whole copies
largest documents first, each size correcting what the larger ones left, so that a source misses its target by about half
of its smallest document.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxcohort.llm.common import Shelf, int64, prepare, utf8

WEIGHTS, MOST = (5.0, 2.0, 1.0), 3.0
#: Rows that one task puts in order when copies are dealt out within a source and size.
BUCKET = 1000


def _sizes(batches):
    for batch in batches:
        yield pa.record_batch([batch.column(0), batch.column(1), int64([len(t.split()) for t in utf8(batch.column(2))])], ["doc", "source", "size"])


def _targets(sources: DataFrame, weights: tuple[float, ...], most: float, shelf: Shelf) -> DataFrame:
    """(source, mass, target): shares by weight, held at ``most`` times the source's mass, the excess reshared."""
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row a source
    weight: Column = F.element_at(F.array(*map(F.lit, weights)), (order % len(weights) + 1).cast("int"))
    table = shelf.put(sources.withColumn("weight", weight).withColumn("limit", F.col("mass") * most))
    rate, held = None, 0
    while True:
        full = F.lit(False) if rate is None else F.col("weight") * rate >= F.col("limit")
        row = table.agg(F.sum("mass").alias("all"), F.sum(F.when(full, F.col("limit"))).alias("used"), F.sum(F.when(~full, F.col("weight"))).alias("open"),
                        F.count_if(full).alias("held")).first()
        if rate is not None and row["held"] == held:
            break
        held = row["held"]
        if not row["open"]:
            break
        rate = ((row["all"] or 0) - (row["used"] or 0.0)) / row["open"]
    return table.select("source", "mass", F.least(F.col("weight") * (rate or 0.0), "limit").alias("target"))


def _tilts(targets: DataFrame, shelf: Shelf) -> DataFrame:
    """(source, mass, target, rate) by Newton's method on the dual; a source without mass or target has rate 0."""
    state = shelf.put(targets.withColumn("tilt", F.lit(0.0)))
    moment = F.col("mass") * F.exp("tilt")
    ready = (F.col("mass") > 0) & (F.col("target") > 0)
    for _ in range(100):
        step = (F.col("target") - moment) / moment
        gap = state.where(ready).agg(F.max(F.abs(F.col("target") - moment) / F.col("target")).alias("gap")).first()["gap"]
        if gap is None or gap < 1e-12:
            break
        state, old = shelf.put(state.withColumn("tilt", F.when(ready, F.col("tilt") + F.greatest(step, F.lit(-4.0))).otherwise(F.col("tilt")))), state
        shelf.drop(old)
    return state.select("source", "mass", "target", F.when(ready, F.exp("tilt")).otherwise(0.0).alias("rate"))


def _whole(table: pd.DataFrame, most: int) -> pd.DataFrame:
    """Copies that all documents of one size take together, largest size first; each size corrects what the larger ones left.

    One row a size, so a source has at most as many rows as its longest document has words.
    """
    table = table.sort_values("size", ascending=False, ignore_index=True)
    total, wanted, taken = [], 0.0, 0
    for size, n, rate in zip(table["size"], table["n"], table["rate"]):
        wanted += rate * size * n
        copies = min(max(round((wanted - taken) / size), 0), most * n) if size else 0
        taken += copies * size
        total.append(copies)
    return table.assign(total=total)


def mix_sources(documents: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
                weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(key, source, size, source_size, target, rate, copies) per row.

    Sources in code-point order, null last (a source of its own), weigh ``weights`` in turn and share all words. No target is above
    ``most`` times its source. Null and empty texts have size 0 and no copy. Equal rows are taken one by one. Runs agree.
    """
    spark = documents.sparkSession
    prepare(spark)
    shelf = Shelf(spark)
    kind = documents.schema[key].dataType.simpleString()
    sized = shelf.put(documents.select(F.col(key).alias("doc"), F.col(source).cast("string").alias("source"), F.col(text)).mapInArrow(
        _sizes, f"doc {kind}, source string, size long"))
    groups = shelf.put(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    targets = _targets(groups.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).cast("long").alias("mass")), weights, most, shelf)
    rates = _tilts(targets, shelf)

    joined = groups.alias("g").join(rates.alias("r"), F.col("g.source").eqNullSafe(F.col("r.source"))).select(
        "g.source", "size", "n", "mass", "target", "rate")
    whole = shelf.put(joined.groupBy("source").applyInPandas(
        lambda table: _whole(table, int(most)), "source string, size long, n long, mass long, target double, rate double, total long"))

    # which rows of a source and size take one copy more: the first by hash, counted over buckets of bounded size
    counted = sized.alias("d").join(whole.alias("w"), F.col("d.source").eqNullSafe(F.col("w.source")) & (F.col("d.size") == F.col("w.size"))).select(
        "doc", "d.source", "d.size", "n", "mass", "target", "rate", "total", F.xxhash64("doc").alias("order"))
    counted = counted.withColumn("bucket", F.pmod("order", F.ceil(F.col("n") / BUCKET)))
    buckets = counted.groupBy("source", "size", "bucket").agg(F.count("*").alias("here"))
    within = F.sum("here").over(Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    begin = buckets.select("source", "size", "bucket", F.coalesce(within, F.lit(0)).alias("earlier"))
    place = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("order", "doc"))
    ranked = counted.withColumn("place", place).alias("d").join(begin.alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")) & (
        F.col("d.size") == F.col("b.size")) & (F.col("d.bucket") == F.col("b.bucket"))).select("d.*", "earlier")
    more = (F.col("earlier") + F.col("place") <= F.expr("total % n")).cast("long")
    return ranked.select(F.col("doc").alias(key), "source", "size", F.col("mass").alias("source_size"), "target", "rate",
                         (F.expr("total div n") + more).alias("copies"))


def mixed_rows(documents: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
               weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """The rows that the mix takes, with all their columns and size, source_size, target and copies, which replace columns of those names.

    ``mix_sources`` gives the first rows of a source and size, in the order of its buckets, one copy more than the others. Its result
    is kept as one row a source and size: the copies of all, and the last row that gets one more. Texts meet that table and are
    shuffled only if it is too long to broadcast. Rows that share key, source and size share the number of copies.
    """
    shelf = Shelf(documents.sparkSession)
    order = F.xxhash64("_key")
    mixed = mix_sources(documents.select(F.col(key).alias("_key"), F.col(source).alias("_source"), F.col(text).alias("_text")),
                        "_key", "_source", "_text", weights, most)
    place = F.struct(F.pmod(order, F.ceil(F.col("n") / BUCKET)).alias("bucket"), order.alias("order"), F.col("_key").alias("key"))
    mixed = shelf.put(mixed.select("_key", "source", "size", "source_size", "target", "copies"))
    groups = mixed.groupBy("source", "size").agg(
        F.count("*").alias("n"), F.min("copies").alias("least"), F.max("copies").alias("greatest"),
        F.first("source_size").alias("source_size"), F.first("target").alias("target")).where("greatest > 0")
    same = F.col("m.source").eqNullSafe(F.col("g.source")) & (F.col("m.size") == F.col("g.size"))
    # groups have a row a source and size; only rows above the least number of copies tell where it ends
    lasts = mixed.alias("m").join(groups.alias("g"), same & (F.col("m.copies") > F.col("g.least"))).select(
        "m.source", "m.size", place.alias("place")).groupBy("source", "size").agg(F.max("place").alias("last"))
    same = F.col("g.source").eqNullSafe(F.col("l.source")) & (F.col("g.size") == F.col("l.size"))
    table = shelf.put(groups.alias("g").join(lasts.alias("l"), same, "left").select(
        F.col("g.source").alias("_source"), F.col("g.size").alias("_size"), "n", "least", "source_size", "target", "last"))
    shelf.drop(mixed)

    words = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    own = documents.drop("size", "source_size", "target", "copies")
    asked = own.select(F.struct(*(F.col(f"`{c}`") for c in own.columns)).alias("_row"), F.col(key).alias("_key"),
                       F.col(source).cast("string").alias("_from"), words.alias("_words"))
    joined = asked.join(table, F.col("_from").eqNullSafe(F.col("_source")) & (F.col("_words") == F.col("_size")))
    copies = F.col("least") + F.coalesce(place <= F.col("last"), F.lit(False)).cast("long")
    return joined.select("_row.*", F.col("_size").alias("size"), "source_size", "target", copies.alias("copies")).where("copies > 0")
