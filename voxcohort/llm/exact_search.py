"""Exact nearest neighbours by inner product over integer vectors with a vector-approximation file.

The file holds one byte a component: the number of its cell among up to 64 cells between approximate quantiles. For a block of
queries and a block of cells, two matrix products give a lower and an upper bound of every score. Candidates whose upper bound
is below the k-th lower bound are out. The exact vectors of the others are read in the order of their bounds: first the most
promising, then those that the k-th exact score so far has not ruled out; after that the k-th result is certain.

Equal vectors are searched once. Of the rows that hold one vector only the first k + 1 can be among the k best of any query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxcohort.llm.common import Shelf, int64, prepare

CELLS, QUERY_BLOCK, CELL_BLOCK = 64, 512, 32768


def _matrix(column, kind) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _bounds(left: pa.Table, right: pa.Table, k: int, low: list[np.ndarray], high: list[np.ndarray]) -> pa.Table:
    """Candidates of each query of a block that its bounds leave open."""
    schema = pa.schema([("q", pa.int64()), ("c", pa.int64()), ("lower", pa.int64()), ("upper", pa.int64())])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    queries = _matrix(left["vector"], "<i8").reshape(left.num_rows, -1).astype(float)
    cells = _matrix(right["cells"], np.uint8).reshape(right.num_rows, -1)
    dims = np.arange(cells.shape[1])
    bottom, top = low[dims, cells].astype(float), high[dims, cells].astype(float)
    positive, negative = np.maximum(queries, 0), np.minimum(queries, 0)
    ids, out = np.asarray(right["id"]), []
    for begin in range(0, len(queries), 128):
        p, n = positive[begin: begin + 128], negative[begin: begin + 128]
        lower, upper = p @ bottom.T + n @ top.T, p @ top.T + n @ bottom.T
        least = np.partition(lower, -k, axis=1)[:, -k] if lower.shape[1] >= k else np.full(len(p), -np.inf)
        row, col = np.nonzero(upper >= least[:, None])
        q = np.asarray(left["id"])[begin: begin + 128][row]
        out.append(pa.table([int64(q), int64(ids[col]), int64(lower[row, col]), int64(upper[row, col])], schema=schema))
    return pa.concat_tables(out)


def _file_rows(batches, low: np.ndarray):
    """(id, cells): the number of the cell that holds each component."""
    for batch in batches:
        if batch.num_rows:
            vectors = _matrix(batch.column(1), "<i8").reshape(batch.num_rows, -1)
            cells = np.stack([np.searchsorted(low[d], vectors[:, d], "right") - 1 for d in range(vectors.shape[1])], axis=1).astype(np.uint8)
            yield pa.record_batch([batch.column(0), pa.array([c.tobytes() for c in cells], pa.binary())], ["id", "cells"])


def _packed(batches):
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array([np.array(v, "<i8").tobytes() for v in batch.column(1).to_pylist()], pa.binary())], ["id", "vector"])


def exact_top_k(vectors: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of floor(scale * x) among all other rows.

    Ties go to the smaller key. Rows whose key or vector is null, whose vector is empty or holds null, NaN or an infinity take no
    part, and neither do vectors of which scale * x has a squared length of 2^51 or more: scores of the others are exact in 64 bits and
    their bounds in double precision. Rows that repeat a key count once, with the least of their vectors. Only vectors of equal length are compared.
    """
    spark = vectors.sparkSession
    prepare(spark)
    shelf = Shelf(spark)
    x = F.col(vector)
    fine = (F.col(key).isNotNull() & x.isNotNull() & (F.size(x) > 0)
            & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    length = F.aggregate(F.transform(x, lambda v: F.pow(v.cast("double") * scale, F.lit(2.0))), F.lit(0.0), lambda s, t: s + t)
    rows = (vectors.where(fine).where(length < 2.0 ** 51).select(F.col(key).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("v"))
            .groupBy("id").agg(F.min("v").alias("v")))
    rows = shelf.put(rows)
    first = rows.withColumn("i", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(f"i <= {k + 1}")
    classes = shelf.put(first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("id", F.col("ids")[0]))
    results = None
    for row in classes.select(F.size("v").alias("dims")).distinct().collect():  # lengths of vectors, not vectors
        dims = row["dims"]
        part = classes.where(F.size("v") == dims)
        found = _search(part, rows.where(is_query(F.col("id"))).where(F.size("v") == dims), dims, k, shelf)
        results = found if results is None else results.union(found)
    if results is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return results


def _search(classes: DataFrame, asking: DataFrame, dims: int, k: int, shelf: Shelf) -> DataFrame:
    spark = shelf.spark
    marks = [i / CELLS for i in range(CELLS)]
    low, high = np.zeros((dims, CELLS), np.int64), np.zeros((dims, CELLS), np.int64)
    spread = classes.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(
        F.percentile_approx("x", marks, 1000).alias("marks"), F.min("x").alias("least"), F.max("x").alias("most"))
    for row in spread.collect():  # one row a dimension
        edges = np.unique([row["least"], *row["marks"]])
        low[row["d"], :] = np.iinfo(np.int64).max >> 8
        low[row["d"], : len(edges)] = edges
        high[row["d"], : len(edges)] = [*(edges[1:] - 1), row["most"]]
    packed = shelf.put(classes.select("id", "v").mapInArrow(_packed, "id long, vector binary"))
    file = shelf.put(packed.mapInArrow(lambda b: _file_rows(b, low), "id long, cells binary"))
    wanted = asking.join(classes.select("v", F.col("id").alias("q")), "v").select(F.col("id").alias("query_id"), "q")
    wanted = shelf.put(wanted)
    queries = packed.join(wanted.select(F.col("q").alias("id")).distinct(), "id")
    n_queries, n_cells = queries.count(), file.count()
    query_blocks, cell_blocks = -(-n_queries // QUERY_BLOCK) or 1, -(-n_cells // CELL_BLOCK) or 1
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = queries.withColumn("qb", block(query_blocks)).withColumn("cb", every(cell_blocks)).groupBy("qb", "cb")
    right = file.withColumn("cb", block(cell_blocks)).withColumn("qb", every(query_blocks)).groupBy("qb", "cb")
    open_pairs = shelf.put(left.cogroup(right).applyInArrow(lambda a, b: _bounds(a, b, k + 1, low, high), "q long, c long, lower long, upper long"))

    by = Window.partitionBy("q")
    kth = lambda df, score: (df.withColumn("i", F.row_number().over(by.orderBy(F.desc(score)))).where(f"i <= {k + 1}")
                             .groupBy("q").agg(F.when(F.count("*") > k, F.min(score)).alias("least")))
    left_over = (open_pairs.join(kth(open_pairs, "lower"), "q").where("least is null or upper >= least").drop("least"))
    left_over = shelf.put(left_over.withColumn("i", F.row_number().over(by.orderBy(F.desc("upper"), "c"))))
    exact = classes.select(F.col("id").alias("c"), "v", "ids")
    asked = classes.join(wanted.select(F.col("q").alias("id")).distinct(), "id").select(F.col("id").alias("q"), F.col("v").alias("qv"))

    def read(pairs: DataFrame) -> DataFrame:
        score = F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, t: s + t)
        return pairs.select("q", "c").join(exact, "c").join(asked, "q").select("q", "ids", score.alias("score"))

    sure = shelf.put(read(left_over.where(f"i <= {2 * (k + 1)}")))
    rest = left_over.where(f"i > {2 * (k + 1)}").join(kth(sure, "score"), "q").where("least is null or upper >= least")
    scored = sure.union(read(rest)).select("q", F.explode("ids").alias("vec_id"), "score")
    best = scored.withColumn("i", F.row_number().over(by.orderBy(F.desc("score"), "vec_id"))).where(f"i <= {k + 1}").drop("i")
    answer = wanted.join(best, "q").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answer.withColumn("rank", rank).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
