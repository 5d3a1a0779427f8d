"""Imaging tables derived from the given star-schema tables, as DataFrames and as the same SQL.

Every 500 orders form one image, so the number of images grows with the data while an image keeps
the bounded size of a scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxcohort.session import settle

XYZ = ["x", "y", "z"]
VOXEL = ["image_id", *XYZ]


def stored(df: DataFrame) -> DataFrame:
    """A derived table written once, for operators that read their input several times."""
    return settle(df)


def _cell() -> list[Column]:
    return [
        F.concat(F.lit("img"), F.expr("l_orderkey div 500").cast("string")).alias("image_id"),
        (F.col("l_partkey") % 12).alias("x"),
        (F.col("l_suppkey") % 10).alias("y"),
        (F.col("l_linenumber") % 8).cast("long").alias("z"),
    ]


_CELL_SQL = ("'img' || (l_orderkey // 500) AS image_id, l_partkey % 12 AS x, l_suppkey % 10 AS y, "
             "CAST(l_linenumber % 8 AS BIGINT) AS z")


def voxels(t) -> DataFrame:
    """One row per image and coordinate; the value is an integral sum and thus exact."""
    return t.lineitem.groupBy(*_cell()).agg(F.sum("l_quantity").alias("value"))


VOXELS = f"voxels AS (SELECT {_CELL_SQL}, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)"


def second_image(t) -> DataFrame:
    """A second image on the same grid, present only where an open line item exists."""
    return t.lineitem.where("l_linestatus = 'O'").groupBy(*_cell()).agg(F.sum("l_quantity").alias("value"))


SECOND = (f"second AS (SELECT {_CELL_SQL}, sum(l_quantity) AS value FROM lineitem "
          "WHERE l_linestatus = 'O' GROUP BY ALL)")


def mask(t) -> DataFrame:
    """A 0/1 mask with ragged border, stored for all cells of the grid that have data."""
    return cells(t).select(*VOXEL, (F.col("d") + F.col("q") % 5 < 24).cast("int").alias("mask"))


MASK = "mask AS (SELECT image_id, x, y, z, CAST(d + q % 5 < 24 AS INTEGER) AS mask FROM cells)"


def cells(t) -> DataFrame:
    """Grid cells with two integer noise sources and the squared distance from the centre."""
    grid = t.lineitem.groupBy(*_cell()).agg(
        F.sum("l_quantity").cast("long").alias("q"), F.sum("l_partkey").alias("k"))
    squared = (F.col("x") - 6) * (F.col("x") - 6) + (F.col("y") - 5) * (F.col("y") - 5) \
        + (F.col("z") - 4) * (F.col("z") - 4)
    return grid.withColumn("d", squared)


CELLS = (f"cells AS (SELECT *, (x-6)*(x-6) + (y-5)*(y-5) + (z-4)*(z-4) AS d FROM (SELECT {_CELL_SQL}, "
         "CAST(sum(l_quantity) AS BIGINT) AS q, CAST(sum(l_partkey) AS BIGINT) AS k FROM lineitem GROUP BY ALL))")


def _nested_label(n: Column) -> Column:
    return F.when(n < 9, 4).when(n < 18, 1).when(n < 32, 2).otherwise(0)


def _nested_label_sql(n: str) -> str:
    return f"CASE WHEN {n} < 9 THEN 4 WHEN {n} < 18 THEN 1 WHEN {n} < 32 THEN 2 ELSE 0 END"


def label_pair(t) -> DataFrame:
    """Two label maps with nested regions on the same grid: columns ``src`` and ``tgt``."""
    return cells(t).select(*VOXEL, _nested_label(F.col("d") + F.col("q") % 5).alias("src"),
                           _nested_label(F.col("d") + F.col("k") % 7).alias("tgt"))


PAIR = (f"pair AS (SELECT image_id, x, y, z, {_nested_label_sql('(d + q % 5)')} AS src, "
        f"{_nested_label_sql('(d + k % 7)')} AS tgt FROM cells)")


def labelmap(t) -> DataFrame:
    return label_pair(t).select(*VOXEL, F.col("src").alias("label"))


def rater_maps(t, raters: int = 5) -> DataFrame:
    """Long table with one label per rater and voxel."""
    r = F.col("r")
    noisy = F.col("d") + (F.col("q") * (r + 2) + F.col("k")) % (r + 5)
    return cells(t).withColumn("r", F.explode(F.array(*[F.lit(i) for i in range(raters)]))).select(
        *VOXEL, F.concat(F.lit("rater"), r.cast("string")).alias("rater"), _nested_label(noisy).alias("label"))


RATERS = ("raters AS (SELECT image_id, x, y, z, 'rater' || r AS rater, "
          + _nested_label_sql("(d + (q * (r + 2) + k) % (r + 5))")
          + " AS label FROM cells, (SELECT unnest([0, 1, 2, 3, 4]) AS r))")


def series(t) -> DataFrame:
    """4-D series: a time axis of at most seven points per coordinate."""
    return t.lineitem.groupBy(
        F.concat(F.lit("img"), F.expr("l_orderkey div 500").cast("string")).alias("image_id"),
        (F.col("l_partkey") % 6).alias("x"), (F.col("l_suppkey") % 5).alias("y"),
        (F.col("l_orderkey") % 4).alias("z"), F.col("l_linenumber").cast("long").alias("t"),
    ).agg(F.sum("l_quantity").alias("value"))


SERIES = ("series AS (SELECT 'img' || (l_orderkey // 500) AS image_id, l_partkey % 6 AS x, l_suppkey % 5 AS y, "
          "l_orderkey % 4 AS z, CAST(l_linenumber AS BIGINT) AS t, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)")


def image_meta(t) -> DataFrame:
    """Geometry of the voxel images: spacing, origin and direction differ between images."""
    k = F.col("k")
    d = lambda *rows: F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in rows])
    grouped = t.orders.groupBy(F.expr("o_orderkey div 500").alias("k")).agg(F.min("o_custkey").alias("c"))
    return grouped.select(
        F.concat(F.lit("img"), k.cast("string")).alias("image_id"),
        F.concat(F.lit("sub"), F.expr("k div 4").cast("string")).alias("subject_id"),
        F.element_at(F.array(*map(F.lit, ["T1", "T1GD", "T2", "FLAIR"])), (k % 4 + 1).cast("int")).alias("modality"),
        F.lit(3).alias("dims"),
        F.array(F.lit(12), F.lit(10), F.lit(8)).alias("size"),
        F.array(F.lit(1.0), 1.0 + (F.col("c") % 3) * 0.5, F.lit(2.0)).alias("spacing"),
        F.array((k % 5).cast("double"), F.lit(-10.0), (F.col("c") % 4) * 0.25).alias("origin"),
        F.when(k % 3 == 0, d((1, 0, 0), (0, 1, 0), (0, 0, 1)))
         .when(k % 3 == 1, d((-1, 0, 0), (0, -1, 0), (0, 0, 1)))
         .otherwise(d((0, 0, 1), (1, 0, 0), (0, -1, 0))).alias("direction"),
    )


META = """meta AS (SELECT 'img' || k AS image_id, 'sub' || (k // 4) AS subject_id,
  ['T1','T1GD','T2','FLAIR'][k % 4 + 1] AS modality, 3 AS dims, [12, 10, 8] AS size,
  [CAST(1.0 AS DOUBLE), 1.0 + (c % 3) * 0.5, 2.0] AS spacing,
  [CAST(k % 5 AS DOUBLE), -10.0, (c % 4) * 0.25] AS origin,
  CASE WHEN k % 3 = 0 THEN [[1.0,0.0,0.0],[0.0,1.0,0.0],[0.0,0.0,1.0]]
       WHEN k % 3 = 1 THEN [[-1.0,0.0,0.0],[0.0,-1.0,0.0],[0.0,0.0,1.0]]
       ELSE [[0.0,0.0,1.0],[1.0,0.0,0.0],[0.0,-1.0,0.0]] END AS direction
  FROM (SELECT o_orderkey // 500 AS k, min(o_custkey) AS c FROM orders GROUP BY 1))"""


def headers(t) -> DataFrame:
    """One image header per order, with a file path below a site and subject folder."""
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    suffix = F.element_at(F.array(*map(F.lit, ["_t1.nii.gz", "_t1ce.nii.gz", "_t2.nii.gz", "_flair.nii.gz",
                                               "_final_seg.nii.gz", ".dcm", ""])), (k % 7 + 1).cast("int"))
    subject = F.concat(F.lit("sub"), c.cast("string"))
    four = k % 5 == 0
    ints = lambda *v: F.array(*[x.cast("int") for x in v])
    size3 = ints(F.lit(240) - c % 2, F.lit(240), F.lit(155) + k % 2)
    spacing3 = F.array(F.lit(1.0), F.lit(1.0), 1.0 + (k % 3) * 0.5)
    origin3 = F.array(F.lit(0.0), F.lit(-239.0), (c % 3).cast("double"))
    return t.orders.select(
        k.alias("image_id"), subject.alias("subject_id"),
        F.concat(F.lit("/data/site"), (c % 7).cast("string"), F.lit("/"), subject, F.lit("/"), subject,
                 F.lit("_"), k.cast("string"), suffix).alias("path"),
        F.when(four, 4).otherwise(3).alias("dims"),
        F.when(four, F.concat(size3, ints(F.lit(20) + k % 3))).otherwise(size3).alias("size"),
        F.when(four, F.concat(spacing3, F.array(F.lit(2.5)))).otherwise(spacing3).alias("spacing"),
        F.when(four, F.concat(origin3, F.array(F.lit(0.0)))).otherwise(origin3).alias("origin"),
        F.array(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)),
                F.array(F.lit(0.0), F.when(k % 11 == 0, -1.0).otherwise(1.0), F.lit(0.0)),
                F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))).alias("direction"),
    )


HEADERS = """headers AS (SELECT o_orderkey AS image_id, 'sub' || o_custkey AS subject_id,
  '/data/site' || (o_custkey % 7) || '/sub' || o_custkey || '/sub' || o_custkey || '_' || o_orderkey
    || ['_t1.nii.gz','_t1ce.nii.gz','_t2.nii.gz','_flair.nii.gz','_final_seg.nii.gz','.dcm',''][o_orderkey % 7 + 1] AS path,
  CASE WHEN o_orderkey % 5 = 0 THEN 4 ELSE 3 END AS dims,
  CASE WHEN o_orderkey % 5 = 0 THEN [240 - o_custkey % 2, 240, 155 + o_orderkey % 2, 20 + o_orderkey % 3]
       ELSE [240 - o_custkey % 2, 240, 155 + o_orderkey % 2] END AS size,
  CASE WHEN o_orderkey % 5 = 0 THEN [CAST(1.0 AS DOUBLE), 1.0, 1.0 + (o_orderkey % 3) * 0.5, 2.5]
       ELSE [CAST(1.0 AS DOUBLE), 1.0, 1.0 + (o_orderkey % 3) * 0.5] END AS spacing,
  CASE WHEN o_orderkey % 5 = 0 THEN [CAST(0.0 AS DOUBLE), -239.0, CAST(o_custkey % 3 AS DOUBLE), 0.0]
       ELSE [CAST(0.0 AS DOUBLE), -239.0, CAST(o_custkey % 3 AS DOUBLE)] END AS origin,
  [[CAST(1.0 AS DOUBLE),0.0,0.0],[0.0,CASE WHEN o_orderkey % 11 = 0 THEN -1.0 ELSE 1.0 END,0.0],[0.0,0.0,1.0]] AS direction
  FROM orders)"""


def features(t) -> DataFrame:
    """Embeddings as feature vectors of doubles."""
    return t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("features"), "label")


FEATURES = ("features AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS features, label FROM embeddings)")


def with_ctes(*parts: str) -> str:
    """``WITH a, b, ... <body>``; the last part is the body."""
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]
