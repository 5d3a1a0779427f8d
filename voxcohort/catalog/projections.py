"""Projections, filters and joins on voxels."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxcohort.catalog.registry import query, rounded
from voxcohort.functions import geometry, intensity, tensor
from voxcohort.operators import joins, tiles, voxels
from voxcohort.plans import derive as d

XYZ = d.XYZ


def _r(column, digits=6):
    return F.round(column, digits)


def _value_query(name, change, sql):
    @query(name, d.with_ctes(d.VOXELS, f"SELECT image_id, x, y, z, {sql} AS value FROM voxels"))
    def run(t):
        return d.voxels(t).withColumn("value", change(F.col("value")))


_value_query("threshold_above", lambda v: intensity.threshold_above(v, 80.0, -1.0), "CASE WHEN value > 80 THEN -1.0::DOUBLE ELSE value END")
_value_query("threshold_below", lambda v: intensity.threshold_below(v, 30.0), "CASE WHEN value < 30 THEN 0.0::DOUBLE ELSE value END")
_value_query("threshold_outside", lambda v: intensity.threshold_outside(v, 20.0, 90.0, 5.0),
             "CASE WHEN value < 20 OR value > 90 THEN 5.0::DOUBLE ELSE value END")
_value_query("threshold_binary", lambda v: intensity.threshold_binary(v, 20.0, 90.0),
             "CASE WHEN value BETWEEN 20 AND 90 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")
_value_query("create_mask", lambda v: intensity.create_mask(v, 40.0), "CASE WHEN value >= 40 THEN 1 ELSE 0 END")
_value_query("change_values", lambda v: intensity.change_values(v, [1.0, 2.0, 50.0], [2.0, 3.0, 0.0]),
             "CASE WHEN value IN (1, 2) THEN 3.0::DOUBLE WHEN value = 50 THEN 0.0::DOUBLE ELSE value END")


@query("cast_values", "SELECT l_orderkey, l_linenumber, CAST(trunc(l_extendedprice) AS INTEGER) AS as_int, "
       "CAST(trunc(l_quantity) AS INTEGER) AS as_uchar, CAST(trunc(l_extendedprice) AS BIGINT) AS as_long, "
       "CAST(l_linenumber AS DOUBLE) AS as_double FROM lineitem")
def cast_values(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber",
        intensity.cast_values(F.col("l_extendedprice"), "int").alias("as_int"),
        intensity.cast_values(F.col("l_quantity"), "uchar").alias("as_uchar"),
        intensity.cast_values(F.col("l_extendedprice"), "long").alias("as_long"),
        intensity.cast_values(F.col("l_linenumber"), "double").alias("as_double"))


@query("round_values", "SELECT l_orderkey, l_linenumber, round(l_extendedprice) + 0.0 AS value FROM lineitem")
def round_values(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", intensity.round_values(F.col("l_extendedprice")).alias("value"))


MASKED = "FROM voxels LEFT JOIN (SELECT * FROM mask WHERE mask <> 0) m USING (image_id, x, y, z)"


@query("apply_mask", d.with_ctes(d.VOXELS, d.CELLS, d.MASK,
       f"SELECT image_id, x, y, z, CASE WHEN m.mask IS NULL THEN 0.0 ELSE value END AS value {MASKED}"))
def apply_mask(t):
    return voxels.apply_mask(d.voxels(t), d.mask(t))


@query("apply_mask_series", d.with_ctes(d.SERIES, d.CELLS, d.MASK,
       "SELECT image_id, x, y, z, t, CASE WHEN m.mask IS NULL THEN 0.0 ELSE value END AS value FROM series "
       "LEFT JOIN (SELECT * FROM mask WHERE mask <> 0) m USING (image_id, x, y, z)"))
def apply_mask_series(t):
    return voxels.apply_mask(d.series(t), d.mask(t))


@query("abs_then_mask", d.with_ctes(d.VOXELS, d.CELLS, d.MASK,
       f"SELECT image_id, x, y, z, CASE WHEN m.mask IS NULL THEN 0.0 ELSE abs(value - 60) END AS value {MASKED}"))
def abs_then_mask(t):
    return voxels.abs_then_mask(d.voxels(t).withColumn("value", F.col("value") - 60), d.mask(t))


@query("shift_negatives", d.with_ctes(d.VOXELS,
       "SELECT image_id, x, y, z, CASE WHEN lo < 0 AND v <> 0 THEN v - lo ELSE v END AS value FROM "
       "(SELECT *, value - 20 AS v, min(value - 20) OVER (PARTITION BY image_id) AS lo FROM voxels)"))
def shift_negatives(t):
    return voxels.shift_negatives(d.stored(d.voxels(t)).withColumn("value", F.col("value") - 20))


@query("relabel_top", d.with_ctes(d.CELLS, "SELECT image_id, x, y, z, CASE WHEN top = 3 AND label = 3 THEN 4 ELSE label END AS label "
       "FROM (SELECT image_id, x, y, z, CAST(q % (3 + strlen(image_id) % 2) + (CASE WHEN d < 2 THEN 1 ELSE 0 END) AS INTEGER) AS label, "
       "max(CAST(q % (3 + strlen(image_id) % 2) + (CASE WHEN d < 2 THEN 1 ELSE 0 END) AS INTEGER)) OVER (PARTITION BY image_id) AS top FROM cells)"))
def relabel_top(t):
    label = F.col("q") % (3 + F.length("image_id") % 2) + F.when(F.col("d") < 2, 1).otherwise(0)
    return voxels.relabel_top(d.stored(d.cells(t).select(*d.VOXEL, label.cast("int").alias("label"))))


WORLD = ", ".join(
    f"{rounded(f'origin[{i}] + direction[{i}][1] * spacing[1] * x + direction[{i}][2] * spacing[2] * y + direction[{i}][3] * spacing[3] * z')} AS {n}"
    for i, n in ((1, "wx"), (2, "wy"), (3, "wz")))


@query("index_to_world", d.with_ctes(d.VOXELS, d.META, f"SELECT image_id, x, y, z, {WORLD} FROM voxels JOIN meta USING (image_id)"))
def index_to_world(t):
    return voxels.with_world(d.voxels(t), d.image_meta(t)).select(*d.VOXEL, *[_r(F.col(c)).alias(c) for c in ("wx", "wy", "wz")])


@query("world_to_index", d.with_ctes(d.VOXELS, d.META,
       "SELECT image_id, x, y, z, x AS ix, y AS iy, z AS iz FROM voxels JOIN meta USING (image_id)"))
def world_to_index(t):
    # nudging a world point by a tenth of a voxel must not change its nearest index
    meta = d.image_meta(t)
    world = voxels.with_world(d.voxels(t), meta).withColumns({c: F.col(c) + 0.1 for c in ("wx", "wy", "wz")})
    return voxels.with_index(world, meta).select(*d.VOXEL, "ix", "iy", "iz")


@query("affine_points", "SELECT l_orderkey, l_linenumber, CAST(trunc(0.5 * l_quantity - 1.5 * l_linenumber + 3.0) AS BIGINT) AS px, "
       "CAST(trunc(2.0 * l_linenumber - 7.25) AS BIGINT) AS py, "
       "CAST(trunc(-0.25 * l_quantity + 1.0 * (l_suppkey % 50)) AS BIGINT) AS pz FROM lineitem")
def affine_points(t):
    point = [F.col("l_quantity"), F.col("l_linenumber").cast("double"), (F.col("l_suppkey") % 50).cast("double")]
    moved = geometry.affine_points(point, [[0.5, -1.5, 0], [0, 2, 0], [-0.25, 0, 1]], [3, -7.25, 0])
    return t.lineitem.select("l_orderkey", "l_linenumber", *[c.alias(n) for c, n in zip(moved, ("px", "py", "pz"))])


EXTENT = ", ".join(
    f"{rounded(f'abs(direction[{i}][1] * spacing[1] * (size[1]-1) + direction[{i}][2] * spacing[2] * (size[2]-1) + direction[{i}][3] * spacing[3] * (size[3]-1))')} AS {n}"
    for i, n in ((1, "ex"), (2, "ey"), (3, "ez")))


@query("world_extent", d.with_ctes(d.HEADERS, f"SELECT image_id, {EXTENT} FROM headers"))
def world_extent(t):
    c = F.col
    parts = geometry.world_extent(c("size"), c("spacing"), c("origin"), c("direction"))
    return d.headers(t).select("image_id", *[_r(p).alias(n) for p, n in zip(parts, ("ex", "ey", "ez"))])


@query("reorient", d.with_ctes(d.VOXELS, d.META, """SELECT image_id, value,
  CASE k WHEN 0 THEN 11 - x WHEN 1 THEN x ELSE 7 - z END AS x, CASE k WHEN 0 THEN 9 - y WHEN 1 THEN y ELSE 11 - x END AS y,
  CASE k WHEN 2 THEN 9 - y ELSE z END AS z, ['RAI', 'LPI', 'ASR'][k + 1] AS source_code
  FROM (SELECT *, CASE WHEN direction[1][1] = 1 THEN 0 WHEN direction[1][1] = -1 THEN 1 ELSE 2 END AS k
        FROM voxels JOIN meta USING (image_id))"""))
def reorient(t):
    return voxels.reorient(d.voxels(t), d.image_meta(t), "LPI")


@query("reorient_series", d.with_ctes(d.SERIES, d.META, """vec AS (SELECT 'img' || (l_orderkey // 500) AS image_id, CAST(l_linenumber AS BIGINT) AS t, sum(l_quantity) AS a, CAST(count(*) AS DOUBLE) AS b,
  CAST(min(l_partkey) AS DOUBLE) AS c FROM lineitem GROUP BY 1, 2)""", """SELECT image_id, t, value, CASE k WHEN 0 THEN 5 - x WHEN 1 THEN x ELSE 3 - z END AS x, CASE k WHEN 0 THEN 4 - y WHEN 1 THEN y ELSE 5 - x END AS y,
  CASE k WHEN 2 THEN 4 - y ELSE z END AS z, ['RAI', 'LPI', 'ASR'][k + 1] AS source_code,
  CASE k WHEN 0 THEN -a WHEN 1 THEN a ELSE -c END AS vx, CASE k WHEN 0 THEN -b WHEN 1 THEN b ELSE -a END AS vy, CASE k WHEN 2 THEN -b ELSE c END AS vz
  FROM (SELECT *, CASE WHEN direction[1][1] = 1 THEN 0 WHEN direction[1][1] = -1 THEN 1 ELSE 2 END AS k FROM series JOIN meta USING (image_id) LEFT JOIN vec USING (image_id, t))"""))
def reorient_series(t):
    """4-D images turned to another orientation together with the direction vector of each time point."""
    vectors = t.lineitem.groupBy(F.concat(F.lit("img"), F.expr("l_orderkey div 500").cast("string")).alias("image_id"), F.col("l_linenumber").cast("long").alias("t")).agg(
        F.sum("l_quantity").alias("vx"), F.count(F.lit(1)).cast("double").alias("vy"), F.min("l_partkey").cast("double").alias("vz"))
    meta = d.image_meta(t).withColumn("size", F.array(F.lit(6), F.lit(5), F.lit(4)))
    return voxels.reorient_series(d.series(t), vectors, meta, "LPI")


@query("unstack_series", d.with_ctes(d.SERIES, "SELECT image_id, x, y, z, value, image_id || '_' || t AS slice_id FROM series"))
def unstack_series(t):
    return voxels.unstack(d.series(t))


@query("stack_images", d.with_ctes(d.VOXELS, d.META, """SELECT image_id, x, y, z, value, series_id, t FROM voxels JOIN
  (SELECT image_id, CAST(size AS VARCHAR) || CAST(spacing AS VARCHAR) || CAST(origin AS VARCHAR) || CAST(direction AS VARCHAR) AS shape FROM meta) USING (image_id)
  JOIN (SELECT image_id, to_json(size)::VARCHAR || ';' || CAST(spacing[2] AS VARCHAR) || ';' || CAST(origin[1] AS VARCHAR) || ';' || CAST(origin[3] AS VARCHAR) || ';' || CAST(direction[1][1] AS VARCHAR) AS series_id,
        CAST(substr(image_id, 4) AS BIGINT) AS t FROM meta) USING (image_id)"""))
def stack_images(t):
    meta = d.image_meta(t)
    shape = F.concat_ws(";", F.to_json("size"), *[c.cast("string") for c in (
        F.col("spacing")[1], F.col("origin")[0], F.col("origin")[2], F.col("direction")[0][0])])
    order = meta.select("image_id", shape.alias("series_id"), F.substring("image_id", 4, 20).cast("long").alias("t"))
    return voxels.stack(d.voxels(t), order, meta)


@query("nonzero_indices", d.with_ctes(d.CELLS, d.MASK, "SELECT image_id, x, y, z FROM mask WHERE mask <> 0"))
def nonzero_indices(t):
    return voxels.nonzero_indices(d.mask(t), "mask")


@query("values_at", d.with_ctes(d.VOXELS, "SELECT p_partkey AS position, image_id, x, y, z, value FROM part "
       "JOIN voxels ON image_id = 'img' || (p_partkey % (SELECT count(DISTINCT image_id) FROM voxels)) AND x = p_partkey % 12 AND y = p_size % 10 AND z = p_size % 8"))
def values_at(t):
    image = d.voxels(t)
    images = image.select(F.count_distinct("image_id")).first()[0]
    indices = t.part.select(
        F.col("p_partkey").alias("position"), F.concat(F.lit("img"), (F.col("p_partkey") % images).cast("string")).alias("image_id"),
        (F.col("p_partkey") % 12).alias("x"), (F.col("p_size") % 10).cast("long").alias("y"), (F.col("p_size") % 8).cast("long").alias("z"))
    return voxels.values_at(image, indices)


@query("one_hot_labels", d.with_ctes(d.CELLS, d.PAIR, "SELECT image_id, x, y, z, src AS label, "
       + ", ".join(f"CAST(src = {v} AS INTEGER) AS mask_{v}" for v in (0, 1, 2, 4)) + " FROM pair"))
def one_hot_labels(t):
    return voxels.one_hot_labels(d.labelmap(t), [0, 1, 2, 4])


def _crop_sql(isotropic):
    half = {c: (f"greatest(hx-lx, hy-ly, hz-lz)" if isotropic else f"(h{c}-l{c})") for c in XYZ}
    inside = " AND ".join(
        f"{c} >= least(greatest(round((h{c}+l{c})/2.0 - {half[c]}/2.0), 0), size[{i}]) AND "
        f"{c} < least(greatest(round((h{c}+l{c})/2.0 + {half[c]}/2.0), 0), size[{i}])" for i, c in enumerate(XYZ, 1))
    return d.with_ctes(d.VOXELS, d.CELLS, d.MASK, d.META, f"""SELECT image_id, x, y, z, CASE WHEN {inside} THEN value ELSE 0.0 END AS value
      FROM voxels LEFT JOIN (SELECT image_id, {', '.join(f'min({c}) AS l{c}, max({c}) AS h{c}' for c in XYZ)} FROM mask WHERE mask <> 0 GROUP BY 1) USING (image_id)
      LEFT JOIN meta USING (image_id)""")


@query("crop_to_mask", _crop_sql(False))
def crop_to_mask(t):
    return voxels.crop_to_mask(d.voxels(t), d.mask(t), d.image_meta(t))


@query("crop_to_mask_isotropic", _crop_sql(True))
def crop_to_mask_isotropic(t):
    return voxels.crop_to_mask(d.voxels(t), d.mask(t), d.image_meta(t), isotropic=True)


@query("pairwise_distance", f"SELECT l_orderkey, l_linenumber, {rounded('sqrt((l_partkey-l_suppkey)*(l_partkey-l_suppkey) + (l_quantity-l_linenumber)*(l_quantity-l_linenumber) + 1.0)')} AS distance FROM lineitem")
def pairwise_distance(t):
    a = [F.col("l_partkey"), F.col("l_quantity"), F.lit(1)]
    b = [F.col("l_suppkey"), F.col("l_linenumber"), F.lit(2)]
    return t.lineitem.select("l_orderkey", "l_linenumber", _r(geometry.point_distance(a, b)).alias("distance"))


POINTS = ("SELECT o_orderkey AS point_id, 'img' || (o_orderkey // 500) AS image_id, o_custkey % 14 - 1 AS x, "
          "o_orderkey % 12 - 1 AS y, o_custkey % 9 AS z FROM orders")


def _points(t):
    return t.orders.select(
        F.col("o_orderkey").alias("point_id"), F.concat(F.lit("img"), F.expr("o_orderkey div 500").cast("string")).alias("image_id"),
        (F.col("o_custkey") % 14 - 1).alias("x"), (F.col("o_orderkey") % 12 - 1).alias("y"), (F.col("o_custkey") % 9).alias("z"))


@query("points_in_image", d.with_ctes(d.META, f"SELECT point_id, p.image_id, x, y, z FROM ({POINTS}) p JOIN meta USING (image_id) "
       "WHERE x >= 0 AND x < size[1] AND y >= 0 AND y < size[2] AND z >= 0 AND z < size[3]"))
def points_in_image(t):
    return voxels.points_in_image(_points(t), d.image_meta(t))


@query("vote_argmax", d.with_ctes(d.CELLS, d.RATERS, "SELECT image_id, x, y, z, arg_max(label, c * 100 - label) AS label FROM "
       "(SELECT image_id, x, y, z, label, count(*) AS c FROM raters GROUP BY ALL) GROUP BY ALL"))
def vote_argmax(t):
    scores = d.rater_maps(t).groupBy(*d.VOXEL, "label").agg(F.count(F.lit(1)).alias("score"))
    return voxels.vote_argmax(scores)


def _tensor_sql():
    l = ("l0", "l1", "l2")
    m = "((l0+l1+l2)/3)"
    var = f"(({'+'.join(f'({v}-{m})*({v}-{m})' for v in l)})/3)"
    sq = "(l0*l0+l1*l1+l2*l2)"
    ma = "((abs(l0)+abs(l1)+abs(l2))/3)"

    def mom(p):
        up = "+".join(f"pow(abs({v})-{ma},{p})" for v in l)
        return f"(({up})/({'+'.join(f'pow(abs({v}),{p})' for v in l)}))"
    mode = f"CASE WHEN {var} > 0 THEN l0*l1*l2/pow(sqrt(3*{var}),3) ELSE 0 END"
    columns = {
        "trace": "l0+l1+l2", "fa": f"CASE WHEN {sq} > 0 THEN sqrt(1.5*3*{var}/{sq}) ELSE 0 END", "rd": "(l0+l1)/2", "ad": "l2",
        "linear": "CASE WHEN l2>0 THEN (l2-l1)/l2 ELSE 0 END", "planar": "CASE WHEN l2>0 THEN (l1-l0)/l2 ELSE 0 END",
        "spherical": "CASE WHEN l2>0 THEN l0/l2 ELSE 0 END",
        "skewness": f"CASE WHEN {ma} > 0 THEN sign({mom(3)})*pow(abs({mom(3)}),1.0/3) ELSE 0 END",
        "kurtosis": f"CASE WHEN {ma} > 0 THEN pow({mom(4)},0.25) ELSE 0 END",
        "r1": f"sqrt(3*({m}*{m}+{var}))", "r2": f"CASE WHEN {m}*{m}+{var} > 0 THEN sqrt(1.5*{var}/({m}*{m}+{var})) ELSE 0 END",
        "r3": mode, "k1": f"3*{m}", "k2": f"sqrt(3*{var})", "k3": mode}
    return ("SELECT l_orderkey, l_linenumber, " + ", ".join(f"{rounded(e, 5)} AS {n}" for n, e in columns.items())
            + " FROM (SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS DOUBLE) AS l0, l_linenumber + l_quantity / 4.0 AS l1, "
              "l_linenumber + l_quantity / 2.0 + 1.0 AS l2 FROM lineitem)")


@query("tensor_scalars", _tensor_sql())
def tensor_scalars(t):
    low = F.col("l_linenumber").cast("double")
    scalars = tensor.tensor_scalars(low, low + F.col("l_quantity") / 4.0, low + F.col("l_quantity") / 2.0 + 1.0)
    return t.lineitem.select("l_orderkey", "l_linenumber", *[_r(c, 5).alias(n) for n, c in scalars.items()])


@query("mahalanobis", f"""SELECT vec_id, {rounded('a*a*2.0 + 2*a*b*0.5 + 2*a*c*(-0.25) + b*b*1.5 + 2*b*c*0.125 + c*c*3.0')} AS distance FROM
  (SELECT vec_id, features[1] - 0.1 AS a, features[2] + 0.2 AS b, features[3] AS c FROM ({d.with_ctes(d.FEATURES, 'SELECT * FROM features')}))""")
def mahalanobis(t):
    x = geometry.items(F.col("features"))
    mean, packed = [F.lit(v) for v in (0.1, -0.2, 0.0)], [F.lit(v) for v in (2.0, 0.5, -0.25, 1.5, 0.125, 3.0)]
    return d.features(t).select("vec_id", _r(geometry.mahalanobis(x, mean, packed)).alias("distance"))


@query("reorient_vectors", d.with_ctes(d.FEATURES, f"SELECT vec_id, {rounded('-features[2]')} AS vx, {rounded('features[3]')} AS vy, {rounded('-features[1]')} AS vz FROM features"))
def reorient_vectors(t):
    moved = geometry.reorient_vector(geometry.items(F.col("features")), "RAI", "PIL")
    return d.features(t).select("vec_id", *[_r(c).alias(n) for c, n in zip(moved, ("vx", "vy", "vz"))])


def _arithmetic(op, sql, join):
    @query(f"image_{op}", d.with_ctes(d.VOXELS, d.SECOND, f"SELECT image_id, x, y, z, {sql} AS value FROM voxels v {join} JOIN second s USING (image_id, x, y, z)"))
    def run(t):
        return voxels.image_arithmetic(d.voxels(t), d.second_image(t), op, 0.5)


for _op, _sql, _join in (("add", "coalesce(v.value, 0) + coalesce(s.value, 0)", "FULL"), ("subtract", "coalesce(v.value, 0) - coalesce(s.value, 0)", "FULL"),
                         ("multiply", "v.value * s.value", ""), ("add_scaled", "coalesce(v.value, 0) + 0.5 * coalesce(s.value, 0)", "FULL")):
    _arithmetic(_op, _sql, _join)


@query("image_scale", d.with_ctes(d.VOXELS, "SELECT image_id, x, y, z, value * 0.5 AS value FROM voxels"))
def image_scale(t):
    return voxels.image_arithmetic(d.voxels(t), None, "scale", 0.5)


@query("vector_image_add", d.with_ctes(d.FEATURES, f"""SELECT a.vec_id, {rounded('list_sum(list_transform(list_zip(a.features, b.features), lambda p: p[1] + p[2]))')} AS total
  FROM features a JOIN features b ON a.vec_id = b.vec_id"""))
def vector_image_add(t):
    f = d.features(t).select("vec_id", "features")
    added = voxels.image_arithmetic(f, f, "add", on=["vec_id"], value="features", vector=True)
    return added.select("vec_id", _r(F.aggregate("features", F.lit(0.0), lambda a, v: a + v)).alias("total"))


@query("limit_vector_length", d.with_ctes(d.FEATURES, f"""SELECT vec_id, CAST(i - 1 AS INTEGER) AS component, {rounded('features[i] * f')} AS value FROM
  (SELECT *, unnest(range(1, len(features) + 1)) AS i FROM (SELECT *, 0.5 / max(sqrt(list_sum(list_transform(features, lambda v: v * v)))) OVER (PARTITION BY label) AS f FROM features))"""))
def limit_vector_length(t):
    scaled = voxels.limit_vector_length(d.features(t), 0.5, keys=["label"], vector="features")
    return scaled.select("vec_id", F.posexplode("features").alias("component", "value")).withColumn("value", _r(F.col("value")))


# --- joins ------------------------------------------------------------------------------------

@query("align_images", d.with_ctes(d.VOXELS, d.SECOND, "SELECT image_id, x, y, z, v.value AS a, s.value AS b FROM voxels v JOIN second s USING (image_id, x, y, z)"))
def align_images(t):
    return joins.align_images(d.voxels(t), d.second_image(t))


@query("union_labels", d.with_ctes(d.CELLS, d.PAIR, """SELECT image_id, x, y, z, coalesce(a.src, 0) AS src, coalesce(b.tgt, 0) AS tgt
  FROM (SELECT * FROM pair WHERE src <> 0) a FULL JOIN (SELECT * FROM pair WHERE tgt <> 0) b USING (image_id, x, y, z)"""))
def union_labels(t):
    pair = d.label_pair(t)
    return joins.union_labels(pair.where("src <> 0").withColumnRenamed("src", "label"),
                              pair.where("tgt <> 0").withColumnRenamed("tgt", "label"))


@query("with_finished_annotation", d.with_ctes(d.HEADERS, "SELECT 'sub' || c_custkey AS subject_id, c_name FROM customer WHERE 'sub' || c_custkey IN "
       "(SELECT subject_id FROM headers WHERE path LIKE '%\\_final\\_seg.nii.gz' ESCAPE '\\')"))
def with_finished_annotation(t):
    subjects = t.customer.select(F.concat(F.lit("sub"), F.col("c_custkey").cast("string")).alias("subject_id"), "c_name")
    return joins.with_finished_annotation(subjects, d.headers(t))


def _neighbour_sql(condition):
    return d.with_ctes(d.VOXELS, f"""SELECT c.image_id, c.x, c.y, c.z, count(*) AS n, sum(v.value) AS total FROM voxels c JOIN voxels v
      ON c.image_id = v.image_id AND v.x BETWEEN c.x-1 AND c.x+1 AND v.y BETWEEN c.y-1 AND c.y+1 AND v.z BETWEEN c.z-1 AND c.z+1
      WHERE {condition} GROUP BY ALL""")


def _neighbour_totals(t, shape):
    near = joins.neighbours(d.stored(d.voxels(t)), 1, shape)
    return near.groupBy("image_id", *[F.col(f"c_{c}").alias(c) for c in XYZ]).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("neighbours_box", _neighbour_sql("true"))
def neighbours_box(t):
    return _neighbour_totals(t, "box")


@query("neighbours_ball", _neighbour_sql("(c.x-v.x)*(c.x-v.x)+(c.y-v.y)*(c.y-v.y)+(c.z-v.z)*(c.z-v.z) <= 2"))
def neighbours_ball(t):
    return _neighbour_totals(t, "ball")


@query("neighbours_wide", d.with_ctes(d.VOXELS, """SELECT c.image_id, c.x, c.y, c.z, count(*) AS n, sum(v.value) AS total FROM voxels c JOIN voxels v
      ON c.image_id = v.image_id AND v.x BETWEEN c.x-3 AND c.x+3 AND v.y BETWEEN c.y-3 AND c.y+3 AND v.z BETWEEN c.z-3 AND c.z+3 GROUP BY ALL"""))
def neighbours_wide(t):
    """Number and sum of the voxels of a box of radius 3."""
    sums = tiles.box_sums(d.voxels(t), 3, {"n": F.lit(1), "total": F.col("value")}, ["image_id"])
    return sums.withColumn("n", F.col("n").cast("long"))


@query("distance_to_set", d.with_ctes(d.CELLS, d.PAIR, f"""SELECT a.image_id, a.x, a.y, a.z,
  {rounded('sqrt(min((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)))')} AS distance
  FROM (SELECT * FROM pair WHERE src = 2) a JOIN (SELECT * FROM pair WHERE tgt = 4) b ON a.image_id = b.image_id GROUP BY ALL"""))
def distance_to_set(t):
    pair = d.stored(d.label_pair(t))
    found = joins.distance_to_set(pair.where("src = 2"), pair.where("tgt = 4"))
    return found.withColumn("distance", _r(F.col("distance")))
