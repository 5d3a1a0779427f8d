"""Joins between images: aligned voxels, unions, neighbourhoods and nearest distances."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from voxcohort.operators import tiles
from voxcohort.operators.envelope import line_minima, pair_minima
from voxcohort.session import fits_broadcast, join_summary, settle

IMAGE = ["image_id"]
XYZ = ["x", "y", "z"]

#: A group is compared pair by pair up to this many points and targets; larger ones are searched along scan lines.
DIRECT_ROWS = 4096


def align_images(a: DataFrame, b: DataFrame, on: Sequence[str] = (*IMAGE, *XYZ), value: str = "value",
                 names: Sequence[str] = ("a", "b")) -> DataFrame:
    """Pair two images voxel by voxel."""
    left = a.select(*on, F.col(value).alias(names[0]))
    return left.join(b.select(*on, F.col(value).alias(names[1])), list(on))


def union_labels(a: DataFrame, b: DataFrame, on: Sequence[str] = (*IMAGE, *XYZ), label: str = "label",
                 names: Sequence[str] = ("src", "tgt")) -> DataFrame:
    """Pair two sparse label maps; a voxel that one of them lacks has label 0 there."""
    left = a.select(*on, F.col(label).alias(names[0]))
    joined = left.join(b.select(*on, F.col(label).alias(names[1])), list(on), "full")
    return joined.fillna(0, subset=list(names))


def with_finished_annotation(subjects: DataFrame, files: DataFrame, suffix: str = "_final_seg.nii.gz",
                             key: str = "subject_id", path: str = "path") -> DataFrame:
    return subjects.join(files.where(F.col(path).endswith(suffix)), key, "left_semi")


def offsets(radius: int | Sequence[int], shape: str = "box", include_centre: bool = True) -> list[tuple[int, ...]]:
    """Neighbour offsets of a box, a ball (distance within radius + 1/2), or the face neighbours ("cross")."""
    r = [radius] * 3 if isinstance(radius, int) else list(radius)
    chosen = []
    for o in itertools.product(*[range(-v, v + 1) for v in r]):
        inside = {"box": True, "cross": sum(map(abs, o)) <= max(r),
                  "ball": sum((v / (q + 0.5)) ** 2 for v, q in zip(o, r)) <= 1.0}[shape]
        if inside and (include_centre or any(o)):
            chosen.append(o)
    return chosen


def neighbours(image: DataFrame, radius: int | Sequence[int], shape: str = "box", keys: Sequence[str] = IMAGE,
               value: str = "value", include_centre: bool = True) -> DataFrame:
    """Each voxel (c_x, c_y, c_z, centre) with the existing voxels around it (x, y, z, value); found tile by tile."""
    reach = radius if isinstance(radius, int) else max(radius)
    return tiles.pairs(image, reach, offsets(radius, shape, include_centre), keys, value)


def nearest_squared(points: DataFrame, targets: DataFrame, keys: Sequence[str] = IMAGE,
                    spacing: DataFrame | None = None, direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """Exact squared Euclidean distance (``d2``) from every point to the nearest target of its group.

    Groups of at most ``direct_rows`` points and targets are compared pair by pair, one row a group, so that few voxels in a wide image
    stay few rows; larger ones are searched along scan lines. Points of a group without targets are not returned. ``spacing``
    optionally has one ``spacing`` array per group.
    """
    keys = list(keys)
    points, targets = points.select(*keys, *XYZ), targets.select(*keys, *XYZ)
    longs = [F.col(c).cast("long").alias(c) for c in XYZ]
    both = points.select(*keys, *longs, F.lit(True).alias("_p")).unionByName(targets.select(*keys, *longs, F.lit(False).alias("_p")))
    # only the names of the large groups are stored, of which there are few for their rows
    large = settle(both.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > direct_rows).select(*keys))
    if large.isEmpty():
        return _nearest_direct(both, points, keys, spacing)
    small = fits_broadcast(large)
    only = lambda df, how: join_summary(df, large, keys, how, small)
    found = _nearest_by_lines(only(points, "left_semi"), only(targets, "left_semi"), keys, spacing)
    return found.unionByName(_nearest_direct(only(both, "left_anti"), points, keys, spacing))


def _nearest_direct(both: DataFrame, points: DataFrame, keys: list[str], spacing: DataFrame | None) -> DataFrame:
    """``nearest_squared`` of small groups, given as points and targets in one table (column _p)."""
    place = F.struct(*XYZ)
    groups = both.groupBy(*keys).agg(F.collect_list(F.when(F.col("_p"), place)).alias("points"), F.collect_list(F.when(~F.col("_p"), place)).alias("targets"))
    groups = groups.where((F.size("points") > 0) & (F.size("targets") > 0))
    weights = [F.lit(1.0).alias(f"_u{i}") for i in range(3)]
    if spacing is not None:
        weights = [(F.col("spacing")[i] * F.col("spacing")[i]).cast("double").alias(f"_u{i}") for i in range(3)]
        groups = groups.join(spacing.select(*keys, "spacing"), keys)
    groups = groups.select(*keys, "points", "targets", *weights)
    out = StructType([*[both.schema[k] for k in keys], StructField("_e", ArrayType(StructType([*[StructField(c, LongType()) for c in XYZ], StructField("d2", DoubleType())])))])
    found = groups.mapInArrow(lambda b: pair_minima(b, keys), out).select(*keys, F.explode("_e").alias("_e"))
    kinds = {f.name: f.dataType for f in points.schema.fields}
    return found.select(*keys, *[F.col(f"_e.{c}").cast(kinds[c]).alias(c) for c in XYZ], F.col("_e.d2").alias("d2"))


def _nearest_by_lines(points: DataFrame, targets: DataFrame, keys: list[str], spacing: DataFrame | None) -> DataFrame:
    """``nearest_squared`` along scan lines.

    The minimum is taken along z, then y, then x. Each time a scan line of an image is one row: the targets or minima that it holds,
    and the places that are asked for; ``envelope`` finds all minima of a line in time linear in both, so the work grows with
    the voxels between targets and points, not with their number times the length of an axis. A line has at most as many entries as an image
    is long; nothing is compared all-against-all.
    """
    # the planes and rows at which there are points; a number per group stands for its keys on the way
    bounds = points.groupBy(*keys).agg(F.collect_set("y").alias("_ys"), F.collect_set("z").alias("_zs"))
    weights = [F.lit(1.0).alias(f"_u{i}") for i in range(3)]
    if spacing is not None:
        weights = [(F.col("spacing")[i] * F.col("spacing")[i]).cast("double").alias(f"_u{i}") for i in range(3)]
        bounds = bounds.join(spacing.select(*keys, "spacing"), keys)
    bounds = settle(bounds.select(*keys, "_ys", "_zs", *weights, F.monotonically_increasing_id().alias("_g")))
    small = fits_broadcast(bounds)
    numbered = lambda df: join_summary(df.select(*keys, *XYZ), bounds.select(*keys, "_g"), keys, "inner", small).drop(*keys)

    def along(rows: DataFrame, axis: str, line: list[str], asked: DataFrame | None, weight: str) -> DataFrame:
        """Minima along an axis: rows (_g, x, y, z, g) become such rows at the places that are asked for."""
        lines = rows.groupBy("_g", *line).agg(F.collect_list(F.struct(F.col(axis).alias("at"), F.col("g").alias("cost"))).alias("sources"))
        if asked is None:  # the same places for all lines of a group
            lines = join_summary(lines, bounds.select("_g", F.col(f"_{axis}s").alias("asked"), F.col(weight).alias("weight")), ["_g"], "inner", small)
        else:
            lines = join_summary(lines.join(asked, ["_g", *line]), bounds.select("_g", F.col(weight).alias("weight")), ["_g"], "inner", small)
        kinds = ", ".join(f"{c} long" for c in ("_g", *line))
        found = lines.mapInArrow(lambda b: line_minima(b, ["_g", *line]), f"{kinds}, asked array<long>, minima array<double>")
        return found.select("_g", *line, F.explode(F.arrays_zip("asked", "minima")).alias("_e")).select(
            "_g", *line, F.col("_e.asked").alias(axis), F.col("_e.minima").alias("g"))

    longs = lambda df: df.select("_g", *[F.col(c).cast("long").alias(c) for c in XYZ])
    columns = along(longs(numbered(targets)).withColumn("g", F.lit(0.0)), "z", ["x", "y"], None, "_u2")
    rows = along(columns, "y", ["x", "z"], None, "_u1")
    wanted = longs(numbered(points)).groupBy("_g", "y", "z").agg(F.collect_set("x").alias("asked"))
    found = along(rows, "x", ["y", "z"], wanted, "_u0")
    kinds = {f.name: f.dataType for f in points.schema.fields}
    return join_summary(found, bounds.select("_g", *keys), ["_g"], "inner", small).select(
        *keys, *[F.col(c).cast(kinds[c]).alias(c) for c in XYZ], F.col("g").alias("d2"))


def distance_to_set(points: DataFrame, targets: DataFrame, keys: Sequence[str] = IMAGE,
                    spacing: DataFrame | None = None) -> DataFrame:
    """Minimum Euclidean distance from each point to a set of targets of the same group."""
    found = nearest_squared(points, targets, keys, spacing)
    return found.select(*keys, *XYZ, F.sqrt("d2").alias("distance"))
