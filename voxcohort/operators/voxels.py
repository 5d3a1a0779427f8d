"""Operators on voxel tables: masks, crops, stacks, coordinates and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxcohort.functions import geometry
from voxcohort.functions.intensity import vote_key
from voxcohort.session import attach

IMAGE = ["image_id"]
XYZ = ["x", "y", "z"]


def apply_mask(image: DataFrame, mask: DataFrame, on: Sequence[str] = (*IMAGE, *XYZ), value: str = "value",
               mask_value: str = "mask") -> DataFrame:
    """Voxels outside the mask become 0. A mask without time axis covers every time point."""
    marks = mask.where(F.col(mask_value) != 0).select(*on, F.lit(True).alias("_inside"))
    joined = image.join(marks, list(on), "left")
    return joined.withColumn(value, F.when(F.col("_inside"), F.col(value)).otherwise(F.lit(0.0))).drop("_inside")


def abs_then_mask(image: DataFrame, mask: DataFrame, on: Sequence[str] = (*IMAGE, *XYZ), value: str = "value",
                  mask_value: str = "mask") -> DataFrame:
    return apply_mask(image.withColumn(value, F.abs(value)), mask, on, value, mask_value)


def shift_negatives(image: DataFrame, keys: Sequence[str] = IMAGE, value: str = "value") -> DataFrame:
    """Lift the non-zero voxels of every image that has a negative value by its minimum."""
    low = image.groupBy(*keys).agg(F.min(value).alias("_min"))
    joined = attach(image, low, list(keys))
    lifted = F.when((F.col("_min") < 0) & (F.col(value) != 0), F.col(value) - F.col("_min")).otherwise(F.col(value))
    return joined.withColumn(value, lifted).drop("_min")


def relabel_top(labelmap: DataFrame, source: int = 3, target: int = 4, keys: Sequence[str] = IMAGE,
                label: str = "label") -> DataFrame:
    """Recode ``source`` as ``target`` where ``source`` is the largest label of the map."""
    top = labelmap.groupBy(*keys).agg(F.max(label).alias("_top"))
    joined = attach(labelmap, top, list(keys))
    recoded = F.when((F.col("_top") == source) & (F.col(label) == source), F.lit(target)).otherwise(F.col(label))
    return joined.withColumn(label, recoded).drop("_top")


def with_world(points: DataFrame, meta: DataFrame, index: Sequence[str] = XYZ) -> DataFrame:
    """Add world coordinates wx, wy, wz to voxel indices."""
    joined = attach(points, meta.select("image_id", "spacing", "origin", "direction"), IMAGE)
    world = geometry.index_to_world([F.col(c) for c in index], F.col("spacing"), F.col("origin"), F.col("direction"))
    return joined.withColumns(dict(zip(("wx", "wy", "wz"), world))).drop("spacing", "origin", "direction")


def with_index(points: DataFrame, meta: DataFrame, world: Sequence[str] = ("wx", "wy", "wz")) -> DataFrame:
    """Add the nearest voxel indices ix, iy, iz to world points."""
    joined = attach(points, meta.select("image_id", "spacing", "origin", "direction"), IMAGE)
    index = geometry.world_to_index([F.col(c) for c in world], F.col("spacing"), F.col("origin"), F.col("direction"))
    return joined.withColumns(dict(zip(("ix", "iy", "iz"), index))).drop("spacing", "origin", "direction")


def _turned(columns: Sequence[Column], target: str, flipped) -> list[Column]:
    """The columns of the axes x, y, z in the orientation ``target``; ``flipped(axis, column)`` gives one that runs the other way.

    The transform depends only on the code the image has (column source_code), so it is looked up in one small
    expression per possible letter.
    """
    moved = []
    for axis, sign in geometry.parse_orientation(target):
        letters = [c for c, (a, _) in geometry.AXIS_OF_LETTER.items() if a == axis]
        expression = None
        for position in range(3):
            for letter in letters:
                same = geometry.AXIS_OF_LETTER[letter][1] == sign
                result = columns[position] if same else flipped(position, columns[position])
                matches = F.substring("source_code", position + 1, 1) == letter
                expression = F.when(matches, result) if expression is None else expression.when(matches, result)
        moved.append(expression)
    return moved


def reorient(image: DataFrame, meta: DataFrame, target: str) -> DataFrame:
    """Permute and flip the axes of every image to ``target``; adds the orientation it came from."""
    known = meta.select("image_id", "size", geometry.orientation_code(F.col("direction")).alias("source_code"))
    joined = attach(image, known, IMAGE)
    size = geometry.items(F.col("size"))
    moved = _turned([F.col(c) for c in XYZ], target, lambda axis, index: size[axis] - 1 - index)
    kept = [c for c in image.columns if c not in XYZ]
    return joined.select(*kept, *[e.cast("long").alias(n) for n, e in zip(XYZ, moved)], "source_code")


def reorient_series(series: DataFrame, vectors: DataFrame, meta: DataFrame, target: str, time: str = "t",
                    vector: Sequence[str] = ("vx", "vy", "vz")) -> DataFrame:
    """Time points of 4-D images in the orientation ``target``, each voxel with the direction vector of its time point.

    ``vectors`` has one vector per image and time point; it is turned by the same axes and signs as the voxels. Images
    whose directions name an anatomical axis twice stop the job; time points without a vector keep null ones.
    """
    code = geometry.orientation_code(F.col("direction"))
    axes = F.size(F.array_distinct(F.array(*[F.translate(F.substring(code, i, 1), "LPS", "RAI") for i in (1, 2, 3)])))
    checked = meta.withColumn("source_code", F.when(axes == 3, code).otherwise(
        F.raise_error(F.concat(F.lit("no valid orientation: "), code)).cast("string")))
    turned = attach(vectors.select(*IMAGE, time, *vector), checked.select(*IMAGE, "source_code"), IMAGE)
    moved = _turned([F.col(v) for v in vector], target, lambda _, value: -value)
    turned = turned.select(*IMAGE, time, *[e.alias(v) for v, e in zip(vector, moved)])
    placed = reorient(series, meta, target)
    return attach(placed, turned, [*IMAGE, time], "left")


def unstack(series: DataFrame, keys: Sequence[str] = IMAGE, time: str = "t") -> DataFrame:
    """Split a series into one image per time point; the time moves into the image key."""
    named = F.concat_ws("_", *[F.col(k).cast("string") for k in keys], F.col(time).cast("string"))
    return series.withColumn("slice_id", named).drop(time)


def stack(images: DataFrame, order: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Join images to one series per ``series_id``; ``order`` has image_id, series_id, t.

    With ``meta`` given, a series whose images differ in geometry is refused by an error.
    """
    if meta is not None:
        shape = F.to_json(F.struct("size", "spacing", "origin", "direction"))
        mixed = (order.join(meta, "image_id").groupBy("series_id")
                 .agg((F.min(shape) != F.max(shape)).alias("mixed")))
        checked = mixed.select("series_id", F.when(
            F.col("mixed"), F.raise_error(F.concat(F.lit("geometry differs in series "), F.col("series_id").cast("string"))))
            .cast("boolean").alias("_error"))
        order = order.join(checked, "series_id").where(F.col("_error").isNull()).drop("_error")
    return attach(images, order.select("image_id", "series_id", "t"), IMAGE)


def nonzero_indices(image: DataFrame, value: str = "value") -> DataFrame:
    return image.where(F.col(value) != 0).drop(value)


def values_at(image: DataFrame, indices: DataFrame, on: Sequence[str] = (*IMAGE, *XYZ)) -> DataFrame:
    """Values at the given coordinates; the columns of ``indices`` (such as a position) are kept."""
    return indices.join(image, list(on))


def one_hot_labels(labelmap: DataFrame, labels: Sequence[int] | None = None, label: str = "label") -> DataFrame:
    """One 0/1 column per label, or in long form one row per voxel with its label and mask 1."""
    if labels is None:
        return labelmap.withColumn("mask", F.lit(1))
    return labelmap.withColumns({f"mask_{v}": (F.col(label) == v).cast("int") for v in labels})


def crop_to_mask(image: DataFrame, mask: DataFrame, meta: DataFrame, isotropic: bool = False,
                 value: str = "value", mask_value: str = "mask") -> DataFrame:
    """Keep values in the box around the mask, 0 elsewhere."""
    found = mask.where(F.col(mask_value) != 0)
    bounds = [f(c).alias(f"{n}_{c}") for c in XYZ for n, f in (("lo", F.min), ("hi", F.max))]
    box = found.groupBy(*IMAGE).agg(*bounds).join(meta.select("image_id", "size"), "image_id")
    half = {c: (F.col(f"hi_{c}") - F.col(f"lo_{c}")) / 2 for c in XYZ}
    largest = F.greatest(*half.values())
    limits = []
    for axis, c in enumerate(XYZ):
        centre = (F.col(f"hi_{c}") + F.col(f"lo_{c}")) / 2
        reach = largest if isotropic else half[c]
        for name, edge in (("from", centre - reach), ("to", centre + reach)):
            limits.append(F.least(F.greatest(F.round(edge), F.lit(0.0)), F.col("size")[axis].cast("double"))
                          .alias(f"{name}_{c}"))
    joined = attach(image, box.select(*IMAGE, *limits), IMAGE, "left")
    inside = None
    for c in XYZ:
        here = (F.col(c) >= F.col(f"from_{c}")) & (F.col(c) < F.col(f"to_{c}"))
        inside = here if inside is None else inside & here
    return joined.select(*[c for c in image.columns if c != value],
                         F.when(inside, F.col(value)).otherwise(F.lit(0.0)).alias(value))


def points_in_image(points: DataFrame, meta: DataFrame) -> DataFrame:
    joined = attach(points, meta.select("image_id", "size"), IMAGE)
    inside = None
    for axis, c in enumerate(XYZ):
        here = (F.col(c) >= 0) & (F.col(c) < F.col("size")[axis])
        inside = here if inside is None else inside & here
    return joined.where(inside).drop("size")


def vote_argmax(scores: DataFrame, keys: Sequence[str] = (*IMAGE, *XYZ), label: str = "label",
                score: str = "score") -> DataFrame:
    """Label of the highest score per voxel; equal scores go to the lowest label."""
    return scores.groupBy(*keys).agg(F.max_by(label, vote_key(F.col(score), F.col(label))).alias(label))


# --- arithmetic of two images -----------------------------------------------------------------

def combine(a: Column, b: Column, op: str, scale: float = 1.0) -> Column:
    """add, subtract, multiply or add_scaled (a + scale * b)."""
    return {"add": lambda: a + b, "subtract": lambda: a - b, "multiply": lambda: a * b,
            "add_scaled": lambda: a + F.lit(scale) * b}[op]()


def image_arithmetic(a: DataFrame, b: DataFrame | None, op: str, scale: float = 1.0, on: Sequence[str] = (*IMAGE, *XYZ),
                     value: str = "value", vector: bool = False) -> DataFrame:
    """Voxel-wise arithmetic of two images; per component if ``vector``. "scale" needs no second image.

    A voxel that one of the images lacks is 0 there, so only a product can leave it out.
    """
    if op == "scale":
        scaled = F.transform(value, lambda v: v * F.lit(scale)) if vector else F.col(value) * F.lit(scale)
        return a.withColumn(value, scaled)
    joined = a.join(b.select(*on, F.col(value).alias("_other")), list(on), "inner" if op == "multiply" else "full")
    zero = (lambda c: F.transform(c, lambda v: v * 0)) if vector else (lambda c: c * 0)
    left, right = F.coalesce(value, zero(F.col("_other"))), F.coalesce("_other", zero(F.col(value)))
    result = F.zip_with(left, right, lambda p, q: combine(p, q, op, scale)) if vector else combine(left, right, op, scale)
    return joined.withColumn(value, result).drop("_other")


def vector_length(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, v: total + v * v))


def limit_vector_length(field: DataFrame, max_length: float, down_only: bool = False, keys: Sequence[str] = IMAGE,
                        vector: str = "vector") -> DataFrame:
    """Scale all vectors of an image so that the longest one has ``max_length``."""
    longest = field.groupBy(*keys).agg(F.max(vector_length(F.col(vector))).alias("_longest"))
    factor = F.when(F.col("_longest") > 0, max_length / F.col("_longest")).otherwise(F.lit(1.0))
    if down_only:
        factor = F.least(factor, F.lit(1.0))
    joined = attach(field, longest, list(keys)).withColumn("_factor", factor)
    return joined.withColumn(vector, F.transform(vector, lambda v: v * F.col("_factor"))).drop("_longest", "_factor")
