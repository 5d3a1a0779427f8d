"""Intensity normalisation, smoothing and resampling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from voxcohort.operators import histograms, joins, tiles
from voxcohort.operators.statistics import percentile_rank, select_ranks
from voxcohort.session import attach, fits_broadcast, join_summary, settle

IMAGE = ["image_id"]
XYZ = ["x", "y", "z"]


def zscore_image(image: DataFrame, mask: DataFrame | None = None, quantiles: Sequence[float] = (5, 95),
                 cutoffs: Sequence[float] = (3, 3), use_whole_mean: bool = False, keys: Sequence[str] = IMAGE,
                 value: str = "value") -> DataFrame:
    """Robust z-score of every voxel.

    Mean and deviation come from the positive masked values between two limits: the stricter of the
    percentile and of mean minus or plus cutoff deviations. Without a mask the values from 1 upwards
    count; an image whose mask is empty counts as a whole.
    """
    keys = list(keys)
    v = F.col(value)
    if mask is None:
        tagged = attach(image, image.groupBy(*keys).agg((F.max(value) >= 1).alias("_some")), keys)
        counted = tagged.where((v > 0) & ((v >= 1) | ~F.col("_some"))).select(*keys, v.alias("v"))
    else:
        marks = mask.where("mask > 0").select(*keys, *XYZ, F.lit(True).alias("_in"))
        some = marks.groupBy(*keys).agg(F.lit(True).alias("_some"))
        tagged = attach(image.join(marks, [*keys, *XYZ], "left"), some, keys, "left")
        counted = tagged.where((v > 0) & (F.col("_in").isNotNull() | F.col("_some").isNull())).select(*keys, v.alias("v"))
    counted = settle(counted)  # read four times
    x = F.col("v")
    rough = counted.groupBy(*keys).agg(F.min(x).alias("_min"), F.max(x).alias("_max"), F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"))
    limits = select_ranks(counted, {"_lo": percentile_rank(quantiles[0]), "_hi": percentile_rank(quantiles[1])}, keys, "v")
    low = [F.col("_min"), F.col("_lo"), F.col("_m") - cutoffs[0] * F.col("_s")]
    bounds = rough.join(limits, keys)
    if use_whole_mean:
        bounds = bounds.join(image.groupBy(*keys).agg(F.avg(value).alias("_whole")), keys)
        low.append(F.col("_whole"))
    bounds = bounds.select(*keys, F.greatest(*low).alias("_low"),
                           F.least(F.col("_max"), F.col("_hi"), F.col("_m") + cutoffs[1] * F.col("_s")).alias("_high"))
    kept = attach(counted, bounds, keys).where(x.between(F.col("_low"), F.col("_high")))
    final = kept.groupBy(*keys).agg(F.avg(x).alias("_mean"), F.stddev_samp(x).alias("_std"))
    return attach(image, final, keys).withColumn(
        value, F.try_divide(v - F.col("_mean"), F.col("_std"))).drop("_mean", "_std")


def zscore_if_needed(image: DataFrame, keys: Sequence[str] = IMAGE, value: str = "value", tolerance: float = 1e-9, **options) -> DataFrame:
    """Normalise only the images whose mean is not 0 yet."""
    means = settle(image.groupBy(*keys).agg((F.abs(F.avg(value)) > tolerance).alias("_open")))
    tagged = attach(image, means, list(keys))
    open_images = tagged.where("_open").drop("_open")
    return tagged.where(~F.col("_open")).drop("_open").unionByName(zscore_image(open_images, keys=keys, value=value, **options))


def p1p2_normalize(image: DataFrame, low: float = 0.02, high: float = 0.95, bins: int = 1000, keys: Sequence[str] = IMAGE,
                   value: str = "value") -> DataFrame:
    """Clip to two histogram quantiles of the values at or above the mean, then (x - lo) / hi.

    The divisor is hi and not hi - lo, because downstream numbers depend on it.
    """
    keys = list(keys)
    mean = image.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    inside = attach(image, mean, keys).where(F.col(value) >= F.col("_mean")).select(*keys, value)
    cuts = histograms.histogram_quantile(histograms.histogram(inside, bins, keys, value), {"_lo": low, "_hi": high}, keys)
    clipped = F.least(F.greatest(F.col(value), F.col("_lo")), F.col("_hi"))
    return attach(image, cuts, keys).withColumn(
        value, F.try_divide(clipped - F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def rescale_intensity(images: DataFrame, low: float = 0.0, high: float = 1000.0, keys: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Linear map to [low, high] with one minimum and maximum for all images of a key (by default, all images)."""
    keys = list(keys) or ["_all"]
    tagged = images.withColumn("_all", F.lit(1)) if keys == ["_all"] else images
    bounds = tagged.groupBy(*keys).agg(F.min(value).alias("_min"), F.max(value).alias("_max"))
    share = F.coalesce(F.try_divide(F.col(value) - F.col("_min"), F.col("_max") - F.col("_min")), F.lit(0.0))
    joined = attach(tagged, bounds, keys)
    return joined.withColumn(value, share * (high - low) + low).drop("_min", "_max", "_all")


def joint_normalize(images: DataFrame, group: str = "series_id", method: str = "zscore", value: str = "value", **options) -> DataFrame:
    """Normalise all images of a series together, with one set of statistics per series."""
    methods = {"zscore": zscore_image, "p1p2": p1p2_normalize, "rescale": rescale_intensity}
    return methods[method](images, keys=[group], value=value, **options)


def histogram_match(image: DataFrame, reference: DataFrame, points: int = 40, bins: int = 100, keys: Sequence[str] = IMAGE,
                    value: str = "value") -> DataFrame:
    """Map the values so that their quantiles above the mean match those of the reference.

    Quantile tables of ``points`` inner points come from histograms above the mean with ``bins`` bins;
    values between two points are mapped linearly, values outside with the slope towards the minimum
    and maximum of the images.
    """
    keys = list(keys)

    def table(df: DataFrame, prefix: str) -> DataFrame:
        ends = df.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"))
        above = attach(df, ends.select(*keys, F.col("mean").alias("_m")), keys).where(F.col(value) >= F.col("_m")).select(*keys, value)
        joined = ends.join(histograms.quantile_points(histograms.histogram(above, bins, keys, value), points, keys), keys)
        inner = F.concat(F.array("mean"), "quantiles", F.array("high"))
        return joined.select(*keys, inner.alias(f"{prefix}_q"), F.col("low").alias(f"{prefix}_low"))

    both = table(image, "s").join(table(reference, "r"), keys)
    joined = attach(image, both, keys)
    v, s, r = F.col(value), F.col("s_q"), F.col("r_q")
    # number of quantile points at or below the value selects the segment
    segment = F.least(F.size(F.filter(s, lambda q: q <= v)), F.lit(points + 1))
    here = F.greatest(segment, F.lit(1)).cast("int")
    s0, s1, r0, r1 = F.element_at(s, here), F.element_at(s, here + 1), F.element_at(r, here), F.element_at(r, here + 1)
    inside = r0 + F.coalesce(F.try_divide(v - s0, s1 - s0), F.lit(0.0)) * (r1 - r0)
    slope = F.coalesce(F.try_divide(F.element_at(r, 1) - F.col("r_low"), F.element_at(s, 1) - F.col("s_low")), F.lit(0.0))
    below = F.element_at(r, 1) + (v - F.element_at(s, 1)) * slope
    return joined.withColumn(value, F.when(segment == 0, below).otherwise(inside)).drop("s_q", "r_q", "s_low", "r_low")


def susan_smooth(image: DataFrame, sigma: float = 0.5, threshold: float = 80.0, radius: int = 1, keys: Sequence[str] = IMAGE,
                 value: str = "value") -> DataFrame:
    """Edge-preserving mean over the box of neighbours, the centre left out; rounded.

    Weights are exp(-d² / 2σ² - Δ² / threshold²). Where all weights vanish the median of the neighbours
    is taken; a voxel without neighbours keeps its value. All results come from the input values.
    """
    steps = joins.offsets(radius, "box", include_centre=False)

    def compute(tile: tiles.Tile) -> dict:
        values = tile.column("_v")
        centre = values[tile.core]
        whole, weighed = np.zeros(len(centre)), np.zeros(len(centre))
        for step in steps:
            other = tile.neighbour(step)
            near = values[other]
            with np.errstate(under="ignore"):
                weight = np.where(other >= 0, np.exp(-sum(o * o for o in step) / (2 * sigma * sigma) - (near - centre) ** 2 / (threshold * threshold)), 0.0)
            whole += weight
            weighed += weight * np.where(other >= 0, near, 0.0)
        median = centre.copy()
        lost = tile.core[whole == 0]
        if len(lost):
            around = np.stack([np.where((other := tile.neighbour(step, lost)) >= 0, values[other], np.nan) for step in steps])
            some = ~np.isnan(around).all(axis=0)
            median[np.flatnonzero(whole == 0)[some]] = np.nanmedian(around[:, some], axis=0)
        made = {c: tile.cells.field(c).take(pa.array(tile.core)) for c in XYZ}
        return made | {"_w": whole, "_wv": weighed, "_median": median}

    out = StructType([*tiles.places(image), *[StructField(n, DoubleType()) for n in ("_w", "_wv", "_median")]])
    smoothed = tiles.map_tiles(image.select(*keys, *XYZ, F.col(value).cast("double").alias("_v")), radius, ["_v"], keys, compute, out)
    result = F.when(F.col("_w") > 0, F.round(F.col("_wv") / F.col("_w"))).otherwise(F.col("_median"))
    others = [c for c in image.columns if c not in (*keys, *XYZ, value)]
    smoothed = smoothed.select(*keys, *XYZ, result.alias(value))
    return smoothed if not others else image.drop(value).join(smoothed, [*keys, *XYZ]).select(*image.columns)


# --- resampling -------------------------------------------------------------------------------

#: Edge of the cubes of output voxels that are computed together.
CUBE = 32

#: Output rows of one Arrow batch, about.
BATCH_ROWS = 1 << 16


def _reach(c: str, axis: int, interpolation: str) -> tuple[Column, Column]:
    """First and last output along an axis that a stored voxel contributes to."""
    step, last, old_last = F.col("step")[axis], F.col("new_size")[axis] - 1, F.col("old_size")[axis] - 1
    if interpolation == "nearest":
        # output o reads index floor(o * step + 1/2), cut to the grid
        lower, upper = F.ceil((F.col(c) - 0.5) / step), F.ceil((F.col(c) + 0.5) / step) - 1
    else:
        lower, upper = F.floor((F.col(c) - 1) / step), F.ceil((F.col(c) + 1) / step)
    # the last stored voxel also serves the outputs beyond it
    return F.greatest(lower, F.lit(0)).cast("int"), F.when(F.col(c) == old_last, last).otherwise(F.least(upper, last)).cast("int")


def _sample(image: DataFrame, plan: DataFrame, interpolation: str, keys: list[str], value: str, time: list[str]) -> DataFrame:
    """Fill a new grid from the old one. ``plan`` has old_size, new_size and step arrays per image.

    Work starts from the stored voxels: each one is sent to the output voxels it contributes to, or to the cubes that hold them, so
    the join needs no copies of the dense output grid and zero regions cost nothing.
    """
    plan = settle(plan)
    small = fits_broadcast(plan)
    joined = join_summary(image.select(*keys, *time, *XYZ, value), plan, keys, "inner", small)
    if interpolation != "nearest":
        return _sample_cubes(joined, plan, small, keys, value, time)
    for axis, c in enumerate(XYZ):
        first, final = _reach(c, axis, interpolation)
        outputs = F.when(first <= final, F.sequence(first, final)).otherwise(F.array().cast("array<int>"))
        joined = joined.withColumn(f"o_{c}", F.explode(outputs))
        read = F.least(F.floor(F.col("step")[axis] * F.col(f"o_{c}") + 0.5), F.col("old_size")[axis] - 1)
        joined = joined.where(read == F.col(c))
    return joined.select(*keys, *time, *[F.col(f"o_{c}").cast("long").alias(c) for c in XYZ], value)


def _sample_cubes(joined: DataFrame, plan: DataFrame, small: bool, keys: list[str], value: str, time: list[str]) -> DataFrame:
    """Linear interpolation, one row a cube of outputs with the stored voxels it reads.

    A cube reads at most two voxels an axis and output, so its row is bounded whatever the image, and a voxel is not copied
    for each output that it contributes to.
    """
    moved = joined.dropna(subset=XYZ)
    for axis, c in enumerate(XYZ):
        first, final = _reach(c, axis, "linear")
        cubes = F.when(first <= final, F.sequence(F.floor(first / CUBE).cast("int"), F.floor(final / CUBE).cast("int"))).otherwise(F.array().cast("array<int>"))
        moved = moved.withColumn(f"_t{c}", F.explode(cubes))
    places = [f"_t{c}" for c in XYZ]
    cell = F.struct(*[F.col(c).cast("long").alias(c) for c in XYZ], F.col(value).cast("double").alias("_v"))
    gathered = moved.groupBy(*keys, *time, *places).agg(F.collect_list(cell).alias("cells"))
    cubes = join_summary(gathered, plan, keys, "inner", small)
    kept = [*keys, *time]
    schema = StructType([*[joined.schema[k] for k in kept], *[StructField(c, LongType()) for c in XYZ], StructField(value, DoubleType())])
    arrow = to_arrow_schema(schema)
    plain = cubes.select(*kept, *places, "old_size", "new_size", "step", "cells")
    return plain.mapInArrow(lambda batches: _filled(batches, kept, value, arrow), schema)


def _filled(batches: Iterator[pa.RecordBatch], kept: list[str], value: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = lambda name, batch=batch: batch.column(batch.schema.get_field_index(name))
        lists = column("cells")
        ends = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        cells = lists.flatten()
        at = np.stack([cells.field(c).to_numpy() for c in XYZ])
        known = cells.field("_v").is_valid().to_numpy(zero_copy_only=False)
        values = cells.field("_v").fill_null(0.0).to_numpy()
        corners, old, new, step = (list(zip(*[column(f"_t{c}").to_pylist() for c in XYZ])), *[column(n).to_pylist() for n in ("old_size", "new_size", "step")])
        made, count = [], 0
        for i in range(batch.num_rows):
            part = slice(ends[i], ends[i + 1])
            made.append((i, *_fill(at[:, part], values[part], known[part], corners[i], old[i], new[i], step[i])))
            count += len(made[-1][-1])
            if count >= BATCH_ROWS or i == batch.num_rows - 1:
                rows = np.repeat([m[0] for m in made], [len(m[-1]) for m in made])
                place, sums, some = (np.concatenate([m[k] for m in made], axis=-1) for k in (1, 2, 3))
                columns = [column(k).take(pa.array(rows)) for k in kept] + [pa.array(p) for p in place] + [pa.array(sums, mask=~some)]
                yield pa.record_batch([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)
                made, count = [], 0


@lru_cache(maxsize=4096)
def _axis(corner: int, old: int, new: int, step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Outputs of a cube along an axis, the old places they read, and for each output the numbers and shares of its two."""
    o = np.arange(corner * CUBE, min((corner + 1) * CUBE, new))
    place = np.minimum(step * o, float(old - 1))
    near = np.floor(place).astype(np.int64) + np.array([[0], [1]])
    read, where = np.unique(near, return_inverse=True)
    share = 1 - np.abs(place - near)
    return o, read, where.reshape(near.shape), np.where(share > 1e-12, share, 0.0)


def _fill(at: np.ndarray, values: np.ndarray, known: np.ndarray, corner, old, new, step) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, sums and whether a value is known, of the outputs of a cube to which some voxel contributes."""
    outputs, ends, shares, inside, index, shape = [], [], [], np.ones(at.shape[1], bool), [], []
    for axis in range(3):
        o, read, where, share = _axis(corner[axis], old[axis], new[axis], step[axis])
        found = np.minimum(np.searchsorted(read, at[axis]), len(read) - 1)
        inside &= read[found] == at[axis]
        outputs.append(o)
        ends.append(where)
        shares.append(share)
        index.append(found)
        shape.append(len(read))
    cells = np.ravel_multi_index([f[inside] for f in index], shape)
    size = int(np.prod(shape))
    stored = np.bincount(cells, minlength=size).reshape(shape) > 0
    whole = known.all()
    some = stored if whole else np.bincount(cells[known[inside]], minlength=size).reshape(shape) > 0
    dense = np.bincount(cells, values[inside], minlength=size).reshape(shape)
    grid = tuple(len(o) for o in outputs)
    sums, any_stored, any_known = np.zeros(grid), np.zeros(grid, bool), np.zeros(grid, bool)
    for ends_of in np.ndindex(2, 2, 2):
        read = np.ix_(*[e[k] for e, k in zip(ends, ends_of)])
        x, y, z = (s[k] for s, k in zip(shares, ends_of))
        share = x[:, None, None] * y[None, :, None] * z[None, None, :]
        counts = (x > 0)[:, None, None] & (y > 0)[None, :, None] & (z > 0)[None, None, :]
        here = some[read] & counts
        any_known |= here
        if not whole:
            any_stored |= stored[read] & counts
        with np.errstate(invalid="ignore"):
            sums += np.where(here, share * dense[read], 0.0)
    if whole:
        any_stored = any_known
    places = np.nonzero(any_stored)
    return np.stack([o[p] for o, p in zip(outputs, places)]).astype(np.int64), sums[places], any_known[places]


def _time(image: DataFrame) -> list[str]:
    return ["t"] if "t" in image.columns else []


def resample(image: DataFrame, meta: DataFrame, spacing: Sequence[float] | float, interpolation: str = "linear",
             keys: Sequence[str] = IMAGE, value: str = "value") -> DataFrame:
    """Image on a grid of another spacing; one number means isotropic. Time points of a series are kept.

    The new size is round(size * old / new spacing). Absent voxels count as 0.
    """
    wanted = [float(spacing)] * 3 if isinstance(spacing, (int, float)) else [float(s) for s in spacing]
    target = meta.withColumn("target", F.array(*[F.lit(s) for s in wanted]))
    return _sample(image, _resample_plan(target, list(keys)), interpolation, list(keys), value, _time(image))


def _resample_plan(target: DataFrame, keys: list[str]) -> DataFrame:
    sizes = [F.round(F.col("size")[i] * F.col("spacing")[i] / F.col("target")[i]).cast("int") for i in range(3)]
    steps = [F.col("target")[i] / F.col("spacing")[i] for i in range(3)]
    return target.select(*keys, F.col("size").alias("old_size"), F.array(*sizes).alias("new_size"), F.array(*steps).alias("step"))


def resample_to_reference(image: DataFrame, meta: DataFrame, reference: DataFrame, interpolation: str = "linear",
                          keys: Sequence[str] = IMAGE, value: str = "value") -> DataFrame:
    """Resample to the spacing of a reference image; ``reference`` has one ``spacing`` array per key."""
    target = meta.join(reference.select(*keys, F.col("spacing").alias("target")), list(keys))
    return _sample(image, _resample_plan(target, list(keys)), interpolation, list(keys), value, _time(image))


def resize(image: DataFrame, meta: DataFrame, percent: float, interpolation: str = "linear", keys: Sequence[str] = IMAGE,
           value: str = "value") -> DataFrame:
    """Scale the grid by a percentage: the size is cut down to an integer, the spacing grows accordingly."""
    factor = percent / 100
    sizes = [F.floor(F.col("size")[i] * factor).cast("int") for i in range(3)]
    plan = meta.select(*keys, F.col("size").alias("old_size"), F.array(*sizes).alias("new_size"),
                       F.array(*[F.lit(1 / factor)] * 3).alias("step"))
    return _sample(image, plan, interpolation, list(keys), value, _time(image))
