"""Histograms, thresholds and similarity measures of value distributions, per group."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from voxcohort.operators import joins, tiles
from voxcohort.session import attach, settle

IMAGE = ["image_id"]
XYZ = ["x", "y", "z"]


def bin_of(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based equal-width bin; the upper bound belongs to the last bin."""
    place = F.floor((value - low) / F.when(high > low, high - low) * bins)
    return F.greatest(F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)), F.lit(0))


def histogram(df: DataFrame, bins: int, keys: Sequence[str] = IMAGE, value: str = "value", low: float | None = None,
              high: float | None = None) -> DataFrame:
    """Counts of equal-width bins between the bounds, by default the extremes of each group.

    Returns the filled bins with their edges. Filter the input by a mask first to count inside it.
    """
    keys = list(keys)
    if low is None or high is None:
        bounds = df.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
        ranged = attach(df.select(*keys, value), bounds, keys)
    else:
        ranged = df.where(F.col(value).between(low, high)).select(
            *keys, value, F.lit(float(low)).alias("_low"), F.lit(float(high)).alias("_high"))
    binned = ranged.groupBy(*keys, "_low", "_high", bin_of(F.col(value), F.col("_low"), F.col("_high"), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("count"))
    step = (F.col("_high") - F.col("_low")) / bins
    return binned.select(*keys, "bin", (F.col("_low") + step * F.col("bin")).alias("low"),
                         (F.col("_low") + step * (F.col("bin") + 1)).alias("high"), "count")


def histogram_quantile(hist: DataFrame, quantiles: dict[str, float], keys: Sequence[str] = IMAGE) -> DataFrame:
    """Quantiles by linear interpolation inside the bin where the cumulative share reaches them."""
    everything = Window.partitionBy(*keys)
    running = everything.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shares = hist.withColumn("total", F.sum("count").over(everything)).withColumn("upto", F.sum("count").over(running))
    results = []
    for name, q in quantiles.items():
        wanted = F.lit(float(q)) * F.col("total")
        first = (F.col("upto") >= wanted) & (F.col("upto") - F.col("count") < wanted)
        inside = F.col("low") + (wanted - F.col("upto") + F.col("count")) / F.col("count") * (F.col("high") - F.col("low"))
        results.append(F.max(F.when(first, inside)).alias(name))
    return shares.groupBy(*keys).agg(*results)


def quantile_points(hist: DataFrame, points: int, keys: Sequence[str] = IMAGE) -> DataFrame:
    """The quantiles i / (points + 1), i = 1 .. points, as one array per group.

    Each bin yields just the quantiles that fall into it.
    """
    everything = Window.partitionBy(*keys)
    running = everything.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shares = hist.withColumn("total", F.sum("count").over(everything)).withColumn("upto", F.sum("count").over(running))
    share = lambda n: F.floor(n * (points + 1) / F.col("total")).cast("int")
    nearby = F.sequence(share(F.col("upto") - F.col("count")), share(F.col("upto")) + 1)
    wanted = F.col("i") / (points + 1) * F.col("total")
    before = F.col("upto") - F.col("count")
    here = shares.withColumn("i", F.explode(nearby)).where(
        F.col("i").between(1, points) & (F.col("upto") >= wanted) & (before < wanted))
    value = F.col("low") + (wanted - F.col("upto") + F.col("count")) / F.col("count") * (F.col("high") - F.col("low"))
    ordered = F.array_sort(F.collect_list(F.struct("i", value.alias("q"))))
    return here.groupBy(*keys).agg(F.transform(ordered, lambda e: e["q"]).alias("quantiles"))


def otsu(df: DataFrame, bins: int = 128, keys: Sequence[str] = IMAGE, value: str = "value") -> DataFrame:
    """Upper edge of the bin that maximises the between-class variance, the lowest such bin first."""
    hist = histogram(df, bins, keys, value).withColumn("centre", (F.col("low") + F.col("high")) / 2)
    everything = Window.partitionBy(*keys)
    running = everything.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mass = F.col("count") * F.col("centre")
    sums = hist.withColumns({
        "n": F.sum("count").over(everything), "m": F.sum(mass).over(everything),
        "n0": F.sum("count").over(running), "m0": F.sum(mass).over(running)})
    n0, n1 = F.col("n0"), F.col("n") - F.col("n0")
    gap = F.col("m0") / n0 - (F.col("m") - F.col("m0")) / F.when(n1 > 0, n1)
    # rounding makes mathematically equal candidates really equal, so that the tie rule decides
    between = F.round(F.coalesce(n0 * n1 / (F.col("n") * F.col("n")) * gap * gap, F.lit(0.0)), 6)
    return sums.groupBy(*keys).agg(F.max_by("high", F.struct(between, -F.col("bin"))).alias("threshold"))


def otsu_threshold(df: DataFrame, mask: DataFrame | None = None, bins: int = 128, keys: Sequence[str] = IMAGE,
                   value: str = "value", on: Sequence[str] = (*IMAGE, *XYZ)) -> DataFrame:
    """1 above the threshold, else 0; with a mask only masked voxels count and stay."""
    inside = df if mask is None else df.join(mask.where("mask <> 0").select(*on), list(on), "left_semi")
    joined = attach(inside, otsu(inside, bins, keys, value), list(keys))
    return joined.withColumn(value, (F.col(value) > F.col("threshold")).cast("int")).drop("threshold")


# --- two images -------------------------------------------------------------------------------

def joint_histogram(pair: DataFrame, bins: int, a: str = "a", b: str = "b", keys: Sequence[str] = IMAGE) -> DataFrame:
    """Normalised counts p over two binned values with their marginals pa and pb.

    Bins run from 1; rows where one value is absent would fall in the reserved bin 0 and are left out.
    """
    keys = list(keys)
    both = pair.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, a, b)
    bounds = both.groupBy(*keys).agg(F.min(a).alias("_la"), F.max(a).alias("_ha"), F.min(b).alias("_lb"), F.max(b).alias("_hb"))
    ranged = attach(both, bounds, keys)
    counts = ranged.groupBy(*keys, (bin_of(F.col(a), F.col("_la"), F.col("_ha"), bins) + 1).alias("bin_a"),
                            (bin_of(F.col(b), F.col("_lb"), F.col("_hb"), bins) + 1).alias("bin_b")).agg(
        F.count(F.lit(1)).alias("count"))
    everything = Window.partitionBy(*keys)
    share = F.col("count") / F.sum("count").over(everything)
    with_p = counts.withColumn("p", share)
    return with_p.withColumns({"pa": F.sum("p").over(Window.partitionBy(*keys, "bin_a")),
                               "pb": F.sum("p").over(Window.partitionBy(*keys, "bin_b"))})


def mutual_information(pair: DataFrame, bins: int = 32, a: str = "a", b: str = "b", keys: Sequence[str] = IMAGE) -> DataFrame:
    """Mutual information and (Ha + Hb) / Hab. A marginal entropy is summed over the joint bins."""
    p, pa, pb = F.col("p"), F.col("pa"), F.col("pb")
    joint = joint_histogram(pair, bins, a, b, keys)
    sums = joint.groupBy(*keys).agg(F.sum(p * F.log(p / (pa * pb))).alias("mutual_information"),
                                    (-F.sum(p * F.log(pa))).alias("ha"), (-F.sum(p * F.log(pb))).alias("hb"),
                                    (-F.sum(p * F.log(p))).alias("hab"))
    return sums.select(*keys, "mutual_information",
                       F.try_divide(F.col("ha") + F.col("hb"), F.col("hab")).alias("normalized_mi"))


def weighted_ssd(df: DataFrame, a: Sequence[str], b: Sequence[str], weights: Sequence[float],
                 keys: Sequence[str] = IMAGE) -> DataFrame:
    """Sum of squared weighted differences, in total (``ssd``) and per component (``ssd_0``, ...)."""
    parts = []
    for left, right, w in zip(a, b, weights):
        difference = F.lit(float(w)) * (F.col(left) - F.col(right))
        parts.append(difference * difference)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole + part
    return df.groupBy(*keys).agg(F.sum(whole).alias("ssd"), *[F.sum(p).alias(f"ssd_{i}") for i, p in enumerate(parts)])


def _signed_correlation(sxx: Column, syy: Column, sxy: Column, eps: float) -> Column:
    value = sxy * sxy / F.when((sxx >= eps) & (syy >= eps), sxx * syy)
    return F.coalesce(F.signum(sxy) * value, F.lit(0.0))


def signed_correlation(pair: DataFrame, a: str = "a", b: str = "b", keys: Sequence[str] = IMAGE, eps: float = 1e-8) -> DataFrame:
    """Squared correlation of a whole group with the sign of the covariance."""
    x, y = F.col(a), F.col(b)
    n = F.count(F.lit(1))
    value = _signed_correlation(F.var_pop(x) * n, F.var_pop(y) * n, F.covar_pop(x, y) * n, eps)
    return pair.groupBy(*keys).agg(value.alias("correlation"))


def patch_ncc(pair: DataFrame, radius: int = 1, a: Sequence[str] = ("a",), b: Sequence[str] = ("b",),
              weights: Sequence[float] = (1.0,), keys: Sequence[str] = IMAGE, eps: float = 1e-8) -> DataFrame:
    """Signed squared correlation of the patch around every voxel, weighted over components."""
    sums = {"n": F.lit(1.0)}
    for i, (left, right) in enumerate(zip(a, b)):
        x, y = F.col(left).cast("double"), F.col(right).cast("double")
        sums |= {f"x{i}": x, f"y{i}": y, f"xx{i}": x * x, f"yy{i}": y * y, f"xy{i}": x * y}
    patches = tiles.box_sums(pair, radius, sums, keys)
    n = F.col("n")
    result = F.lit(0.0)
    for i, w in enumerate(weights):
        x, y = F.col(f"x{i}"), F.col(f"y{i}")
        result = result + float(w) * _signed_correlation(
            F.col(f"xx{i}") - x * x / n, F.col(f"yy{i}") - y * y / n, F.col(f"xy{i}") - x * y / n, eps)
    return patches.select(*keys, *XYZ, result.alias("ncc"))


# --- image comparison -------------------------------------------------------------------------

def voxel_differences(ref: DataFrame, test: DataFrame, radius: int = 0, on: Sequence[str] = (*IMAGE, *XYZ),
                      value: str = "value") -> DataFrame:
    """Smallest absolute difference of each reference voxel to the test voxels within the radius.

    An absent voxel is 0: a voxel of either image counts at radius 0, a reference voxel without test voxels around it always.
    """
    keys = [c for c in on if c not in XYZ]
    left = ref.select(*on, F.col(value).alias("_ref"))
    if radius == 0:
        right = test.select(*on, F.col(value).alias("_test"))
        zero = F.lit(0.0)
        return left.join(right, list(on), "full").select(
            *on, F.abs(F.coalesce("_ref", zero) - F.coalesce("_test", zero)).alias("difference"))
    both = left.select(*keys, *XYZ, F.col("_ref").cast("double").alias("_ref"), F.lit(None).cast("double").alias("_test"), F.lit(False).alias("_near")).unionByName(
        test.select(*keys, *XYZ, F.lit(None).cast("double").alias("_ref"), F.col(value).cast("double").alias("_test"), F.lit(True).alias("_near")))

    def compute(tile: tiles.Tile) -> dict:
        near = tile.column("_near").astype(bool)
        rows, others = tile.core[~near[tile.core]], np.flatnonzero(near)
        cube = tile.cube(tile.column("_test")[others], np.nan, others)
        reference = tile.column("_ref")[rows]
        least = np.full(len(rows), np.inf)
        for step in joins.offsets(radius, "box"):
            x, y, z = (tile.at[rows] + np.array(step)).T
            least = np.fmin(least, np.abs(reference - cube[x, y, z]))
        made = {c: tile.cells.field(c).take(pa.array(rows)) for c in XYZ}
        return made | {"difference": np.where(np.isinf(least), np.abs(reference), least)}

    out = StructType([*tiles.places(ref), StructField("difference", DoubleType())])
    return tiles.map_tiles(both, radius, ["_ref", "_test", "_near"], keys, compute, out, near="_near")


def compare_images(ref: DataFrame, test: DataFrame, threshold: float = 0.0, radius: int = 0,
                   on: Sequence[str] = (*IMAGE, *XYZ), value: str = "value") -> DataFrame:
    """Differing voxels and the minimum, maximum, average and total of their differences per image."""
    keys = [c for c in on if c not in XYZ]
    d = F.col("difference")
    counted = F.when(d > threshold, d)
    return voxel_differences(ref, test, radius, on, value).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("voxels"), F.count(counted).alias("differing"),
        F.floor(100 * F.count(counted) / F.count(F.lit(1))).alias("percent"),
        F.coalesce(F.min(counted), F.lit(0.0)).alias("minimum"), F.coalesce(F.max(counted), F.lit(0.0)).alias("maximum"),
        F.coalesce(F.avg(counted), F.lit(0.0)).alias("average"), F.coalesce(F.sum(counted), F.lit(0.0)).alias("total"))


def images_similar(comparison: DataFrame, limit: float = 0.0, tolerance: int = 10,
                   same_size: Column | None = None) -> DataFrame:
    """False if sizes differ, or the total difference exceeds the limit on more voxels than tolerated."""
    too_far = (F.col("total") > limit) & (F.col("differing") > tolerance)
    sized = F.lit(True) if same_size is None else same_size
    return comparison.withColumn("similar", sized & ~too_far)


def golden_comparison(ref: DataFrame, test: DataFrame, ref_meta: DataFrame, test_meta: DataFrame, threshold: float = 0.0, radius: int = 0,
                      on: Sequence[str] = (*IMAGE, *XYZ), value: str = "value") -> DataFrame:
    """``compare_images`` of the images that lie in the same space; the others have a message instead of figures.

    Both headers have dims, size, origin and spacing; every one of them must be equal.
    """
    keys = [c for c in on if c not in XYZ]
    properties = ("dims", "size", "origin", "spacing")
    header = lambda meta, name: meta.select(*keys, F.struct(*properties).alias(name))
    both = header(ref_meta, "_a").join(header(test_meta, "_b"), keys)
    spaces = settle(both.select(*keys, (F.col("_a") == F.col("_b")).alias("same_space")))
    here = attach(ref, spaces.where("same_space").select(*keys), keys, "left_semi")
    figures = compare_images(here, attach(test, spaces.where("same_space").select(*keys), keys, "left_semi"), threshold, radius, on, value)
    message = F.when(F.col("same_space"), "").otherwise("Images are in different spaces (size/origin/spacing mismatch)")
    return spaces.join(figures, keys, "left").select(*spaces.columns, message.alias("message"), *[c for c in figures.columns if c not in keys])
