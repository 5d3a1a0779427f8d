"""Agreement of two label maps: overlap, rates and surface distances, overall, per label and per region.

Overlap and rates all follow from the contingency table of label pairs, which one aggregate with
map-side combination builds; its size depends on the number of labels, not of voxels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxcohort.operators import joins, regions
from voxcohort.operators.statistics import roc_columns, select_ranks
from voxcohort.session import settle

IMAGE = ["image_id"]
XYZ = ["x", "y", "z"]

# The label codes that make up each tumour region.
REGIONS = {"NET": (1,), "ED": (2,), "ET": (4,), "TC": (1, 4), "WT": (1, 2, 4)}


def contingency(pair: DataFrame, keys: Sequence[str] = IMAGE, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """Voxel count of every pair of labels."""
    return pair.groupBy(*keys, F.col(src).alias("src"), F.col(tgt).alias("tgt")).agg(F.count(F.lit(1)).alias("n"))


def overlap_columns(both: Column, src: Column, tgt: Column) -> dict[str, Column]:
    """The six overlap measures from |S and T|, |S| and |T|."""
    union, total = src + tgt - both, src + tgt
    ratio = F.try_divide
    return {
        "overlap": ratio(both, tgt), "jaccard": ratio(both, union), "dice": ratio(2 * both, total),
        "volume_similarity": ratio(2 * (src - tgt), total), "false_negative_error": ratio(tgt - both, tgt),
        "false_positive_error": ratio(src - both, src)}


def _label_volumes(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """|S and T|, |S| and |T| of every label other than 0."""
    sides = table.withColumn("label", F.explode(F.array_distinct(F.array("src", "tgt")))).where("label <> 0")
    n = F.col("n")
    volume = lambda c: F.sum(F.when(c, n).otherwise(0)).cast("double")
    src, tgt = F.col("src") == F.col("label"), F.col("tgt") == F.col("label")
    return sides.groupBy(*keys, "label").agg(volume(src & tgt).alias("both"), volume(src).alias("s"), volume(tgt).alias("t"))


def label_overlap(table: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Overlap measures over all labels but 0, from a contingency table."""
    sums = _label_volumes(table, keys).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("both", "s", "t")])
    measures = overlap_columns(F.col("both"), F.col("s"), F.col("t"))
    return sums.select(*keys, *[c.alias(n) for n, c in measures.items()])


def label_overlap_by_label(table: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Overlap measures of each label, for maps with more than two distinct labels."""
    labels = F.array_union(F.collect_set("src"), F.collect_set("tgt"))
    rich = table.groupBy(*keys).agg((F.size(labels) > 2).alias("rich")).where("rich").drop("rich")
    measures = overlap_columns(F.col("both"), F.col("s"), F.col("t"))
    volumes = _label_volumes(table, keys).join(rich, list(keys), "left_semi")
    return volumes.select(*keys, "label", *[c.alias(n) for n, c in measures.items()])


def _rates(both: Column, s: Column, t: Column, n: Column) -> dict[str, Column]:
    counts = {"tp": both, "fp": t - both, "fn": s - both, "tn": n - s - t + both}
    ratio = F.try_divide
    return {"sensitivity": ratio(both, s), "specificity": ratio(counts["tn"], counts["tn"] + counts["fp"]),
            "accuracy": ratio(both + counts["tn"], n), "precision": ratio(both, t)}


def label_statistics(table: DataFrame, keys: Sequence[str] = IMAGE, pair: DataFrame | None = None,
                     spacing: DataFrame | None = None) -> DataFrame:
    """Long table (metric, value): overlap and rates, overall and per label, and surface distances if the voxels (``pair``) are given.

    Only maps whose two sides hold the same labels are scored. The overall rates take class 1 as
    positive and every other equal pair as a true negative. The distances are those of ``hausdorff95`` (by rank, in units of
    ``spacing``) between all voxels other than 0, and between the voxels of each label; two empty masks are 0 apart.
    """
    keys = list(keys)
    seen = table.groupBy(*keys).agg(F.array_sort(F.collect_set("src")).alias("a"), F.array_sort(F.collect_set("tgt")).alias("b"))
    same = table.join(seen.where(F.col("a") == F.col("b")).select(*keys), keys, "left_semi")

    def long(df: DataFrame, measures: dict[str, Column], suffix: Column) -> DataFrame:
        entries = F.array(*[F.struct(F.concat(F.lit(m), suffix).alias("metric"), c.cast("double").alias("value"))
                            for m, c in measures.items()])
        return df.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.metric", "e.value")

    volumes = _label_volumes(same, keys)
    sizes = same.groupBy(*keys).agg(F.sum("n").cast("double").alias("n"))
    whole = volumes.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("both", "s", "t")])
    b, s, t, n = (F.col(c) for c in ("both", "s", "t", "n"))
    per_label = volumes.join(sizes, keys)
    counted = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    src, tgt = F.col("src"), F.col("tgt")
    pairs = same.groupBy(*keys).agg(
        counted((src == 1) & (tgt == 1)).alias("tp"), counted((src == tgt) & (src != 1)).alias("tn"),
        counted((src == 1) & (tgt != 1)).alias("fn"), counted((src != 1) & (src != tgt)).alias("fp"),
        counted(src == 1).alias("rp"), counted(tgt == 1).alias("pp"))
    roc = roc_columns()
    suffix = F.concat(F.lit("_label"), F.col("label").cast("string"))
    scores = (long(whole, overlap_columns(b, s, t), F.lit("_overall"))
              .unionByName(long(pairs, {m: roc[m] for m in ("sensitivity", "specificity", "accuracy", "precision")}, F.lit("_overall")))
              .unionByName(long(per_label, overlap_columns(b, s, t) | _rates(b, s, t, n), suffix)))
    if pair is None:
        return scores
    names = F.array(F.lit("_overall"), F.concat(F.lit("_label"), F.col("label").cast("string")))
    words = _planes(label_words(pair.join(same.select(*keys).distinct(), keys, "left_semi"), keys), names, keys)
    far = _planes_hausdorff95(words, [*keys, "plane"], spacing=spacing).select(
        *keys, F.concat(F.lit("hausdorff95"), F.col("plane")).alias("metric"), F.col("hd95").alias("value"))
    empty = same.select(*keys).distinct().join(volumes, keys, "left_anti").select(*keys, F.lit("hausdorff95_overall").alias("metric"), F.lit(0.0).alias("value"))
    return scores.unionByName(far).unionByName(empty)


# --- regions ----------------------------------------------------------------------------------

def region_masks(labelmap: DataFrame, label: str = "label") -> DataFrame:
    """One row per voxel and region it belongs to."""
    member = F.array(*[F.when(F.col(label).isin(*codes), F.lit(name)) for name, codes in REGIONS.items()])
    return labelmap.select(*[c for c in labelmap.columns if c != label],
                           F.explode(F.array_compact(member)).alias("region"), F.lit(1).alias("mask"))


def region_volumes(table: DataFrame, keys: Sequence[str] = IMAGE, sizes: DataFrame | None = None) -> DataFrame:
    """|S and T|, |S|, |T| and the voxel count n of each region, also of empty ones.

    For sparse maps ``sizes`` gives the voxel count ``n`` of the whole image.
    """
    n = F.col("n")
    volume = lambda c: F.sum(F.when(c, n).otherwise(0)).cast("double")
    entries = []
    for name, codes in REGIONS.items():
        s, t = F.col("src").isin(*codes), F.col("tgt").isin(*codes)
        entries.append(F.struct(F.lit(name).alias("region"), volume(s & t).alias("both"), volume(s).alias("s"),
                                volume(t).alias("t"), F.sum(n).cast("double").alias("n")))
    wide = table.groupBy(*keys).agg(F.array(*entries).alias("entries"))
    long = wide.select(*keys, F.explode("entries").alias("e")).select(*keys, "e.*")
    if sizes is not None:
        long = long.drop("n").join(sizes, list(keys))
    return long


def region_statistics(table: DataFrame, keys: Sequence[str] = IMAGE, sizes: DataFrame | None = None, pair: DataFrame | None = None,
                      extents: DataFrame | None = None) -> DataFrame:
    """Overlap, accuracy, precision, sensitivity and specificity of each region from a contingency table.

    Two empty masks have Dice, sensitivity and specificity 1; where only one side is empty, an
    undefined sensitivity is 0. With the voxels (``pair``) and the ``size`` array of each image (``extents``) there is a
    column hausdorff95 by the rules of ``region_hausdorff95``.
    """
    b, s, t, n = (F.col(c) for c in ("both", "s", "t", "n"))
    measures = overlap_columns(b, s, t) | _rates(b, s, t, n)
    both_empty = (s == 0) & (t == 0)
    measures["dice"] = F.when(both_empty, F.lit(1.0)).otherwise(measures["dice"])
    measures["specificity"] = F.when(both_empty, F.lit(1.0)).otherwise(measures["specificity"])
    measures["sensitivity"] = F.when(both_empty, F.lit(1.0)).otherwise(F.coalesce(measures["sensitivity"], F.lit(0.0)))
    scores = region_volumes(table, keys, sizes).select(*keys, "region", *[c.alias(m) for m, c in measures.items()])
    if pair is None:
        return scores
    return scores.join(region_hausdorff95(pair, extents, keys), [*keys, "region"], "left")


# --- surface distances ------------------------------------------------------------------------

def _sides(pair: DataFrame, keys: Sequence[str], src: str, tgt: str) -> tuple[DataFrame, DataFrame]:
    """Non-zero voxels tagged with the direction in which they are points, and targets, of a search."""
    both = F.array_compact(F.array(F.when(F.col(src) != 0, F.lit("src")), F.when(F.col(tgt) != 0, F.lit("tgt"))))
    members = pair.select(*keys, *XYZ, F.explode(both).alias("side"))
    other = F.when(F.col("side") == "src", F.lit("tgt")).otherwise(F.lit("src"))
    return members, members.withColumn("side", other)


def hausdorff(pair: DataFrame, keys: Sequence[str] = IMAGE, src: str = "src", tgt: str = "tgt",
              spacing: DataFrame | None = None) -> DataFrame:
    """Largest distance from a voxel of either mask to the other mask."""
    points, targets = _sides(pair, keys, src, tgt)
    far = joins.nearest_squared(points, targets, [*keys, "side"], _per_side(spacing, keys))
    return far.groupBy(*keys).agg(F.sqrt(F.max("d2")).alias("hausdorff"))


def _per_side(spacing: DataFrame | None, keys: Sequence[str], words: DataFrame | None = None) -> DataFrame | None:
    """The spacing of every group of a search; ``spacing`` may have only some of the ``keys``, which ``words`` have all."""
    if spacing is None:
        return None
    missing = [k for k in keys if k not in spacing.columns]
    if missing:
        own = [k for k in keys if k not in missing]
        spacing = words.select(*keys).distinct().join(spacing.select(*own, "spacing"), own)
    return spacing.withColumn("side", F.explode(F.array(F.lit("src"), F.lit("tgt"))))


def hausdorff95(pair: DataFrame, keys: Sequence[str] = IMAGE, src: str = "src", tgt: str = "tgt",
                spacing: DataFrame | None = None, percentile: float = 0.95, pooled: bool = False,
                one_empty: Column | None = None) -> DataFrame:
    """Percentile of the surface distances between two masks.

    By default the sorted distances of each direction are read at floor(p * (n - 1)) and the larger
    direction wins. ``pooled`` puts the surface-to-surface distances of both directions together and
    interpolates. Two empty masks give 0; if one is empty the result is infinity, or ``one_empty``.
    """
    keys = list(keys)
    filled = pair.groupBy(*keys).agg(F.bool_or(F.col(src) != 0).alias("_s"), F.bool_or(F.col(tgt) != 0).alias("_t"))
    members, _ = _sides(pair, keys, src, tgt)
    words = settle(regions.pack_lines(members, [*keys, "side"]))
    found = _surface_percentile(words, keys, spacing, percentile, pooled)
    missing = F.when(~F.col("_s") & ~F.col("_t"), F.lit(0.0)).otherwise(
        F.lit(float("inf")) if one_empty is None else one_empty)
    return filled.join(found, keys, "left").select(
        *keys, F.when(F.col("_s") & F.col("_t"), F.col("hd95")).otherwise(missing).alias("hd95"))


def _surface_percentile(words: DataFrame, keys: list[str], spacing: DataFrame | None, percentile: float, pooled: bool) -> DataFrame:
    """(keys, hd95) of the groups that have voxels on both sides; ``words`` are the lines of both masks by ``side``."""
    other = F.when(F.col("side") == "src", F.lit("tgt")).otherwise(F.lit("src"))
    border = settle(regions.surface_of_words(words, [*keys, "side"], "cross" if pooled else "ball"))
    targets = border if pooled else regions.unpack_lines(words, [*keys, "side"])
    distances = settle(joins.nearest_squared(border, targets.withColumn("side", other), [*keys, "side"], _per_side(spacing, keys, words)))
    if pooled:
        at = lambda n: F.lit(percentile) * (n - 1)
        ends = select_ranks(distances, {"lo": lambda n: F.floor(at(n)), "hi": lambda n: F.ceil(at(n))}, keys, "d2")
        n = distances.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        part = at(F.col("n")) - F.floor(at(F.col("n")))
        low, high = F.sqrt("lo"), F.sqrt("hi")
        return ends.join(n, keys).select(*keys, (low + (high - low) * part).alias("hd95"))
    ranked = select_ranks(distances, {"d2": lambda n: F.floor(F.lit(percentile) * (n - 1))}, [*keys, "side"], "d2")
    return ranked.groupBy(*keys).agg(F.sqrt(F.max("d2")).alias("hd95"))


def label_words(pair: DataFrame, keys: Sequence[str] = IMAGE, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """Lines of 64 voxels of every label other than 0 on either side (columns side, label, y, z, w, bits)."""
    one = lambda c: F.when(F.col(c) != 0, F.struct(F.lit("src" if c == src else "tgt").alias("side"), F.col(c).alias("label")))
    members = pair.select(*keys, *XYZ, F.explode(F.array_compact(F.array(one(src), one(tgt)))).alias("_m"))
    return regions.pack_lines(members.select(*keys, *XYZ, "_m.side", "_m.label"), [*keys, "side", "label"])


def _planes(words: DataFrame, names: Column, keys: Sequence[str]) -> DataFrame:
    """Masks made of labels: the words of each plane that ``names`` lists for a label, put together bit by bit."""
    named = words.select(*keys, "side", "y", "z", "w", "bits", F.explode(names).alias("plane"))
    return settle(named.groupBy(*keys, "plane", "side", "y", "z", "w").agg(F.bit_or("bits").alias("bits")))


def _planes_hausdorff95(words: DataFrame, keys: list[str], spacing: DataFrame | None = None, percentile: float = 0.95, pooled: bool = False) -> DataFrame:
    """hd95 of every plane, all in one search; infinity where one side has no voxel."""
    found = _surface_percentile(words, keys, spacing, percentile, pooled)
    return words.select(*keys).distinct().join(found, keys, "left").select(*keys, F.coalesce("hd95", F.lit(float("inf"))).alias("hd95"))


def region_hausdorff95(pair: DataFrame, sizes: DataFrame, keys: Sequence[str] = IMAGE, src: str = "src",
                       tgt: str = "tgt") -> DataFrame:
    """Pooled 95th percentile per region in voxel units; if one mask is empty the diagonal of the image.

    ``sizes`` has one ``size`` array per group. Regions that are empty on both sides score 0. Voxels are packed by label; regions
    are put together from words of 64 voxels.
    """
    keys = list(keys)
    names = F.array_compact(F.array(*[F.when(F.col("label").isin(*codes), F.lit(name)) for name, codes in REGIONS.items()]))
    words = _planes(label_words(pair, keys, src, tgt), names, keys)
    scored = _planes_hausdorff95(words, [*keys, "plane"], pooled=True).withColumnRenamed("plane", "region")
    every = sizes.select(*keys, "size", F.explode(F.array(*[F.lit(r) for r in REGIONS])).alias("region"))
    diagonal = F.sqrt(F.aggregate("size", F.lit(0.0), lambda acc, v: acc + v * v))
    value = F.when(F.col("hd95") == float("inf"), diagonal).otherwise(F.coalesce("hd95", F.lit(0.0)))
    return every.join(scored, [*keys, "region"], "left").select(*keys, "region", value.alias("hausdorff95"))


# --- report -----------------------------------------------------------------------------------

def formatted_metric(value: Column) -> Column:
    """Six decimals, "NaN" for an undefined value and "INF" for an infinite or huge one."""
    huge = F.abs(value) > 1e101
    return F.when(value.isNull() | F.isnan(value), "NaN").when(huge, "INF").otherwise(F.format_string("%.6f", value))


def similarity_report(metrics: DataFrame, wide: bool = False, keys: Sequence[str] = IMAGE, label: str = "region",
                      names: Sequence[str] | None = None) -> DataFrame:
    """Wide label-by-metric table or long label, metric, value table of formatted numbers."""
    names = list(names or [c for c in metrics.columns if c not in (*keys, label)])
    if wide:
        return metrics.select(*keys, F.col(label).alias("label"), *[formatted_metric(F.col(c)).alias(c) for c in names])
    entries = F.array(*[F.struct(F.lit(c).alias("metric"), formatted_metric(F.col(c)).alias("value")) for c in names])
    return metrics.select(*keys, F.col(label).alias("label"), F.explode(entries).alias("e")).select(*keys, "label", "e.metric", "e.value")


def apply_metric_mask(pair: DataFrame, mask: DataFrame, on: Sequence[str] = (*IMAGE, *XYZ), src: str = "src",
                      tgt: str = "tgt") -> DataFrame:
    """Set both labels to 0 outside the mask before scoring."""
    marks = mask.where("mask <> 0").select(*on, F.lit(True).alias("_in"))
    joined = pair.join(marks, list(on), "left")
    inside = lambda c: F.when(F.col("_in"), F.col(c)).otherwise(F.lit(0)).alias(c)
    return joined.select(*on, inside(src), inside(tgt))
