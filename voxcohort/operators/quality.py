"""Quality control of geometry, labels and completeness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxcohort.operators import regions
from voxcohort.operators.statistics import label_counts
from voxcohort.session import attach, fits_broadcast, join_summary, settle

IMAGE = ["image_id"]
XYZ = ["x", "y", "z"]

# The standard scan size, the allowed labels, the size limits and the fusion order.
STANDARD_SIZE = (240, 240, 155)
ALLOWED_LABELS = (0, 1, 2, 4)
UNEXPECTED_VOXELS = 1000
REPAIRABLE_VOXELS = 5000
FUSION_ORDER = ("staple", "itkvoting", "majorityvoting")
FUSION_FALLBACK = "nnunet_or_deepscan"
PROPERTIES = ("direction", "size", "origin", "spacing")


def _differs(a: Column, b: Column, percent: float) -> Column:
    """Relative difference in percent of the larger magnitude; two zeros are equal."""
    largest = F.greatest(F.abs(a), F.abs(b))
    return F.coalesce(F.abs(a - b) / F.when(largest > 0, largest) * 100 > percent, F.lit(False))


def property_mismatch(name: str, a: Column, b: Column, percent: float = 0.0) -> Column:
    """True where the arrays differ in length, or some element by more than the tolerance."""
    if name == "direction":
        a, b = F.flatten(a), F.flatten(b)
    unequal = F.exists(F.zip_with(a.cast("array<double>"), b.cast("array<double>"),
                                  lambda p, q: F.coalesce(_differs(p, q, percent), F.lit(True))), lambda v: v)
    return (F.size(a) != F.size(b)) | unequal


def geometry_check(pairs: DataFrame, tolerance: Mapping[str, float] | None = None, a: str = "a", b: str = "b") -> DataFrame:
    """Add ``same_space`` and the list of mismatching properties to pairs of header structs."""
    tolerance = tolerance or {}
    flags = [F.when(property_mismatch(p, F.col(a)[p], F.col(b)[p], tolerance.get(p, 0.0)), F.lit(p)) for p in PROPERTIES]
    listed = F.concat_ws(", ", *flags)
    return pairs.withColumns({"mismatch": listed, "same_space": listed == ""})


def _header(df: DataFrame) -> Column:
    return F.struct(*[F.col(p) for p in PROPERTIES if p in df.columns])


def pair_with_first(meta: DataFrame, subject: str = "subject_id", path: str = "path") -> DataFrame:
    """Every header of a subject next to the header of its first path."""
    header = _header(meta)
    first = meta.groupBy(subject).agg(F.min_by(header, path).alias("a"))
    return attach(meta.select(subject, path, header.alias("b")), first, [subject])


def space_against_first(meta: DataFrame, subject: str = "subject_id", path: str = "path") -> DataFrame:
    """Standard-space check of each file against the first one of its subject."""
    pairs = pair_with_first(meta, subject, path)
    return standard_space_check(pairs).select(subject, path, "mismatch")


def standard_space_check(pairs: DataFrame, a: str = "a", b: str = "b", size: Sequence[int] = STANDARD_SIZE) -> DataFrame:
    """Mismatch text: not the standard 3-D size, or Size, Origin, Spacing different from the target."""
    standard = F.array(*[F.lit(s) for s in size])
    wrong = F.when(F.col(b)["size"].cast("array<int>") != standard, F.lit("NotStandardSize"))
    others = [F.when(property_mismatch(p, F.col(a)[p], F.col(b)[p]), F.lit(p.capitalize())) for p in ("size", "origin", "spacing")]
    return pairs.withColumn("mismatch", F.concat_ws(", ", wrong, *others))


def unexpected_labels(counts: DataFrame, allowed: Sequence[int] = ALLOWED_LABELS, min_count: int = UNEXPECTED_VOXELS,
                      keys: Sequence[str] = IMAGE, label: str = "label") -> DataFrame:
    """Labels that are not allowed and cover more than ``min_count`` voxels, from label counts."""
    return counts.where(~F.col(label).isin(*allowed) & (F.col("voxels") > min_count)).select(*keys, label, "voxels")


def unexpected_labels_of(labelmap: DataFrame, **options) -> DataFrame:
    return unexpected_labels(label_counts(labelmap), **options)


def modality_completeness(files: DataFrame, path: str = "path", subject: str = "subject_id") -> DataFrame:
    """Problem text of each subject: fewer than four scans, or four of which one is the mask."""
    name = F.lower(path)
    slot = F.regexp_extract(name, r"_(t1ce|t1gd|t1|t2|flair|fl)\.nii\.gz$", 1)
    merged = F.when(slot == "t1gd", "t1ce").when(slot == "fl", "flair").when(slot != "", slot)
    found = files.groupBy(subject).agg(F.count_distinct(merged).alias("scans"), F.bool_or(name.endswith("_final_seg.nii.gz")).alias("mask"))
    total = F.col("scans") + F.col("mask").cast("long")
    return found.select(subject, "scans", "mask",
                        F.when(total < 4, "fewer than 4 files").when((total == 4) & F.col("mask"), "mask instead of scan").otherwise("").alias("problem"))


def recommend_fusion(candidates: DataFrame, keys: Sequence[str] = ("subject_id",), name: str = "name", passed: str = "passed") -> DataFrame:
    """Best fused map that passes the label check: by fixed priority, else the fallback."""
    text = F.lower(name)
    rank = F.lit(None).cast("int")
    for i, method in reversed(list(enumerate(FUSION_ORDER))):
        rank = F.when(F.contains(text, F.lit(method)), F.lit(i)).otherwise(rank)
    best = F.min(F.when(F.col(passed), rank))
    method = F.lit(FUSION_FALLBACK)
    for i, name_of in enumerate(FUSION_ORDER):
        method = F.when(best == i, F.lit(name_of)).otherwise(method)
    return candidates.groupBy(*keys).agg(method.alias("recommended"))


def negative_components(image: DataFrame, keys: Sequence[str] = IMAGE, value: str = "value") -> DataFrame:
    """Size of the largest connected blob of negative voxels of each image that has any."""
    components = regions.connected_components(image.where(F.col(value) < 0).select(*keys, *XYZ), keys)
    return regions.component_sizes(components, keys).groupBy(*keys).agg(F.max("voxels").alias("largest"))


def negative_intensity_check(image: DataFrame, limit: int = REPAIRABLE_VOXELS, keys: Sequence[str] = IMAGE, value: str = "value") -> DataFrame:
    """Images whose largest negative blob is too large to repair."""
    return negative_components(image, keys, value).where(F.col("largest") >= limit)


def repair_negatives(image: DataFrame, limit: int = REPAIRABLE_VOXELS, keys: Sequence[str] = IMAGE, value: str = "value") -> DataFrame:
    """Lift the non-zero voxels of images whose negative blobs are small; other images stay as they are."""
    keys = list(keys)
    small = settle(negative_components(image, keys, value).where(F.col("largest") < limit).select(*keys))
    repairable = join_summary(image, small, keys, "left_semi", fits_broadcast(small))
    low = repairable.groupBy(*keys).agg(F.min(value).alias("_min"))
    joined = attach(image, low, keys, "left")
    lifted = F.when((F.col("_min") < 0) & (F.col(value) != 0), F.col(value) - F.col("_min")).otherwise(F.col(value))
    return joined.withColumn(value, lifted).drop("_min")
