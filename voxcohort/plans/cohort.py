"""Whole workflows over a cohort: quality control, validation scores, planning of outstanding work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxcohort.operators import quality
from voxcohort.sources import inventories, manifests

# What a validation record holds.
SUMMARY_REGIONS = ("WT", "TC", "ET")
SUMMARY_MEASURES = ("Dice", "Hausdorff95", "Sensitivity", "Specificity")

# The files of a subject folder, in the order in which they are compared, and what of their headers is.
QC_FILES = {"T1": "_t1.nii.gz", "T1CE": "_t1ce.nii.gz", "T2": "_t2.nii.gz", "FL": "_flair.nii.gz", "MASK": "_final_seg.nii.gz"}
PROPERTIES = ("size", "origin", "spacing")


def subject_summary(metrics: DataFrame, keys: Sequence[str] = ("subject", "arch")) -> DataFrame:
    """One record per subject and architecture with a column for each region and measure."""
    names = [f"{r}_{m}" for r in SUMMARY_REGIONS for m in SUMMARY_MEASURES]
    kept = metrics.where(F.col("region").isin(*SUMMARY_REGIONS) & F.col("measure").isin(*SUMMARY_MEASURES))
    named = kept.withColumn("_name", F.concat_ws("_", "region", "measure"))
    return named.groupBy(*keys).pivot("_name", names).agg(F.first("value"))


def cohort_qc(files: DataFrame, meta: DataFrame, label_counts: DataFrame, candidates: DataFrame) -> DataFrame:
    """Issues of a cohort as (subject_id, problem, detail, counted), one subject folder after the other:

    1. Four scans or all five files must be there; if not, nothing else of the subject is looked at.
    2. Every further file must share dimension, size, origin and spacing with the first, which must be a standard scan.
    3. In the label map a largest label 3 stands for 4; other labels than the allowed ones may cover few voxels only.
    4. Where the label map is absent or has such labels, the folder of candidate maps must exist; if no fused map of it passes,
       the failing ones are listed. Where the label map is absent the best passing one is recommended.

    ``files`` has subject_id, path; ``meta`` the headers of the same paths; ``label_counts`` subject_id, label, voxels of the
    label maps; ``candidates`` subject_id, name, passed of the maps in the candidate folders. ``counted`` is 1 where the row adds
    to the number of problems. One row a subject meets its labels and candidates; only issues become rows.
    """
    header = F.struct("path", *PROPERTIES)
    listed = files.select("subject_id", "path").join(meta.select("path", *PROPERTIES), "path", "left")
    slot = {name: F.max(F.when(F.col("path").endswith(suffix), header)).alias(name) for name, suffix in QC_FILES.items()}
    subjects = listed.groupBy("subject_id").agg(*slot.values())
    relabelled = F.when((F.max("label").over(Window.partitionBy("subject_id")) == 3) & (F.col("label") == 3), 4).otherwise(F.col("label"))
    merged = label_counts.withColumn("label", relabelled).groupBy("subject_id", "label").agg(F.sum("voxels").alias("voxels"))
    entry = F.concat_ws(": ", F.col("label").cast("string"), F.col("voxels").cast("string"))
    strange = quality.unexpected_labels(merged, keys=["subject_id"]).groupBy("subject_id").agg(
        F.array_sort(F.collect_list(F.struct("label", entry.alias("detail")))).alias("strange"))
    fused = F.lower("name").contains("fused")
    folders = candidates.groupBy("subject_id").agg(F.array_sort(F.collect_set(F.when(fused & ~F.col("passed"), F.col("name")))).alias("failing"),
                                                   F.coalesce(F.bool_or(fused & F.col("passed")), F.lit(False)).alias("passing"))
    advice = quality.recommend_fusion(candidates.where(fused))
    state = subjects.join(strange, "subject_id", "left").join(folders, "subject_id", "left").join(advice, "subject_id", "left")

    row = lambda problem, detail="", counted=1: F.struct(
        (problem if isinstance(problem, Column) else F.lit(problem)).alias("problem"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail"),
        (counted if isinstance(counted, Column) else F.lit(counted)).cast("int").alias("counted"))
    none = F.array().cast("array<struct<problem:string,detail:string,counted:int>>")
    held = sum((F.col(name).isNotNull().cast("int") for name in QC_FILES), F.lit(0))
    mask = F.col("MASK").isNotNull()
    complete = (held == 5) | ((held == 4) & ~mask)
    first = F.coalesce(*[F.when(F.col(name).isNotNull(), F.struct(F.lit(name).alias("slot"), F.col(name).alias("file"))) for name in QC_FILES])
    standard = F.array(*map(F.lit, quality.STANDARD_SIZE))

    def geometry(name: str) -> Column:
        a, b = first["file"], F.col(name)
        differs = ((a["size"].cast("array<int>") != standard) | (F.size(b["size"]) != 3)
                   | (a["size"] != b["size"]) | (a["origin"] != b["origin"]) | (a["spacing"] != b["spacing"]))
        text = F.concat(F.lit("Image_dimension/size/origin/spacing_mismatch_between_"), first["slot"], F.lit(f"_and_{name}"))
        return F.when(b.isNotNull() & (first["slot"] != name) & differs, row("geometry", text))

    unusual = F.transform(F.coalesce("strange", F.array()), lambda e, i: row("unexpected label", e["detail"], (i == 0).cast("int")))
    bad = mask & (F.size(unusual) > 0)
    folder = F.col("failing").isNotNull()
    spoilt = F.transform(F.coalesce("failing", F.array().cast("array<string>")), lambda name: row("unusable fused map", name, 0))
    lines = F.concat(
        F.array_compact(F.array(*[geometry(name) for name in QC_FILES])), F.when(bad, unusual).otherwise(none),
        F.when((bad | ~mask) & folder & ~F.col("passing"), spoilt).otherwise(none),
        F.when((bad | ~mask) & ~folder, F.array(row("SegmentationsForQC_folder_is_absent"))).otherwise(none),
        F.when(~mask & folder, F.array(row("recommended fusion", F.coalesce("recommended", F.lit(quality.FUSION_FALLBACK))))).otherwise(none))
    issues = F.when(complete, lines).otherwise(F.array(row("All_required_modalities_are_not_present")))
    return state.select("subject_id", F.explode(issues).alias("_i")).select("subject_id", "_i.problem", "_i.detail", "_i.counted")


def problem_count(report: DataFrame) -> DataFrame:
    """Number of problems of a cohort."""
    return report.agg(F.coalesce(F.sum("counted"), F.lit(0)).alias("problem_cases"))


def preparation_plan(manifest: DataFrame, outputs: DataFrame, names: Sequence[str] = ("{id}_brain_t1.nii.gz", "{id}_t1.nii.gz")) -> DataFrame:
    """Subjects of a manifest whose outputs exist under none of the given names."""
    columns = {}
    for i, pattern in enumerate(names):
        before, after = pattern.split("{id}")
        columns[f"_name{i}"] = F.concat(F.lit(before), F.col("ID"), F.lit(after))
    return inventories.pending_work(manifest.withColumns(columns), outputs, list(columns)).drop(*columns)


def validation_scores(statistics: DataFrame, hausdorff: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """Long score table from region statistics and surface distances, merged with stored scores.

    Both inputs have subject, arch, region; stored scores win where they are complete.
    """
    joined = statistics.join(hausdorff, ["subject", "arch", "region"], "left")
    measures = {"Dice": "dice", "Hausdorff95": "hausdorff95", "Sensitivity": "sensitivity", "Specificity": "specificity"}
    entries = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(c).alias("value")) for m, c in measures.items()])
    long = joined.where(F.col("region").isin(*SUMMARY_REGIONS)).select("subject", "arch", "region", F.explode(entries).alias("e"))
    scores = long.select("subject", "arch", "region", "e.measure", "e.value")
    return scores if cache is None else manifests.merge_cached_metrics(scores, cache).drop("origin")
