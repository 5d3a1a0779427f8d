"""Inventories over file listings and image headers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxcohort.session import attach

# Which words in a file name stand for which modality, in the order they are tried.
MODALITY_WORDS = (
    ("T1CE", ("t1ce", "t1gd", "t1gad", "t1-ce", "t1-gd", "t1-gad")),
    ("T1", ("t1",)),
    ("T2", ("t2",)),
    ("FLAIR", ("flair",)),
    ("DTI", ("dti", "b0")),
    ("RAD", ("radial", "rad")),
    ("AX", ("axial", "ax")),
    ("FA", ("fractional", "fa")),
    ("TR", ("trace", "tr")),
    ("RCBV", ("rcbv",)),
    ("PSR", ("psr",)),
    ("PH", ("ph",)),
    ("PERFUSION", ("perf", "dsc")),
    ("CT", ("ct2pet", "ct")),
    ("PET", ("pet",)),
    ("SEG", ("labelmap", "label-map", "segmentation", "annotation", "label", "roi")),
)

# The stricter forms for base names, next to an underscore, before the extension, or anywhere.
STRICT_WORDS = (
    ("T1CE", ("t1ce", "t1-gad", "t1-ce", "t1-gd", "_t1gd", "t1gd_", "t1gd.nii.gz")),
    ("T1", ("_t1", "t1_", "t1.nii.gz")),
    ("T2", ("_t2", "t2_", "t2.nii.gz")),
    ("FLAIR", ("_flair", "flair_", ".flair.", "flair.nii.gz", "fl.nii.gz")),
    ("DTI", ("_dti", "dti_", "_b0", "b0_")),
    ("RAD", ("_rad", "rad_", "radial_", "radial.nii.gz", "rad.nii.gz")),
    ("AX", ("_ax", "ax_", "axial_", "axial.nii.gz", "ax.nii.gz")),
    ("FA", ("_fa", "fa_", "_fractional", "fractional_", "fractional.nii.gz", "fa.nii.gz")),
    ("TR", ("_tr", "tr_", "trace_", "trace.nii.gz", "tr.nii.gz")),
    ("RCBV", ("rcbv",)),
    ("PSR", ("psr",)),
    ("PH", ("ph",)),
    ("PERFUSION", ("perf",)),
    ("SEG", ("label", "segmentation")),
    ("CT", ("ct2pet", "_ct.")),
    ("PET", ("_pet", "pet_")),
)

# File name endings of the four scans.
SLOT_SUFFIXES = {"T1GD": ("t1ce", "t1gd"), "T1": ("t1",), "T2": ("t2",), "FLAIR": ("flair", "fl")}


def _contains_any(text: Column, words: Sequence[str]) -> Column:
    hit = F.contains(text, F.lit(words[0]))
    for word in words[1:]:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def guess_modality(path: Column, strict: bool = False) -> Column:
    """Modality by the first matching words of a name; a T2 name that also says flair is FLAIR.

    ``strict`` looks at the base name only and wants most words delimited.
    """
    text = F.lower(base_name(path) if strict else path)
    result = None
    for modality, words in STRICT_WORDS if strict else MODALITY_WORDS:
        value = F.lit(modality)
        if modality == "T2":
            value = F.when(F.contains(text, F.lit("flair")), "FLAIR").otherwise("T2")
        hit = _contains_any(text, words)
        result = F.when(hit, value) if result is None else result.when(hit, value)
    return result.otherwise("UNDEFINED")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """Extension with its dot; ".nii.gz" counts as one; empty if there is none."""
    return F.regexp_extract(base_name(path), r"(\.nii\.gz|\.[^.]*)$", 1)


def image_catalogue(meta: DataFrame, name_contains: str = "", ext: str | None = None, props: Sequence[str] = ("spacing", "size", "origin"),
                    max_dims: int | None = None, path: str = "path") -> DataFrame:
    """File, Spacing_i, Size_i, Origin_i as text; an axis that an image lacks is empty.

    ``ext`` filters by extension ("noExt" for none, None for no filter).
    """
    kept = meta.where(F.contains(base_name(F.col(path)), F.lit(name_contains)))
    if ext is not None:
        kept = kept.where(extension(F.col(path)) == ("" if ext == "noExt" else ext))
    axes = max_dims or kept.agg(F.max("dims")).first()[0] or 0
    columns = [F.coalesce(F.try_element_at(p, F.lit(i + 1)).cast("string"), F.lit("")).alias(f"{p.capitalize()}_{i}")
               for p in props for i in range(axes)]
    return kept.select(F.col(path).alias("File"), *columns)


def image_information(meta: DataFrame, key: str = "image_id") -> DataFrame:
    """Property, Value rows of each header."""
    text = lambda c, sep: F.array_join(F.transform(c, lambda v: v.cast("string")), sep)
    voxels = F.aggregate("size", F.lit(1).cast("long"), lambda acc, v: acc * v)
    rows = F.transform("direction", lambda r: F.array_join(F.transform(r, lambda v: v.cast("string")), "x"))
    entries = {"Dimensions": F.col("dims").cast("string"), "Size": text("size", "x"), "Total": voxels.cast("string"),
               "Origin": text("origin", "x"), "Spacing": text("spacing", "x"), "Directions": F.array_join(rows, ";")}
    pairs = F.array(*[F.struct(F.lit(n).alias("Property"), v.alias("Value")) for n, v in entries.items()])
    return meta.select(key, F.explode(pairs).alias("e")).select(key, "e.Property", "e.Value")


def dicom_tags(df: DataFrame, key: str, tags: str = "tags") -> DataFrame:
    """All tags of each row: tag, label, value. Sort by tag where the order matters."""
    return df.select(key, F.explode(tags).alias("tag", "entry")).select(key, "tag", "entry.label", "entry.value")


def tag_value(df: DataFrame, tag: str, tags: str = "tags") -> DataFrame:
    """Look one tag up: found, and its label and value or empty text."""
    entry = F.try_element_at(tags, F.lit(tag))
    return df.withColumns({"found": entry.isNotNull(), "tag_label": F.coalesce(entry["label"], F.lit("")),
                           "tag_value": F.coalesce(entry["value"], F.lit(""))})


def subject_inventory(files: DataFrame, slots: Mapping[str, Sequence[str]] = SLOT_SUFFIXES, path: str = "path") -> DataFrame:
    """One row per subject folder with the first file of each slot, null where there is none."""
    subject = base_name(folder(F.col(path)))
    suffix = F.regexp_extract(F.lower(path), r"_([a-z0-9]+)\.nii\.gz$", 1)
    firsts = [F.min(F.when(suffix.isin(*words), F.col(path))).alias(slot) for slot, words in slots.items()]
    return files.where(subject != "logs").groupBy(subject.alias("subject_id")).agg(*firsts)


def missing_slots(inventory: DataFrame, required: Sequence[str] = tuple(SLOT_SUFFIXES)) -> DataFrame:
    """SubjectID, Modality for every absent slot; no join, the slots are columns of the inventory."""
    absent = F.array_compact(F.array(*[F.when(F.col(s).isNull(), F.lit(s)) for s in required]))
    return inventory.select(F.col("subject_id").alias("SubjectID"), F.explode(absent).alias("Modality"))


def qualified_subjects(files: DataFrame, required: Sequence[str], subject: str = "subject_id", kind: str = "kind") -> DataFrame:
    """Subjects that have all required kinds, sorted."""
    kinds = F.collect_set(F.when(F.col(kind).isin(*required), F.col(kind)))
    wanted = F.array(*[F.lit(r) for r in required])
    found = files.groupBy(subject).agg(kinds.alias("_kinds"))
    return found.where(F.size(F.array_except(wanted, "_kinds")) == 0).select(subject).orderBy(subject)


def pending_work(plan: DataFrame, outputs: DataFrame, names: Sequence[str], output: str = "output") -> DataFrame:
    """Planned items for which no output exists under any of their names."""
    for name in names:
        plan = plan.join(outputs.select(F.col(output).alias(name)).distinct(), name, "left_anti")
    return plan


def error_rollup(events: DataFrame, subject: str = "SubjectID", application: str = "Application", algorithm: str = "Algorithm",
                 failed: Column | None = None) -> DataFrame:
    """Failed algorithms per subject and application, as sorted text; the set is bounded by the algorithms."""
    failures = events if failed is None else events.where(failed)
    distinct = failures.select(subject, application, algorithm).distinct()
    return distinct.groupBy(subject, application).agg(F.array_join(F.array_sort(F.collect_list(algorithm)), ";").alias("Algorithms"))


def folder_sizes(files: DataFrame, path: str = "path", length: str = "length") -> DataFrame:
    """Bytes below each folder and all of its parents.

    Files are first summed per folder, so the parents are expanded for folders and not for files.
    """
    direct = files.groupBy(folder(F.col(path)).alias("folder")).agg(F.sum(length).alias("bytes"))
    parts = F.split("folder", "/")
    depths = F.sequence(F.lit(2), F.size(parts))
    parents = F.transform(depths, lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return direct.where("folder <> ''").select(F.explode(parents).alias("folder"), "bytes").groupBy("folder").agg(F.sum("bytes").alias("bytes"))


def fits_limit(files: DataFrame, limit: int, length: str = "length") -> DataFrame:
    return files.agg(F.sum(length).alias("bytes")).withColumn("fits", F.col("bytes") <= limit)


def series_check(slices: DataFrame, path: str = "path", series: str = "series") -> DataFrame:
    """Files with their folder, the number of series in it and the multiple-series flag, in list order.

    The listing stays as rows in a distributed sort, since a folder may hold any number of files.
    """
    listed = slices.withColumn("folder", folder(F.col(path)))
    counts = listed.groupBy("folder").agg(F.count_distinct(series).alias("series_count"))
    joined = attach(listed, counts, ["folder"]).withColumn("multiple_series", F.col("series_count") > 1)
    return joined.select("folder", series, path, "series_count", "multiple_series").orderBy("folder", series, path)
