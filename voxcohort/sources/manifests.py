"""Readers and writers of cohort manifests, labelled image lists, matrices and score files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxcohort.operators.ordering import number_lines, running_position

# Header spellings of the manifest columns, after lower-casing.
MANIFEST_ALIASES = {
    "ID": ("patientid", "subjectid", "subject", "subid"),
    "T1GD": ("t1gd", "t1ce", "t1post"),
    "T1": ("t1", "t1pre"),
    "T2": ("t2",),
    "FLAIR": ("t2flair", "flair", "fl"),
}


def manifest_columns(headers: Sequence[str], strip_separators: bool = True) -> dict[str, str]:
    """Header of each manifest column; every one of the five must be found exactly once."""
    found: dict[str, list[str]] = {name: [] for name in MANIFEST_ALIASES}
    for header in headers:
        plain = header.strip().lower()
        if strip_separators:
            plain = plain.replace("-", "").replace("_", "")
        for name, spellings in MANIFEST_ALIASES.items():
            if plain in spellings or (name == "FLAIR" and "fl" in plain):
                found[name].append(header)
    wrong = [name for name, headers_of in found.items() if len(headers_of) != 1]
    if wrong:
        raise ValueError(f"manifest needs exactly one column for each of {', '.join(wrong)}")
    return {name: headers_of[0] for name, headers_of in found.items()}


def resolve_manifest(raw: DataFrame, strip_separators: bool = True) -> DataFrame:
    """Rename the columns to ID, T1GD, T1, T2, FLAIR. A cell with a space stops the job that reads it."""
    chosen = manifest_columns(raw.columns, strip_separators)

    def checked(header: str) -> Column:
        cell = F.col(f"`{header}`").cast("string")
        message = F.concat(F.lit(f"space in column {header}: "), cell)
        return F.when(F.contains(cell, F.lit(" ")), F.raise_error(message).cast("string")).otherwise(cell)

    return raw.select(*[checked(header).alias(name) for name, header in chosen.items()])


def read_manifest(spark: SparkSession, path: str, strip_separators: bool = True) -> DataFrame:
    return resolve_manifest(spark.read.csv(path, header=True), strip_separators)


def labeled_rows(raw: DataFrame, image_cols: Sequence[str], label_cols: Sequence[str] = (), prefix: str = "") -> DataFrame:
    """Rows as ``images`` and numeric ``labels``.

    Without named labels every column after the last image column is a label; without any the label
    is 1. Text that is not a number counts as 0. Relative paths get the prefix.
    """
    order = {name: i for i, name in enumerate(raw.columns)}
    last = max(order[c] for c in image_cols)
    labels = list(label_cols) or [c for c in raw.columns if order[c] > last]

    def path(name: str) -> Column:
        cell = F.replace(F.col(f"`{name}`").cast("string"), F.lit('"'), F.lit(""))
        return F.when(cell.startswith("/") | F.lit(not prefix), cell).otherwise(F.concat(F.lit(prefix), cell))

    def number(name: str) -> Column:
        # like C's atof: the longest numeric beginning counts
        cell = F.replace(F.col(f"`{name}`").cast("string"), F.lit('"'), F.lit(""))
        start = F.regexp_extract(cell, r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)", 1)
        return F.coalesce(start.try_cast("double"), F.lit(0.0))

    values = F.array(*[number(c) for c in labels]) if labels else F.array(F.lit(1.0))
    kept = [c for c in raw.columns if c not in (*image_cols, *labels)]
    return raw.select(*[F.col(f"`{c}`") for c in kept], F.array(*[path(c) for c in image_cols]).alias("images"), values.alias("labels"))


def read_labeled_csv(spark: SparkSession, path: str, image_cols: Sequence[str], label_cols: Sequence[str] = (), prefix: str = "") -> DataFrame:
    return labeled_rows(spark.read.csv(path, header=True), image_cols, label_cols, prefix).select("images", "labels")


def matrix_cells(lines: DataFrame, line: str = "line", text: str = "value", as_text: bool = False) -> DataFrame:
    """Cells of numbered CSV lines as (row, col, value)."""
    cells = lines.select(F.col(line).alias("row"), F.posexplode(F.split(F.regexp_replace(text, "\r", ""), ",")).alias("col", "value"))
    return cells if as_text else cells.withColumn("value", F.coalesce(F.trim("value").try_cast("double"), F.lit(0.0)))


def read_matrix(spark: SparkSession, path: str, as_text: bool = False) -> DataFrame:
    """Headerless CSV as (row, col, value) cells. ``matrix_vectors`` turns them into row or column vectors."""
    return matrix_cells(number_lines(spark.read.text(path)), as_text=as_text)


def matrix_vectors(cells: DataFrame, column_major: bool = False) -> DataFrame:
    """One vector per row, or per column, in the order of the other index."""
    by, along = ("col", "row") if column_major else ("row", "col")
    ordered = F.array_sort(F.collect_list(F.struct(along, "value")))
    return cells.groupBy(by).agg(F.transform(ordered, lambda c: c["value"]).alias("vector"))


def matrix_table(cells: DataFrame, columns: Sequence[str], row: str = "row", col: str = "col", value: str = "value") -> DataFrame:
    """Wide text table with six decimals: a blank first header, row ids first, one column per id."""
    wide = cells.groupBy(F.col(row).cast("string").alias(" ")).pivot(col, list(columns)).agg(F.first(value))
    return wide.select("` `", *[F.format_string("%.6f", F.col(f"`{c}`")).alias(str(c)) for c in columns])


def write_matrix(cells: DataFrame, columns: Sequence[str], path: str, header: bool = True, vertical: bool = True, **names) -> None:
    """Write the wide table; without header also the row ids are left out. ``vertical=False`` swaps rows and columns."""
    if not vertical:
        names = {"row": names.get("col", "col"), "col": names.get("row", "row"), "value": names.get("value", "value")}
    table = matrix_table(cells, columns, **names)
    (table if header else table.drop(" ")).write.csv(path, header=header)


def split_index(lines: DataFrame, order: str = "line", text: str = "value") -> DataFrame:
    """Number all CSV cells of the lines 0, 1, ... after the header cell, which is the very first one."""
    cells = F.split(F.regexp_replace(text, "\r", ""), ",")
    placed = running_position(lines.select(F.col(order), cells.alias("cells")), order, F.size("cells").cast("long"), "before")
    numbered = placed.select("before", F.posexplode("cells").alias("pos", "cell"))
    return numbered.select((F.col("before") + F.col("pos") - 1).alias("index"), "cell").where("index >= 0")


# --- score files ------------------------------------------------------------------------------

# The scores that make a cached record complete.
REQUIRED = tuple((r, m) for r in ("WT", "TC", "ET") for m in ("Dice", "Hausdorff95", "Sensitivity", "Specificity"))


def merge_cached_metrics(new: DataFrame, cache: DataFrame, keys: Sequence[str] = ("subject", "arch"),
                         required: Sequence[tuple[str, str]] = REQUIRED) -> DataFrame:
    """Cached scores where a key has all of the required ones, else the new ones; cache-only keys stay.

    Both tables are long: keys, region, measure, value.
    """
    keys = list(keys)
    needed = F.array(*[F.lit(f"{r}.{m}") for r, m in required])
    name = F.concat_ws(".", "region", "measure")
    tagged = cache.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    # the few scores of a key meet once
    record = Window.partitionBy(*keys)
    have = F.size(F.collect_set(F.when((F.col("_side") == 0) & F.array_contains(needed, name), name)).over(record))
    use_cache = (have == len(required)) | (F.max("_side").over(record) == 0)
    return tagged.withColumn("_take", F.when(use_cache, 0).otherwise(1)).where("_side = _take").select(
        *keys, "region", "measure", "value", F.when(F.col("_take") == 0, "cache").otherwise("new").alias("origin"))


def validation_tree(metrics: DataFrame) -> DataFrame:
    """One JSON document per subject: architecture → region → measure → value with six decimals."""
    return _validation_maps(metrics).select("subject", F.to_json("tree").alias("json"))


def _validation_maps(metrics: DataFrame) -> DataFrame:
    """One row (subject, tree) per subject. Each level collects only the few entries of its parent; rows are dealt by subject once,
    which serves all levels, as a document is whole by its nature.
    """
    def level(df: DataFrame, keys: list[str], key: str, value: str, name: str) -> DataFrame:
        by_key = lambda a, b: F.when(a[key] < b[key], -1).when(a[key] > b[key], 1).otherwise(0)
        entries = F.array_sort(F.collect_list(F.struct(key, value)), by_key)
        return df.groupBy(*keys).agg(F.map_from_entries(entries).alias(name))

    text = metrics.repartition("subject").withColumn("value", F.format_string("%.6f", "value"))
    measures = level(text, ["subject", "arch", "region"], "measure", "value", "measures")
    regions = level(measures, ["subject", "arch"], "region", "measures", "regions")
    return level(regions, ["subject"], "arch", "regions", "tree")


def write_validation(metrics: DataFrame, path: str) -> None:
    _validation_maps(metrics).select(F.to_json(F.struct("subject", F.col("tree").alias("scores"))).alias("value")).write.text(path)


# --- model tables -----------------------------------------------------------------------------

def save_model_tables(path: str, scaling: DataFrame, pca: DataFrame | None = None, flags: dict[str, bool] | None = None) -> None:
    """Scaling (feature, mean, std), PCA loadings (component, feature, loading, mean) and modality flags."""
    scaling.write.mode("errorifexists").parquet(f"{path}/scaling")
    if pca is not None:
        pca.write.mode("errorifexists").parquet(f"{path}/pca")
    if flags:
        spark = scaling.sparkSession
        rows = [(name, bool(used)) for name, used in flags.items()]
        spark.createDataFrame(rows, "modality string, used boolean").write.mode("errorifexists").parquet(f"{path}/flags")


def load_model_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that ``save_model_tables`` wrote, under the same names."""
    schemas = {"scaling": "feature int, mean double, std double", "pca": "component int, feature int, loading double, mean double",
               "flags": "modality string, used boolean"}
    return {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in schemas.items() if _exists(spark, f"{path}/{name}")}


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
