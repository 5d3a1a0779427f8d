"""Feature tables, targets, scaling and linear models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import functions as MF
from pyspark.ml.classification import LinearSVC, LinearSVCModel
from pyspark.ml.feature import PCA
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxcohort.operators import joins
from voxcohort.operators.ordering import running_position
from voxcohort.session import attach

XYZ = ["x", "y", "z"]
SUBJECT = ["subject_id"]
MODALITIES = ("T1", "T1GD", "T2", "FLAIR")


def voxel_features(indices: DataFrame, images: DataFrame, modalities: Sequence[str] = MODALITIES, series: DataFrame | None = None,
                   targets: DataFrame | None = None, keys: Sequence[str] = SUBJECT) -> DataFrame:
    """Rounded intensities of each modality at the given indices, one column per modality.

    ``images`` has modality and value; a ``series`` adds its rounded values in time order, and
    ``targets`` the distance to the nearest target voxel.
    """
    on = [*keys, *XYZ]
    wide = images.where(F.col("modality").isin(*modalities)).join(indices.select(*on), on, "left_semi").groupBy(*on).agg(
        *[F.round(F.max(F.when(F.col("modality") == m, F.col("value")))).alias(m) for m in modalities])
    table = indices.join(wide, on, "left")
    if series is not None:
        ordered = F.array_sort(F.collect_list(F.struct("t", F.round("value").alias("v"))))
        curves = series.join(indices.select(*on), on, "left_semi").groupBy(*on).agg(F.transform(ordered, lambda s: s["v"]).alias("curve"))
        table = table.join(curves, on, "left")
    if targets is not None:
        table = table.join(joins.distance_to_set(indices, targets, keys), on, "left")
    return table


def near_far_training(near: DataFrame, far: DataFrame) -> DataFrame:
    return near.withColumn("label", F.lit(0.0)).unionByName(far.withColumn("label", F.lit(1.0)))


def balance_by_stride(train: DataFrame, order: str, label: str = "label") -> DataFrame:
    """All near rows (label 0) and every k-th far row by ``order``, with k the whole ratio of far to near."""
    counts = train.agg(F.count_if(F.col(label) == 0).alias("near"), F.count_if(F.col(label) == 1).alias("far")).first()
    step = max(counts["far"] // counts["near"], 1) if counts["near"] else 1
    near, far = train.where(F.col(label) == 0), train.where(F.col(label) == 1)
    kept = running_position(far, order, name="_pos").where(F.col("_pos") % step == 0).drop("_pos")
    return near.unionByName(kept)


def survival_targets(df: DataFrame, months: str = "months") -> DataFrame:
    """Two targets, short (up to 6 months) and long (up to 18); class 0 rows come first."""
    split = lambda limit: F.when(F.col(months) <= limit, 0).otherwise(1)
    return df.withColumns({"target_6": split(6), "target_18": split(18)})


def pseudoprogression_targets(df: DataFrame, score: str = "score") -> DataFrame:
    """First target: 0 for scores 1 and 2; second target: 0 for scores 5 and 6."""
    zero = lambda *scores: F.when(F.col(score).isin(*scores), 0).otherwise(1)
    return df.withColumns({"target_low": zero(1, 2), "target_high": zero(5, 6)})


def mutation_target(df: DataFrame, status: str = "status") -> DataFrame:
    return df.withColumn("target", F.when(F.col(status) == 1, 0).otherwise(1))


def subtype_one_vs_rest(df: DataFrame, subtype: str = "subtype") -> DataFrame:
    """One binary target per subtype 1 to 4; anything else counts as subtype 3."""
    known = F.when(F.col(subtype).isin(1, 2, 3, 4), F.col(subtype)).otherwise(3)
    return df.withColumns({f"target_{k}": (known == k).cast("int") for k in (1, 2, 3, 4)})


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))


# --- scaling and projection -------------------------------------------------------------------

def scale_fit(df: DataFrame, features: str = "features") -> DataFrame:
    """Mean and sample deviation of each feature: feature, mean, std."""
    parts = df.select(F.posexplode(features).alias("feature", "value"))
    return parts.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def _with_model(df: DataFrame, model: DataFrame, *columns: str) -> DataFrame:
    """Add the per-feature table as one sorted array column ``_model``."""
    row = model.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("_model")).withColumn("_all", F.lit(1))
    return attach(df.withColumn("_all", F.lit(1)), row, ["_all"]).drop("_all")


def scale_transform(df: DataFrame, model: DataFrame, features: str = "features") -> DataFrame:
    """Z-scores by a fitted model; a feature with zero deviation becomes 0.

    The model becomes one row with an array as long as the vector.
    """
    joined = _with_model(df, model, "feature", "mean", "std")
    scaled = F.zip_with(features, "_model", lambda v, m: F.coalesce(F.try_divide(v - m["mean"], m["std"]), F.lit(0.0)))
    return joined.withColumn(features, scaled).drop("_model")


def feature_count(df: DataFrame, features: str = "features") -> int:
    """Length of the feature vectors, the number of components of full rank."""
    return df.select(F.max(F.size(features))).first()[0] or 0


def pca_fit(df: DataFrame, k: int, features: str = "features"):
    """Principal components by the distributed covariance; features are centred by their mean first."""
    means = scale_fit(df, features)
    vectors = centre(df, means, features).select(MF.array_to_vector(features).alias("_v"))
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(vectors), means


def centre(df: DataFrame, means: DataFrame, features: str = "features") -> DataFrame:
    """Subtract the training mean of each feature."""
    return _with_model(df, means, "feature", "mean").withColumn(features, F.zip_with(features, "_model", lambda v, m: v - m["mean"])).drop("_model")


def component_signs(model) -> list[int]:
    """Sign of each component that makes its largest loading positive."""
    loadings = model.pc.toArray()
    return [1 if column[abs(column).argmax()] >= 0 else -1 for column in loadings.T]


def pca_loadings(spark, fitted) -> DataFrame:
    """(component, feature, loading, mean) of fitted components: as many rows as the square of the vector length.

    The largest loading of every component is positive.
    """
    model, means = fitted
    loadings, signs = model.pc.toArray(), component_signs(model)
    rows = [(c, f, float(loadings[f, c] * signs[c])) for f in range(loadings.shape[0]) for c in range(loadings.shape[1])]
    table = spark.createDataFrame(rows, "component int, feature int, loading double")
    return table.join(means.select("feature", "mean"), "feature").select("component", "feature", "loading", "mean")


def project(df: DataFrame, loadings: DataFrame, features: str = "features", output: str = "projected") -> DataFrame:
    """Project vectors by a table of loadings, as ``pca_loadings`` makes it or a saved model holds it."""
    by_component = loadings.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("feature", "loading", "mean"))).alias("_l"))
    row = by_component.agg(F.array_sort(F.collect_list(F.struct("component", "_l"))).alias("_model")).withColumn("_all", F.lit(1))
    joined = attach(df.withColumn("_all", F.lit(1)), row, ["_all"])
    part = lambda c: F.aggregate(F.zip_with(features, c["_l"], lambda v, l: (v - l["mean"]) * l["loading"]), F.lit(0.0), lambda s, x: s + x)
    return joined.withColumn(output, F.transform("_model", part)).drop("_all", "_model")


def pca_transform(df: DataFrame, fitted, features: str = "features", output: str = "projected") -> DataFrame:
    """Project centred vectors; the largest loading of every component is positive."""
    model, means = fitted
    centred = centre(df.withColumn("_orig", F.col(features)), means, features).withColumn("_v", MF.array_to_vector(features))
    signs = F.array(*[F.lit(float(s)) for s in component_signs(model)])
    projected = model.transform(centred).withColumn(output, F.zip_with(MF.vector_to_array("_p"), signs, lambda v, s: v * s))
    return projected.withColumn(features, F.col("_orig")).drop("_v", "_p", "_orig")


def transpose(cells: DataFrame, row: str = "row", col: str = "col") -> DataFrame:
    """Swap the two indices of a matrix in cell form."""
    return cells.withColumnsRenamed({row: "_r", col: row}).withColumnRenamed("_r", col)


# --- classification ---------------------------------------------------------------------------

def svm_fit(df: DataFrame, label: str = "label", features: str = "features", cost: float = 1.0, iterations: int = 100) -> LinearSVCModel:
    """Linear support vector classifier; the cost is turned into a ridge parameter 1 / (cost * rows)."""
    vectors = df.select(F.col(label).cast("double").alias("label"), MF.array_to_vector(features).alias("_v"))
    rows = vectors.count()
    return LinearSVC(featuresCol="_v", labelCol="label", regParam=1.0 / (cost * max(rows, 1)), maxIter=iterations, standardization=False).fit(vectors)


def svm_score(df: DataFrame, model: LinearSVCModel, features: str = "features", negative_label: float = 0.0) -> DataFrame:
    """Predicted label and score = |raw margin| * predicted label (``negative_label`` for the first class)."""
    scored = model.transform(df.withColumn("_v", MF.array_to_vector(features)))
    margin = MF.vector_to_array("rawPrediction")[1]
    predicted = F.when(F.col("prediction") == 1.0, F.lit(1.0)).otherwise(F.lit(float(negative_label)))
    return scored.withColumns({"predicted": predicted, "score": F.abs(margin) * predicted}).drop("_v", "rawPrediction", "prediction")


def train_val_split(subjects: DataFrame, fraction: float = 0.8, seed: int = 42, key: str = "subject_id") -> DataFrame:
    """Stable split by the first 28 bits of the md5 of seed and subject: the same subject always lands on the same side."""
    bucket = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 7), 16, 10).cast("long") % 1_000_000
    return subjects.withColumn("split", F.when(bucket < int(fraction * 1_000_000), "train").otherwise("validation"))


def first_class_first(df: DataFrame, target: str, *then: str | Column) -> DataFrame:
    """Order with the rows of class 0 ahead."""
    return df.orderBy(target, *then)
