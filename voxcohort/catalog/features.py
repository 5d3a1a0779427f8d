"""Feature tables, targets, scaling and linear models."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxcohort.catalog.registry import query, rounded
from voxcohort.operators import features as fe
from voxcohort.plans import derive as d
from voxcohort.session import ensure_checkpoint_dir
from voxcohort.sources.manifests import load_model_tables, save_model_tables

R = rounded


def _modal(t):
    """Images with modality and subject; the subject replaces the image in the key."""
    meta = d.image_meta(t).select("image_id", "subject_id", "modality")
    return fe.attach(d.voxels(t), meta, ["image_id"]).drop("image_id")


@query("voxel_features", d.with_ctes(d.VOXELS, d.CELLS, d.META, d.SERIES, """modal AS (SELECT subject_id, modality, x, y, z, value FROM voxels JOIN meta USING (image_id))""",
       """idx AS (SELECT DISTINCT subject_id, x, y, z FROM cells JOIN meta USING (image_id) WHERE d <= 6)""",
       """far AS (SELECT DISTINCT subject_id, x, y, z FROM cells JOIN meta USING (image_id) WHERE d > 50)""",
       """curve AS (SELECT subject_id, x, y, z, string_agg(CAST(round(value) AS VARCHAR), ',' ORDER BY t) AS curve FROM (SELECT subject_id, x, y, z, t, sum(value) AS value FROM series JOIN meta USING (image_id) GROUP BY ALL) GROUP BY ALL)""",
       f"""SELECT subject_id, x, y, z, coalesce(T1, -1) AS T1, coalesce(T1GD, -1) AS T1GD, coalesce(T2, -1) AS T2, coalesce(FLAIR, -1) AS FLAIR, coalesce(curve, '') AS curve, {R('distance')} AS distance FROM idx
  LEFT JOIN (SELECT subject_id, x, y, z, {', '.join(f"round(max(CASE WHEN modality = '{m}' THEN value END)) AS {m}" for m in fe.MODALITIES)} FROM modal GROUP BY ALL) USING (subject_id, x, y, z)
  LEFT JOIN curve USING (subject_id, x, y, z)
  LEFT JOIN (SELECT i.subject_id, i.x, i.y, i.z, sqrt(min((i.x-f.x)*(i.x-f.x)+(i.y-f.y)*(i.y-f.y)+(i.z-f.z)*(i.z-f.z))) AS distance FROM idx i JOIN far f ON i.subject_id = f.subject_id GROUP BY ALL) USING (subject_id, x, y, z)"""))
def voxel_features(t):
    meta = d.image_meta(t).select("image_id", "subject_id")
    of_subject = lambda df: fe.attach(df, meta, ["image_id"])
    cells = of_subject(d.cells(t)).select("subject_id", *d.XYZ, "d")
    indices, targets = cells.where("d <= 6").drop("d").distinct(), cells.where("d > 50").drop("d").distinct()
    series = of_subject(d.series(t)).groupBy("subject_id", *d.XYZ, "t").agg(F.sum("value").alias("value"))
    table = fe.voxel_features(indices, _modal(t), series=series, targets=targets)
    curve = F.array_join(F.transform("curve", lambda v: v.cast("string")), ",")
    return table.withColumns({"curve": F.coalesce(curve, F.lit("")), "distance": F.round("distance", 6)}).fillna(-1.0, list(fe.MODALITIES))


def _train(t):
    rows = t.orders.select("o_orderkey", "o_totalprice", F.col("o_custkey"))
    return fe.near_far_training(rows.where("o_custkey % 7 = 0"), rows.where("o_custkey % 7 <> 0"))


TRAIN = "train AS (SELECT o_orderkey, o_totalprice, o_custkey, CASE WHEN o_custkey % 7 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS label FROM orders)"


@query("near_far_training", d.with_ctes(TRAIN, "SELECT * FROM train"))
def near_far_training(t):
    return _train(t)


@query("balance_by_stride", d.with_ctes(TRAIN, """SELECT * FROM train WHERE label = 0 UNION ALL SELECT o_orderkey, o_totalprice, o_custkey, label FROM
  (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, (SELECT count(*) FILTER (WHERE label = 1) // count(*) FILTER (WHERE label = 0) FROM train) AS step FROM train WHERE label = 1) WHERE r % step = 0"""))
def balance_by_stride(t):
    return fe.balance_by_stride(_train(t), "o_orderkey")


@query("class_counts", "SELECT label, count(*) AS rows FROM embeddings GROUP BY 1")
def class_counts(t):
    return fe.class_counts(t.embeddings)


@query("survival_targets", "SELECT p_partkey, p_size, CASE WHEN p_size <= 6 THEN 0 ELSE 1 END AS target_6, CASE WHEN p_size <= 18 THEN 0 ELSE 1 END AS target_18 FROM part")
def survival_targets(t):
    return fe.first_class_first(fe.survival_targets(t.part.select("p_partkey", "p_size"), "p_size"), "target_6", "p_partkey")


@query("pseudoprogression_targets", "SELECT p_partkey, p_size % 7 AS score, CASE WHEN p_size % 7 IN (1, 2) THEN 0 ELSE 1 END AS target_low, CASE WHEN p_size % 7 IN (5, 6) THEN 0 ELSE 1 END AS target_high FROM part")
def pseudoprogression_targets(t):
    return fe.pseudoprogression_targets(t.part.select("p_partkey", (F.col("p_size") % 7).alias("score")))


@query("mutation_target", "SELECT doc_id, quality, CASE WHEN quality = 1 THEN 0 ELSE 1 END AS target FROM labels")
def mutation_target(t):
    return fe.mutation_target(t.labels.select("doc_id", "quality"), "quality")


@query("subtype_one_vs_rest", "SELECT p_partkey, p_size % 6 AS subtype, " + ", ".join(
       f"CASE WHEN (CASE WHEN p_size % 6 BETWEEN 1 AND 4 THEN p_size % 6 ELSE 3 END) = {k} THEN 1 ELSE 0 END AS target_{k}" for k in (1, 2, 3, 4)) + " FROM part")
def subtype_one_vs_rest(t):
    return fe.subtype_one_vs_rest(t.part.select("p_partkey", (F.col("p_size") % 6).alias("subtype")))


LONG = "long AS (SELECT vec_id, unnest(features) AS v, unnest(range(len(features))) AS feature FROM features)"
MODEL = "model AS (SELECT feature, avg(v) AS mean, stddev_samp(v) AS std FROM long GROUP BY 1)"


@query("scale_fit", d.with_ctes(d.FEATURES, LONG, MODEL, f"SELECT CAST(feature AS BIGINT) AS feature, {R('mean')} AS mean, {R('std')} AS std FROM model"))
def scale_fit(t):
    return fe.scale_fit(d.features(t)).select(F.col("feature").cast("long"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("scale_transform", d.with_ctes(d.FEATURES, LONG, MODEL, f"SELECT vec_id, CAST(feature AS BIGINT) AS feature, {R('CASE WHEN std > 0 THEN (v - mean) / std ELSE 0 END')} AS value FROM long JOIN model USING (feature)"))
def scale_transform(t):
    f = d.features(t)
    scaled = fe.scale_transform(f, fe.scale_fit(f))
    return scaled.select("vec_id", F.posexplode("features").alias("feature", "value")).select(
        "vec_id", F.col("feature").cast("long"), F.round("value", 6).alias("value"))


@query("transpose", "SELECT l_linenumber AS row, l_orderkey AS col, sum(l_quantity) AS value FROM lineitem GROUP BY ALL")
def transpose(t):
    cells = t.lineitem.groupBy(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col")).agg(F.sum("l_quantity").alias("value"))
    return fe.transpose(cells)


@query("pca_projection")
def pca_projection(t):
    f = d.features(t)
    projected = fe.pca_transform(f, fe.pca_fit(f, fe.feature_count(f)))
    return projected.select("vec_id", F.posexplode("projected").alias("component", "value")).select(
        "vec_id", F.col("component").cast("long"), F.round("value", 6).alias("value"))


@query("svm_scores")
def svm_scores(t):
    f = d.features(t).withColumn("label", (F.col("label") % 2).cast("double"))
    return fe.svm_score(f, fe.svm_fit(f)).select("vec_id", "label", "predicted", F.round("score", 6).alias("score"))


@query("train_val_split", """SELECT 'sub' || c_custkey AS subject_id, CASE WHEN CAST('0x' || substr(md5('42:sub' || c_custkey), 1, 7) AS BIGINT) % 1000000 < 800000
  THEN 'train' ELSE 'validation' END AS split FROM customer""")
def train_val_split(t):
    subjects = t.customer.select(F.concat(F.lit("sub"), F.col("c_custkey").cast("string")).alias("subject_id"))
    return fe.train_val_split(subjects)


def _saved(t, **tables):
    """Model tables saved to and loaded from the folder that all executors share."""
    ensure_checkpoint_dir(t.spark)
    path = f"{t.spark.sparkContext.getCheckpointDir()}/model-{uuid.uuid4().hex}"
    f = d.features(t)
    save_model_tables(path, fe.scale_fit(f), **tables)
    return f, load_model_tables(t.spark, path)


def _saved_pca(t):
    f = d.features(t)
    return _saved(t, pca=fe.pca_loadings(t.spark, fe.pca_fit(f, fe.feature_count(f))))


CENTRED = "centred AS (SELECT vec_id, feature, v, v - avg(v) OVER (PARTITION BY feature) AS c FROM long)"


@query("model_tables", d.with_ctes(d.FEATURES, LONG, MODEL, f"SELECT CAST(feature AS BIGINT) AS feature, {R('mean')} AS mean, {R('std')} AS std FROM model"))
def model_tables(t):
    _, tables = _saved(t)
    return tables["scaling"].select(F.col("feature").cast("long"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("model_flags", """SELECT upper(lang) AS modality, max(n_chars) > 10000 AS used FROM documents WHERE lang IS NOT NULL GROUP BY 1""")
def model_flags(t):
    """Flags of a model, written and read back: which of the languages, taken as modalities, have long enough documents."""
    used = t.documents.where("lang is not null").groupBy(F.upper("lang").alias("m")).agg((F.max("n_chars") > 10000).alias("u"))
    _, tables = _saved(t, flags={r.m: r.u for r in used.collect()})  # one row a modality
    return tables["flags"]


@query("model_pca_means", d.with_ctes(d.FEATURES, LONG, MODEL, f"SELECT CAST(feature AS BIGINT) AS feature, {R('mean')} AS mean, (SELECT count(*) FROM model) AS components FROM model"))
def model_pca_means(t):
    """Means of the saved components, and how many there are."""
    _, tables = _saved_pca(t)
    return tables["pca"].groupBy(F.col("feature").cast("long").alias("feature")).agg(F.round(F.max("mean"), 6).alias("mean"), F.count_distinct("component").alias("components"))


@query("model_pca_gram", d.with_ctes(d.FEATURES, LONG, MODEL, "SELECT CAST(a.feature AS BIGINT) AS a, CAST(b.feature AS BIGINT) AS b, CASE WHEN a.feature = b.feature THEN 1.0::DOUBLE ELSE 0 END AS product FROM model a, model b"))
def model_pca_gram(t):
    """Products of the saved components with one another: they are orthonormal."""
    pca = _saved_pca(t)[1]["pca"]
    side = lambda name: pca.select(F.col("component").cast("long").alias(name), "feature", F.col("loading").alias(f"_{name}"))
    product = F.sum(F.col("_a") * F.col("_b"))
    return side("a").join(side("b"), "feature").groupBy("a", "b").agg((F.round(product, 6) + F.lit(0.0)).alias("product"))


@query("pca_lengths", d.with_ctes(d.FEATURES, LONG, CENTRED, f"SELECT vec_id, {R('sum(c * c)', 4)} AS squared FROM centred GROUP BY 1"))
def pca_lengths(t):
    """Squared length of every projected vector: a projection on all components keeps it."""
    f, tables = _saved_pca(t)
    return fe.project(f, tables["pca"]).select("vec_id", F.round(F.aggregate("projected", F.lit(0.0), lambda s, v: s + v * v), 4).alias("squared"))


@query("pca_variances", d.with_ctes(d.FEATURES, LONG, CENTRED, f"""SELECT CAST(a.feature AS BIGINT) AS component, 0.0::DOUBLE AS with_next, true AS falls,
  {R('(SELECT sum(c * c) / (count(DISTINCT vec_id) - 1) FROM centred)', 4)} AS total FROM (SELECT DISTINCT feature FROM centred) a"""))
def pca_variances(t):
    """Components vary without their neighbours, each less than the one before, and all together as the features do."""
    f = d.features(t)
    rows = fe.pca_transform(f, fe.pca_fit(f, fe.feature_count(f))).select("vec_id", F.posexplode("projected").alias("component", "v"))
    following = F.lead("v").over(Window.partitionBy("vec_id").orderBy("component"))
    sums = rows.withColumn("w", following).groupBy("component").agg(F.var_samp("v").alias("variance"), F.coalesce(F.covar_samp("v", "w"), F.lit(0.0)).alias("shared"))
    order = Window.partitionBy(F.lit(0)).orderBy("component")  # one row a component
    before, total = F.lag("variance").over(order), F.sum("variance").over(Window.partitionBy(F.lit(0)))
    return sums.select(F.col("component").cast("long").alias("component"), F.abs(F.round("shared", 6)).alias("with_next"),
                       F.coalesce(F.col("variance") <= before + 1e-9, F.lit(True)).alias("falls"), F.round(total, 4).alias("total"))
