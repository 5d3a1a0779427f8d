"""Descriptive statistics, counts, sets and class agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxcohort.catalog.registry import query, rounded
from voxcohort.operators import statistics as st
from voxcohort.plans import derive as d

R = rounded


def _round(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def _one_pass(name, fn, sql, digits=6):
    @query(name, d.with_ctes(d.VOXELS, f"SELECT image_id, {R(sql, digits)} AS {name} FROM voxels GROUP BY image_id"))
    def run(t):
        return d.voxels(t).groupBy("image_id").agg(F.round(fn(F.col("value")), digits).alias(name))


for _name, _fn, _sql in (
        ("minimum", st.minimum, "min(value)"), ("maximum", st.maximum, "max(value)"), ("total", st.total, "sum(value)"),
        ("mean", st.mean, "avg(value)"), ("variance", st.variance, "var_samp(value)"), ("std_dev", st.std_dev, "stddev_samp(value)"),
        ("value_range", st.value_range, "max(value) - min(value)"),
        ("studentized_range", st.studentized_range, "(max(value) - min(value)) / var_samp(value)"),
        ("coef_variation", st.coef_variation, "stddev_samp(value) / avg(value)"),
        ("energy", st.energy, "sum(value * value)"), ("rms", st.rms, "sqrt(avg(value * value))")):
    _one_pass(_name, _fn, _sql)

Z = ("SELECT image_id, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS zscore, x, y, z, value FROM voxels "
     "WINDOW w AS (PARTITION BY image_id)")


@query("skewness", d.with_ctes(d.VOXELS, f"SELECT image_id, {R('avg(zscore * zscore * zscore)')} AS skewness FROM ({Z}) GROUP BY 1"))
def skewness(t):
    return d.voxels(t).groupBy("image_id").agg(F.round(st.skewness(F.col("value")), 6).alias("skewness"))


@query("kurtosis", d.with_ctes(d.VOXELS, f"SELECT image_id, {R('avg(pow(zscore, 4))')} AS kurtosis FROM ({Z}) GROUP BY 1"))
def kurtosis(t):
    return d.voxels(t).groupBy("image_id").agg(F.round(st.kurtosis(F.col("value")), 6).alias("kurtosis"))


@query("zscores", d.with_ctes(d.VOXELS, f"SELECT image_id, x, y, z, {R('zscore')} AS zscore FROM ({Z})"))
def zscores(t):
    return _round(st.zscores(d.stored(d.voxels(t))).drop("value"), "zscore")


@query("mode", d.with_ctes(d.VOXELS, "SELECT image_id, arg_max(value, c * 100000 - value) AS mode FROM "
       "(SELECT image_id, value, count(*) AS c FROM voxels GROUP BY ALL) GROUP BY 1"))
def mode(t):
    return st.mode(d.voxels(t))


@query("median", d.with_ctes(d.VOXELS, "SELECT image_id, median(value) AS median FROM voxels GROUP BY 1"))
def median(t):
    return st.median(d.stored(d.voxels(t)))


@query("median_float", "SELECT l_returnflag, median(l_extendedprice) AS median FROM lineitem GROUP BY 1")
def median_float(t):
    return st.median(t.lineitem, ["l_returnflag"], "l_extendedprice")


RANKED = ("ranked AS (SELECT image_id, value, row_number() OVER (PARTITION BY image_id ORDER BY value) - 1 AS r, "
          "count(*) OVER (PARTITION BY image_id) AS n FROM voxels)")


def _at(p):
    rank = "0" if p < 1 else f"CAST(floor({p}.0 * n / 100) AS BIGINT)"
    return f"max(CASE WHEN r = {rank} THEN value END)"


PCT = f"pct AS (SELECT image_id, {_at(10)} AS p10, {_at(25)} AS p25, {_at(75)} AS p75, {_at(90)} AS p90, {_at(0)} AS p0 FROM ranked GROUP BY 1)"


@query("nth_percentile", d.with_ctes(d.VOXELS, RANKED, PCT, "SELECT image_id, p10, p25, p75, p90, p0 FROM pct"))
def nth_percentile(t):
    return st.nth_percentile(d.stored(d.voxels(t)), {"p10": 10, "p25": 25, "p75": 75, "p90": 90, "p0": 0})


@query("iqr", d.with_ctes(d.VOXELS, RANKED, PCT, "SELECT image_id, p75 - p25 AS iqr FROM pct"))
def iqr(t):
    return st.quartiles(d.stored(d.voxels(t))).select("image_id", "iqr")


@query("quartile_dispersion", d.with_ctes(d.VOXELS, RANKED, PCT, f"SELECT image_id, {R('(p75 - p25) / (p75 + p25)')} AS quartile_dispersion FROM pct"))
def quartile_dispersion(t):
    return _round(st.quartiles(d.stored(d.voxels(t))).select("image_id", "quartile_dispersion"), "quartile_dispersion")


def _mad(name, fn, centre):
    sql = d.with_ctes(d.VOXELS, f"SELECT image_id, {R('avg(abs(value - c))')} AS {name} FROM voxels JOIN "
                                f"(SELECT image_id, {centre}(value) AS c FROM voxels GROUP BY 1) USING (image_id) GROUP BY 1")

    @query(name, sql)
    def run(t):
        return _round(fn(d.stored(d.voxels(t))), name)


_mad("mean_abs_deviation", st.mean_abs_deviation, "avg")
_mad("median_abs_deviation", st.median_abs_deviation, "median")


@query("robust_mad", d.with_ctes(d.VOXELS, RANKED, PCT, "kept AS (SELECT image_id, value FROM voxels JOIN pct USING (image_id) WHERE value BETWEEN p10 AND p90)",
       f"SELECT image_id, {R('avg(abs(value - c))')} AS robust_mad FROM kept JOIN (SELECT image_id, avg(value) AS c FROM kept GROUP BY 1) USING (image_id) GROUP BY 1"))
def robust_mad(t):
    return _round(st.robust_mad(d.stored(d.voxels(t))), "robust_mad")


@query("unique_values", d.with_ctes(d.VOXELS, "SELECT DISTINCT image_id, value FROM voxels"))
def unique_values(t):
    return st.unique_values(d.voxels(t), sort=True)


@query("unique_elements", "SELECT DISTINCT text FROM documents")
def unique_elements(t):
    return st.unique_elements(t.documents, "text")


@query("label_counts", d.with_ctes(d.CELLS, d.PAIR, "SELECT image_id, src AS label, count(*) AS voxels FROM pair GROUP BY ALL"))
def label_counts(t):
    return st.label_counts(d.labelmap(t))


@query("same_label_set", d.with_ctes(d.CELLS, d.PAIR,
       "SELECT image_id, list_sort(list(DISTINCT src)) = list_sort(list(DISTINCT tgt)) AS same FROM pair GROUP BY 1"))
def same_label_set(t):
    pair = d.label_pair(t)
    return st.same_label_set(pair.withColumnRenamed("src", "label"), pair.withColumnRenamed("tgt", "label"))


@query("population_mask", d.with_ctes(d.VOXELS, d.META, "SELECT modality, x, y, z, 1 AS mask FROM (SELECT modality, x, y, z, sum(value - 60) AS total "
       "FROM voxels JOIN meta USING (image_id) GROUP BY ALL) WHERE total > 0"))
def population_mask(t):
    images = st.attach(d.voxels(t), d.image_meta(t).select("image_id", "modality"), ["image_id"])
    return st.population_mask(images.withColumn("value", F.col("value") - 60))


@query("column_means", d.with_ctes(d.FEATURES, f"SELECT feature, {R('avg(v)')} AS mean FROM (SELECT unnest(features) AS v, unnest(range(len(features))) AS feature FROM features) GROUP BY 1"))
def column_means(t):
    return _round(st.column_means(d.features(t)).withColumn("feature", F.col("feature").cast("long")), "mean")


@query("field_norms", d.with_ctes(d.VOXELS, "SELECT image_id, sum(value) AS voxel_sum, sum(value * value) AS squared_norm, min(value) AS minimum, max(value) AS maximum FROM voxels GROUP BY 1"))
def field_norms(t):
    return st.field_norms(d.voxels(t))


LENGTH = "sqrt(list_sum(list_transform(features, lambda v: v * v)))"


@query("vector_norms", d.with_ctes(d.FEATURES, f"SELECT label, {R(f'min({LENGTH})')} AS shortest, {R(f'max({LENGTH})')} AS longest FROM features GROUP BY 1"))
def vector_norms(t):
    return _round(st.vector_norms(d.features(t), ["label"], "features"), "shortest", "longest")


@query("inner_product", d.with_ctes(d.FEATURES, f"SELECT vec_id, {R('list_sum(list_transform(features, lambda v: v * v))')} AS product FROM features"))
def inner_product(t):
    return d.features(t).select("vec_id", F.round(st.inner_product(F.col("features"), F.col("features")), 6).alias("product"))


COUNTS = """counts AS (SELECT lang, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality = toxic AND quality <> 1) AS tn,
  count(*) FILTER (WHERE quality = 1 AND toxic <> 1) AS fn, count(*) FILTER (WHERE quality <> 1 AND quality <> toxic) AS fp,
  count(*) FILTER (WHERE quality = 1) AS rp, count(*) FILTER (WHERE toxic = 1) AS pp FROM labels JOIN documents USING (doc_id) GROUP BY 1)"""


def _agreement(t):
    return t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")


@query("confusion", d.with_ctes(COUNTS, "SELECT * FROM counts"))
def confusion(t):
    return st.confusion(_agreement(t), "quality", "toxic", ["lang"])


def _div(a, b):
    return f"CASE WHEN ({b}) <> 0 THEN CAST({a} AS DOUBLE) / ({b}) END"


def _roc_sql(legacy):
    n, rn, pn = "tp+fp+tn+fn", "tn+fp", "tn+fn"
    plus, minus = f"({_div('tp', 'rp')}) / nullif(({_div('fp', rn)}), 0)", f"({_div('fn', 'rp')}) / nullif(({_div('tn', rn)}), 0)"
    columns = {
        "accuracy": _div("tp+tn", n), "precision": _div("tp", "pp"), "fdr": _div("tp" if legacy else "fp", "pp"), "for": _div("fn", pn),
        "npv": _div("tn", pn), "prevalence": _div("rp", f"2*({n})" if legacy else n), "sensitivity": _div("tp", "rp"),
        "fall_out": _div("fp", rn), "miss_rate": _div("fn", "rp"), "specificity": _div("tn", rn), "lr_plus": plus, "lr_minus": minus,
        "dor": f"({plus}) / nullif(({minus}), 0)", "dice": _div("2*tp", "2*tp+fp+fn"), "jaccard": _div("2*tp" if legacy else "tp", "tp+fp+fn")}
    body = ", ".join(f"{R(e)} AS \"{name}\"" for name, e in columns.items())
    return d.with_ctes(COUNTS, f"SELECT lang, {body} FROM counts")


def _roc(t, legacy):
    counts = st.confusion(_agreement(t), "quality", "toxic", ["lang"])
    return counts.select("lang", *[F.round(c, 6).alias(n) for n, c in st.roc_columns(legacy).items()])


@query("roc_values", _roc_sql(False))
def roc_values(t):
    return _roc(t, False)


@query("roc_values_legacy", _roc_sql(True))
def roc_values_legacy(t):
    return _roc(t, True)
