"""Normalisation, smoothing and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxcohort.catalog.agreement import hist_sql, quantile_sql
from voxcohort.catalog.registry import query, rounded
from voxcohort.operators import normalize as no
from voxcohort.plans import derive as d

R = rounded


def _round(df, name="value", digits=6):
    return df.withColumn(name, F.round(name, digits))


def _zscore_parts(source, counted, key="image_id"):
    return [
        f"counted AS ({counted})",
        f"""lim AS (SELECT {key}, greatest(min(v), max(CASE WHEN r = floor(5.0 * n / 100) THEN v END), avg(v) - 3 * stddev_samp(v)) AS lo,
          least(max(v), max(CASE WHEN r = floor(95.0 * n / 100) THEN v END), avg(v) + 3 * stddev_samp(v)) AS hi FROM
          (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY {key}) AS n FROM counted) GROUP BY 1)""",
        f"fin AS (SELECT {key}, avg(v) AS m, stddev_samp(v) AS s FROM counted JOIN lim USING ({key}) WHERE v BETWEEN lo AND hi GROUP BY 1)",
        f"zs AS (SELECT * REPLACE ((value - m) / s AS value) FROM {source} JOIN fin USING ({key}))"]


@query("zscore_image", d.with_ctes(d.VOXELS, *_zscore_parts("voxels", "SELECT image_id, value AS v FROM voxels WHERE value >= 1"),
       f"SELECT image_id, x, y, z, {R('value')} AS value FROM zs"))
def zscore_image(t):
    return _round(no.zscore_image(d.stored(d.voxels(t))))


@query("zscore_image_masked", d.with_ctes(d.VOXELS, d.CELLS, d.MASK, *_zscore_parts(
       "voxels", "SELECT image_id, value AS v FROM voxels JOIN mask USING (image_id, x, y, z) WHERE mask > 0 AND value > 0"),
       f"SELECT image_id, x, y, z, {R('value')} AS value FROM zs"))
def zscore_image_masked(t):
    return _round(no.zscore_image(d.stored(d.voxels(t)), d.mask(t)))


@query("zscore_if_needed", d.with_ctes(d.VOXELS, *_zscore_parts("voxels", "SELECT image_id, value AS v FROM voxels WHERE value >= 1"),
       f"SELECT image_id, x, y, z, {R('value')} AS value FROM zs UNION ALL SELECT image_id || 'c', x, y, z, {R('value - avg(value) OVER (PARTITION BY image_id)')} FROM voxels"))
def zscore_if_needed(t):
    image = d.stored(d.voxels(t))
    mean = image.groupBy("image_id").agg(F.avg("value").alias("m"))
    centred = no.attach(image, mean, ["image_id"]).select(
        F.concat("image_id", F.lit("c")).alias("image_id"), *d.XYZ, (F.col("value") - F.col("m")).alias("value"))
    return _round(no.zscore_if_needed(image.unionByName(centred), tolerance=1e-6))


@query("p1p2_normalize", d.with_ctes(d.VOXELS, "upper_part AS (SELECT image_id, value FROM voxels JOIN (SELECT image_id, avg(value) AS m FROM voxels GROUP BY 1) USING (image_id) WHERE value >= m)",
       hist_sql(1000, "upper_part"), f"cut AS ({quantile_sql({'lo': '0.02::DOUBLE', 'hi': '0.95::DOUBLE'})})",
       f"SELECT image_id, x, y, z, {R('(least(greatest(value, lo), hi) - lo) / hi')} AS value FROM voxels JOIN cut USING (image_id)"))
def p1p2_normalize(t):
    return _round(no.p1p2_normalize(d.stored(d.voxels(t))))


@query("rescale_intensity", d.with_ctes(d.VOXELS, f"SELECT image_id, x, y, z, {R('(value - lo) / (hi - lo) * 1000')} AS value FROM voxels, (SELECT min(value) AS lo, max(value) AS hi FROM voxels)"))
def rescale_intensity(t):
    return _round(no.rescale_intensity(d.stored(d.voxels(t))))


SERIES_OF = "linked AS (SELECT v.*, subject_id AS series_id FROM voxels v JOIN meta USING (image_id))"


@query("joint_normalize", d.with_ctes(d.VOXELS, d.META, SERIES_OF, *_zscore_parts("linked", "SELECT series_id, value AS v FROM linked WHERE value >= 1", "series_id"),
       f"SELECT image_id, series_id, x, y, z, {R('value')} AS value FROM zs"))
def joint_normalize(t):
    series = d.image_meta(t).select("image_id", F.col("subject_id").alias("series_id"))
    return _round(no.joint_normalize(d.stored(no.attach(d.voxels(t), series, ["image_id"]))))


def _match_table(source, name):
    return [f"{name}_up AS (SELECT image_id, value FROM {source} JOIN (SELECT image_id, avg(value) AS m FROM {source} GROUP BY 1) USING (image_id) WHERE value >= m)",
            hist_sql(100, f"{name}_up", f"{name}_hist"),
            f"""{name}_q AS (SELECT image_id, list(q ORDER BY i) AS inner_q FROM (SELECT image_id, i, max(CASE WHEN upto >= i / 41 * total AND upto - count < i / 41 * total
              THEN low + (i / 41 * total - upto + count) / count * (high - low) END) AS q FROM (SELECT unnest(range(1, 41)) AS i),
              (SELECT *, sum(count) OVER (PARTITION BY image_id) AS total, sum(count) OVER (PARTITION BY image_id ORDER BY bin) AS upto FROM {name}_hist) GROUP BY 1, 2) GROUP BY 1)""",
            f"{name} AS (SELECT image_id, lo, [m] || inner_q || [hi] AS q FROM (SELECT image_id, min(value) AS lo, max(value) AS hi, avg(value) AS m FROM {source} GROUP BY 1) JOIN {name}_q USING (image_id))"]


@query("histogram_match", d.with_ctes(d.VOXELS, d.SECOND, *_match_table("voxels", "ms"), *_match_table("second", "mr"),
       """seg AS (SELECT v.*, ms.q AS s, mr.q AS r, ms.lo AS sl, mr.lo AS rl, least(len(list_filter(ms.q, lambda p: p <= value)), 41) AS k FROM voxels v JOIN ms USING (image_id) JOIN mr USING (image_id))""",
       f"""SELECT image_id, x, y, z, {R('CASE WHEN k = 0 THEN r[1] + (value - s[1]) * coalesce((r[1] - rl) / nullif(s[1] - sl, 0), 0) ELSE r[k] + coalesce((value - s[k]) / nullif(s[k+1] - s[k], 0), 0) * (r[k+1] - r[k]) END', 4)} AS value FROM seg"""))
def histogram_match(t):
    return _round(no.histogram_match(d.stored(d.voxels(t)), d.second_image(t)), digits=4)


@query("susan_smooth", d.with_ctes(d.VOXELS, """near AS (SELECT c.image_id, c.x, c.y, c.z, v.value, exp(-((c.x-v.x)*(c.x-v.x)+(c.y-v.y)*(c.y-v.y)+(c.z-v.z)*(c.z-v.z)) / (2 * 0.5 * 0.5) - (v.value - c.value) * (v.value - c.value) / 6400.0) AS w
  FROM voxels c JOIN voxels v ON c.image_id = v.image_id AND v.x BETWEEN c.x-1 AND c.x+1 AND v.y BETWEEN c.y-1 AND c.y+1 AND v.z BETWEEN c.z-1 AND c.z+1
  AND NOT (c.x = v.x AND c.y = v.y AND c.z = v.z))""",
       """SELECT image_id, x, y, z, coalesce(CASE WHEN w > 0 THEN round(wv / w) + 0.0 ELSE m END, value) AS value FROM voxels LEFT JOIN
  (SELECT image_id, x, y, z, sum(w) AS w, sum(w * value) AS wv, median(value) AS m FROM near GROUP BY ALL) USING (image_id, x, y, z)"""))
def susan_smooth(t):
    return no.susan_smooth(d.stored(d.voxels(t)))


def _grid(new, step):
    return f"""plan AS (SELECT image_id, size, {new} AS ns, {step} AS st FROM meta),
      grid AS (SELECT image_id, size, st, unnest(range(ns[1])) AS ox, ns FROM plan), grid2 AS (SELECT *, unnest(range(ns[2])) AS oy FROM grid), grid3 AS (SELECT *, unnest(range(ns[3])) AS oz FROM grid2)"""


def _linear_sql(new, step, source="voxels", extra=""):
    p = {c: f"least(o{c} * st[{i}], size[{i}] - 1)" for i, c in enumerate("xyz", 1)}
    near = " AND ".join(f"v.{c} BETWEEN {e} - 1 AND {e} + 1 AND 1 - abs({e} - v.{c}) > 1e-12" for c, e in p.items())
    weight = " * ".join(f"(1 - abs({e} - v.{c}))" for c, e in p.items())
    return (f"SELECT image_id, {extra} ox AS x, oy AS y, oz AS z, {R('sum(value * w)')} AS value FROM (SELECT g.image_id, {extra} ox, oy, oz, value, {weight} AS w FROM grid3 g JOIN {source} v "
            f"ON g.image_id = v.image_id AND {near}) GROUP BY ALL")


def _nearest_sql(source="voxels"):
    same = " AND ".join(f"v.{c} = least(floor(o{c} * st[{i}] + 0.5), size[{i}] - 1)" for i, c in enumerate("xyz", 1))
    return f"SELECT g.image_id, ox AS x, oy AS y, oz AS z, value FROM grid3 g JOIN {source} v ON g.image_id = v.image_id AND {same}"


ISO = ("[CAST(round(size[1] * spacing[1] / 1.25) AS INTEGER), CAST(round(size[2] * spacing[2] / 1.25) AS INTEGER), CAST(round(size[3] * spacing[3] / 1.25) AS INTEGER)]",
       "[1.25 / spacing[1], 1.25 / spacing[2], 1.25 / spacing[3]]")
PERCENT = ("[CAST(floor(size[1] * 0.75) AS INTEGER), CAST(floor(size[2] * 0.75) AS INTEGER), CAST(floor(size[3] * 0.75) AS INTEGER)]", "[1 / 0.75::DOUBLE, 1 / 0.75::DOUBLE, 1 / 0.75::DOUBLE]")


@query("resample_linear", d.with_ctes(d.VOXELS, d.META, _grid(*ISO), _linear_sql(*ISO)))
def resample_linear(t):
    return _round(no.resample(d.voxels(t), d.image_meta(t), 1.25))


@query("resample_nearest", d.with_ctes(d.VOXELS, d.META, _grid(*ISO), _nearest_sql()))
def resample_nearest(t):
    return no.resample(d.voxels(t), d.image_meta(t), 1.25, "nearest")


@query("resample_series", d.with_ctes(d.SERIES, d.META, _grid(*ISO), _linear_sql(*ISO, source="series", extra="t,")))
def resample_series(t):
    return _round(no.resample(d.series(t), d.image_meta(t), 1.25))


@query("resize_percent", d.with_ctes(d.VOXELS, d.META, _grid(*PERCENT), _linear_sql(*PERCENT)))
def resize_percent(t):
    return _round(no.resize(d.voxels(t), d.image_meta(t), 75))


REFERENCE = ("[CAST(round(size[1] * spacing[1] / (spacing[2] * 0.8)) AS INTEGER), CAST(round(size[2] * spacing[2] / 1.0) AS INTEGER), CAST(round(size[3] * spacing[3] / 1.5) AS INTEGER)]",
             "[spacing[2] * 0.8 / spacing[1], 1.0 / spacing[2], 1.5 / spacing[3]]")


@query("resample_to_reference", d.with_ctes(d.VOXELS, d.META, _grid(*REFERENCE), _linear_sql(*REFERENCE)))
def resample_to_reference(t):
    meta = d.image_meta(t)
    reference = meta.select("image_id", F.array(F.col("spacing")[1] * 0.8, F.lit(1.0), F.lit(1.5)).alias("spacing"))
    return _round(no.resample_to_reference(d.voxels(t), meta, reference))
