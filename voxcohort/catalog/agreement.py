"""Histograms, similarity of images, label agreement and surface distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxcohort.catalog.registry import query, rounded
from voxcohort.operators import agreement as ag
from voxcohort.operators import histograms as hi
from voxcohort.operators import joins
from voxcohort.operators import statistics as st
from voxcohort.plans import cohort
from voxcohort.plans import derive as d

R = rounded


def _round(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def hist_sql(bins, source="voxels", name="hist"):
    return (f"{name} AS (SELECT image_id, bin, lo + (hi - lo) / {bins} * bin AS low, lo + (hi - lo) / {bins} * (bin + 1) AS high, count(*) AS count FROM "
            f"(SELECT image_id, lo, hi, CAST(greatest(least(floor((value - lo) / (hi - lo) * {bins}), {bins - 1}), 0) AS BIGINT) AS bin FROM {source} "
            f"JOIN (SELECT image_id, min(value) AS lo, max(value) AS hi FROM {source} GROUP BY 1) USING (image_id)) GROUP BY ALL)")


@query("histogram", d.with_ctes(d.VOXELS, hist_sql(20), f"SELECT image_id, bin, {R('low')} AS low, {R('high')} AS high, count FROM hist"))
def histogram(t):
    return _round(hi.histogram(d.stored(d.voxels(t)), 20), "low", "high")


MASKED = "masked AS (SELECT image_id, x, y, z, value FROM voxels JOIN mask USING (image_id, x, y, z) WHERE mask <> 0)"


@query("histogram_masked", d.with_ctes(d.VOXELS, d.CELLS, d.MASK, MASKED, hist_sql(16, "masked"),
       f"SELECT image_id, bin, {R('low')} AS low, {R('high')} AS high, count FROM hist"))
def histogram_masked(t):
    inside = d.voxels(t).join(d.mask(t).where("mask <> 0"), d.VOXEL, "left_semi")
    return _round(hi.histogram(d.stored(inside), 16), "low", "high")


def quantile_sql(named):
    cases = ", ".join(f"max(CASE WHEN upto >= {q} * total AND upto - count < {q} * total THEN low + ({q} * total - upto + count) / count * (high - low) END) AS {n}"
                      for n, q in named.items())
    return (f"SELECT image_id, {cases} FROM (SELECT *, sum(count) OVER (PARTITION BY image_id) AS total, "
            "sum(count) OVER (PARTITION BY image_id ORDER BY bin) AS upto FROM hist) GROUP BY 1")


@query("histogram_quantile", d.with_ctes(d.VOXELS, hist_sql(50), f"q AS ({quantile_sql({'q05': '0.05::DOUBLE', 'q50': '0.5::DOUBLE', 'q95': '0.95::DOUBLE'})})",
       f"SELECT image_id, {R('q05')} AS q05, {R('q50')} AS q50, {R('q95')} AS q95 FROM q"))
def histogram_quantile(t):
    found = hi.histogram_quantile(hi.histogram(d.stored(d.voxels(t)), 50), {"q05": 0.05, "q50": 0.5, "q95": 0.95})
    return _round(found, "q05", "q50", "q95")


OTSU = """otsu AS (SELECT image_id, arg_max(high, {'b': coalesce(round(n0 * (n - n0) / (n * n) * pow(m0 / n0 - (m - m0) / nullif(n - n0, 0), 2), 6), 0), 'c': -bin}) AS threshold FROM
  (SELECT *, CAST(sum(count) OVER (PARTITION BY image_id) AS DOUBLE) AS n, sum(count * (low + high) / 2) OVER (PARTITION BY image_id) AS m,
   CAST(sum(count) OVER (PARTITION BY image_id ORDER BY bin) AS DOUBLE) AS n0, sum(count * (low + high) / 2) OVER (PARTITION BY image_id ORDER BY bin) AS m0 FROM hist) GROUP BY 1)"""


@query("otsu", d.with_ctes(d.VOXELS, hist_sql(128), OTSU, f"SELECT image_id, {R('threshold')} AS threshold FROM otsu"))
def otsu(t):
    return _round(hi.otsu(d.stored(d.voxels(t))), "threshold")


@query("otsu_threshold", d.with_ctes(d.VOXELS, d.CELLS, d.MASK, MASKED, hist_sql(128, "masked"), OTSU,
       "SELECT image_id, x, y, z, CASE WHEN value > threshold THEN 1 ELSE 0 END AS value FROM masked JOIN otsu USING (image_id)"))
def otsu_threshold(t):
    return hi.otsu_threshold(d.voxels(t), d.mask(t))


BOTH = "both_images AS (SELECT image_id, x, y, z, v.value AS a, s.value AS b FROM voxels v JOIN second s USING (image_id, x, y, z))"


def _both(t):
    return joins.align_images(d.voxels(t), d.second_image(t))


JOINT = """joint AS (SELECT *, sum(p) OVER (PARTITION BY image_id, bin_a) AS pa, sum(p) OVER (PARTITION BY image_id, bin_b) AS pb FROM
  (SELECT *, count / sum(count) OVER (PARTITION BY image_id) AS p FROM
    (SELECT image_id, 1 + CAST(least(floor((a - la) / (ha - la) * 8), 7) AS BIGINT) AS bin_a, 1 + CAST(least(floor((b - lb) / (hb - lb) * 8), 7) AS BIGINT) AS bin_b, count(*) AS count
     FROM both_images JOIN (SELECT image_id, min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb FROM both_images GROUP BY 1) USING (image_id) GROUP BY ALL)))"""


@query("joint_histogram", d.with_ctes(d.VOXELS, d.SECOND, BOTH, JOINT,
       f"SELECT image_id, bin_a, bin_b, count, {R('p')} AS p, {R('pa')} AS pa, {R('pb')} AS pb FROM joint"))
def joint_histogram(t):
    return _round(hi.joint_histogram(d.stored(_both(t)), 8), "p", "pa", "pb")


@query("mutual_information", d.with_ctes(d.VOXELS, d.SECOND, BOTH, JOINT, f"""SELECT image_id, {R('sum(p * ln(p / (pa * pb)))')} AS mutual_information,
  {R('(-sum(p * ln(pa)) - sum(p * ln(pb))) / -sum(p * ln(p))')} AS normalized_mi FROM joint GROUP BY 1"""))
def mutual_information(t):
    return _round(hi.mutual_information(d.stored(_both(t)), 8), "mutual_information", "normalized_mi")


@query("weighted_ssd", d.with_ctes(d.VOXELS, d.SECOND, BOTH, f"""SELECT image_id, {R('sum(pow(0.5 * (a - b), 2) + pow(2 * (a * a - b * b), 2))', 2)} AS ssd,
  {R('sum(pow(0.5 * (a - b), 2))', 2)} AS ssd_0, {R('sum(pow(2 * (a * a - b * b), 2))', 2)} AS ssd_1 FROM both_images GROUP BY 1"""))
def weighted_ssd(t):
    pair = _both(t).withColumns({"a2": F.col("a") * F.col("a"), "b2": F.col("b") * F.col("b")})
    return _round(hi.weighted_ssd(pair, ["a", "a2"], ["b", "b2"], [0.5, 2.0]), "ssd", "ssd_0", "ssd_1", digits=2)


NCC = "CASE WHEN sxx >= 1e-8 AND syy >= 1e-8 THEN sign(sxy) * sxy * sxy / (sxx * syy) ELSE 0 END"


@query("signed_correlation", d.with_ctes(d.VOXELS, d.SECOND, BOTH, f"""SELECT image_id, {R(NCC)} AS correlation FROM
  (SELECT image_id, var_pop(a) * count(*) AS sxx, var_pop(b) * count(*) AS syy, covar_pop(a, b) * count(*) AS sxy FROM both_images GROUP BY 1)"""))
def signed_correlation(t):
    return _round(hi.signed_correlation(_both(t)), "correlation")


@query("patch_ncc", d.with_ctes(d.VOXELS, d.SECOND, BOTH, f"""SELECT image_id, x, y, z, {R(NCC)} AS ncc FROM
  (SELECT c.image_id, c.x, c.y, c.z, sum(v.a * v.a) - sum(v.a) * sum(v.a) / count(*) AS sxx, sum(v.b * v.b) - sum(v.b) * sum(v.b) / count(*) AS syy,
     sum(v.a * v.b) - sum(v.a) * sum(v.b) / count(*) AS sxy FROM both_images c JOIN both_images v
   ON c.image_id = v.image_id AND v.x BETWEEN c.x-1 AND c.x+1 AND v.y BETWEEN c.y-1 AND c.y+1 AND v.z BETWEEN c.z-1 AND c.z+1 GROUP BY ALL)"""))
def patch_ncc(t):
    return _round(hi.patch_ncc(_both(t)), "ncc")


COMPARED = """SELECT image_id, count(*) AS voxels, count(*) FILTER (WHERE dd > 40) AS differing, CAST(floor(100 * count(*) FILTER (WHERE dd > 40) / count(*)) AS BIGINT) AS percent,
  coalesce(min(dd) FILTER (WHERE dd > 40), 0) AS minimum, coalesce(max(dd) FILTER (WHERE dd > 40), 0) AS maximum,
  round(coalesce(avg(dd) FILTER (WHERE dd > 40), 0), 6) AS average, coalesce(sum(dd) FILTER (WHERE dd > 40), 0) AS total FROM diffs GROUP BY 1"""
NEAR = """diffs AS (SELECT c.image_id, c.x, c.y, c.z, min(abs(c.value - coalesce(v.value, 0))) AS dd FROM voxels c LEFT JOIN second v ON c.image_id = v.image_id
  AND v.x BETWEEN c.x-1 AND c.x+1 AND v.y BETWEEN c.y-1 AND c.y+1 AND v.z BETWEEN c.z-1 AND c.z+1 GROUP BY ALL)"""


SPARSE = """diffs AS (SELECT image_id, abs(coalesce(v.value, 0) - coalesce(s.value, 0)) AS dd
  FROM voxels v FULL JOIN second s USING (image_id, x, y, z))"""


@query("compare_images", d.with_ctes(d.VOXELS, d.SECOND, SPARSE, COMPARED))
def compare_images(t):
    return _round(hi.compare_images(d.voxels(t), d.second_image(t), 40.0), "average")


@query("compare_images_radius", d.with_ctes(d.VOXELS, d.SECOND, NEAR, COMPARED))
def compare_images_radius(t):
    return _round(hi.compare_images(d.voxels(t), d.second_image(t), 40.0, radius=1), "average")


@query("golden_comparison", d.with_ctes(d.VOXELS, d.SECOND, d.META, SPARSE, f"compared AS ({COMPARED})", """SELECT image_id, same AS same_space,
  CASE WHEN same THEN '' ELSE 'Images are in different spaces (size/origin/spacing mismatch)' END AS message, CASE WHEN same THEN voxels END AS voxels, CASE WHEN same THEN differing END AS differing,
  CASE WHEN same THEN percent END AS percent, CASE WHEN same THEN minimum END AS minimum, CASE WHEN same THEN maximum END AS maximum, CASE WHEN same THEN average END AS average,
  CASE WHEN same THEN total END AS total FROM (SELECT image_id, spacing[2] <> 1.5 AND origin[1] <> 3 AS same FROM meta) LEFT JOIN compared USING (image_id)"""))
def golden_comparison(t):
    """Images against others whose headers differ in spacing or origin for some of them."""
    meta = d.image_meta(t)
    spacing, origin = F.col("spacing"), F.col("origin")
    other = meta.withColumns({
        "spacing": F.when(spacing[1] == 1.5, F.array(spacing[0], F.lit(1.25), spacing[2])).otherwise(spacing),
        "origin": F.when(origin[0] == 3, F.array(F.lit(2.0), origin[1], origin[2])).otherwise(origin)})
    return _round(hi.golden_comparison(d.stored(d.voxels(t)), d.stored(d.second_image(t)), meta, other, 40.0), "average")


@query("images_similar", d.with_ctes(d.VOXELS, d.SECOND, SPARSE,
       f"SELECT image_id, NOT (total > 12000 AND differing > 180) AS similar FROM ({COMPARED})"))
def images_similar(t):
    return hi.images_similar(hi.compare_images(d.voxels(t), d.second_image(t), 40.0), 12000.0, 180).select("image_id", "similar")


# --- surface distances in SQL -------------------------------------------------------------------

SIDES = """sides AS (SELECT image_id, x, y, z, 'src' AS side FROM pair WHERE src <> 0 UNION ALL SELECT image_id, x, y, z, 'tgt' FROM pair WHERE tgt <> 0)"""
D2 = "(p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z)"


def border_sql(source, reach, keys="image_id, side", count=None):
    cond = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    n = count or {1: 7, 2: 19}[reach]
    return f"""(SELECT {', '.join('a.' + k.strip() for k in keys.split(','))}, a.x, a.y, a.z FROM {source} a JOIN {source} b ON {cond}
      AND b.x BETWEEN a.x-1 AND a.x+1 AND b.y BETWEEN a.y-1 AND a.y+1 AND b.z BETWEEN a.z-1 AND a.z+1
      AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= {reach} GROUP BY ALL HAVING count(*) < {n})"""


REGION_SIDES = "rsides AS (SELECT image_id, region, 'src' AS side, x, y, z FROM regions WHERE src = 1 UNION ALL SELECT image_id, region, 'tgt', x, y, z FROM regions WHERE tgt = 1)"
REGION_FAR = [f"border AS {border_sql('rsides', 1, 'image_id, region, side')}",
              f"""h AS (SELECT image_id, region, quantile_cont(sqrt(d2), 0.95) AS hd FROM (SELECT p.image_id, p.region, p.side, p.x, p.y, p.z, min({D2}) AS d2
  FROM border p JOIN border q ON p.image_id = q.image_id AND p.region = q.region AND p.side <> q.side GROUP BY ALL) GROUP BY 1, 2)"""]
REGION_HD = "CASE WHEN s = 0 AND t = 0 THEN 0 WHEN s = 0 OR t = 0 THEN sqrt(size[1]*size[1]+size[2]*size[2]+size[3]*size[3]) ELSE hd END"
PLANE_FAR = ["""lsides AS (SELECT image_id, '_overall' AS plane, 'src' AS side, x, y, z FROM pair WHERE src <> 0 UNION ALL SELECT image_id, '_overall', 'tgt', x, y, z FROM pair WHERE tgt <> 0
  UNION ALL SELECT image_id, '_label' || src, 'src', x, y, z FROM pair WHERE src <> 0 UNION ALL SELECT image_id, '_label' || tgt, 'tgt', x, y, z FROM pair WHERE tgt <> 0)""",
             f"lborder AS {border_sql('lsides', 2, 'image_id, plane, side')}",
             """ldist AS (SELECT p.image_id, p.plane, p.side, p.x, p.y, p.z, min((p.x-q.x)*(p.x-q.x)*spacing[1]*spacing[1]+(p.y-q.y)*(p.y-q.y)*spacing[2]*spacing[2]+(p.z-q.z)*(p.z-q.z)*spacing[3]*spacing[3]) AS d2
  FROM lborder p JOIN lsides q ON p.image_id = q.image_id AND p.plane = q.plane AND p.side <> q.side JOIN meta m ON m.image_id = p.image_id GROUP BY ALL)""",
             """lfar AS (SELECT image_id, plane, max(sqrt(d2)) AS hd FROM (SELECT image_id, plane, d2, row_number() OVER (PARTITION BY image_id, plane, side ORDER BY d2) - 1 AS r,
  count(*) OVER (PARTITION BY image_id, plane, side) AS n FROM ldist) WHERE r = floor(0.95 * (n - 1)) GROUP BY 1, 2)"""]


# --- label agreement --------------------------------------------------------------------------

TABLE = "tbl AS (SELECT image_id, src, tgt, count(*) AS n FROM pair GROUP BY ALL)"
VOLUMES = """vol AS (SELECT image_id, label, CAST(sum(CASE WHEN src = label AND tgt = label THEN 1 ELSE 0 END) AS DOUBLE) AS b,
  CAST(sum(CASE WHEN src = label THEN 1 ELSE 0 END) AS DOUBLE) AS s, CAST(sum(CASE WHEN tgt = label THEN 1 ELSE 0 END) AS DOUBLE) AS t, CAST(count(*) AS DOUBLE) AS n
  FROM pair, (SELECT unnest([1, 2, 4]) AS label) GROUP BY ALL HAVING s + t > 0)"""
OVERLAP = {"overlap": ("b", "t"), "jaccard": ("b", "s + t - b"), "dice": ("2 * b", "s + t"), "volume_similarity": ("2 * (s - t)", "s + t"),
           "false_negative_error": ("t - b", "t"), "false_positive_error": ("s - b", "s")}
RATES = {"sensitivity": ("b", "s"), "specificity": ("n - s - t + b", "n - s"), "accuracy": ("n - s - t + 2 * b", "n"), "precision": ("b", "t")}


def _ratios(measures):
    return ", ".join(f"{R(f'({a}) / nullif({b}, 0)')} AS {m}" for m, (a, b) in measures.items())


def _pair_table(t):
    return d.stored(ag.contingency(d.label_pair(t)))


@query("contingency", d.with_ctes(d.CELLS, d.PAIR, TABLE, "SELECT * FROM tbl"))
def contingency(t):
    return ag.contingency(d.label_pair(t))


@query("label_overlap", d.with_ctes(d.CELLS, d.PAIR, VOLUMES, f"SELECT image_id, {_ratios(OVERLAP)} FROM (SELECT image_id, sum(b) AS b, sum(s) AS s, sum(t) AS t FROM vol GROUP BY 1)"))
def label_overlap(t):
    return _round(ag.label_overlap(_pair_table(t)), *OVERLAP)


@query("label_overlap_by_label", d.with_ctes(d.CELLS, d.PAIR, VOLUMES, f"SELECT image_id, label, {_ratios(OVERLAP)} FROM vol "
       "WHERE image_id IN (SELECT image_id FROM (SELECT image_id, src AS l FROM pair UNION SELECT image_id, tgt FROM pair) GROUP BY 1 HAVING count(*) > 2)"))
def label_overlap_by_label(t):
    return _round(ag.label_overlap_by_label(_pair_table(t)), *OVERLAP)


def _label_statistics_sql():
    rows = [f"SELECT image_id, '{m}_overall' AS metric, ({a}) / nullif({b}, 0) AS value FROM (SELECT image_id, sum(b) AS b, sum(s) AS s, sum(t) AS t FROM vol GROUP BY 1)"
            for m, (a, b) in OVERLAP.items()]
    rows += [f"SELECT image_id, '{m}_label' || label, ({a}) / nullif({b}, 0) FROM vol" for m, (a, b) in (OVERLAP | RATES).items()]
    one = {"sensitivity": ("tp", "rp"), "specificity": ("tn", "tn + fp"), "accuracy": ("tp + tn", "tp + tn + fp + fn"), "precision": ("tp", "pp")}
    rows += [f"SELECT image_id, '{m}_overall', ({a}) / nullif({b}, 0) FROM ones" for m, (a, b) in one.items()]
    rows += ["SELECT image_id, 'hausdorff95_overall', coalesce(hd, 0) FROM same LEFT JOIN (SELECT * FROM lfar WHERE plane = '_overall') USING (image_id)",
             "SELECT image_id, 'hausdorff95' || plane, hd FROM lfar WHERE plane <> '_overall'"]
    return d.with_ctes(d.CELLS, d.PAIR, d.META, VOLUMES, *PLANE_FAR, """ones AS (SELECT image_id, CAST(count(*) FILTER (WHERE src = 1 AND tgt = 1) AS DOUBLE) AS tp,
      count(*) FILTER (WHERE src = tgt AND src <> 1) AS tn, count(*) FILTER (WHERE src = 1 AND tgt <> 1) AS fn, count(*) FILTER (WHERE src <> 1 AND src <> tgt) AS fp,
      count(*) FILTER (WHERE src = 1) AS rp, count(*) FILTER (WHERE tgt = 1) AS pp FROM pair GROUP BY 1)""",
                       "same AS (SELECT image_id FROM pair GROUP BY 1 HAVING list_sort(list(DISTINCT src)) = list_sort(list(DISTINCT tgt)))",
                       f"SELECT image_id, metric, {R('value')} AS value FROM ({' UNION ALL '.join(rows)}) JOIN same USING (image_id)")


@query("label_statistics", _label_statistics_sql())
def label_statistics(t):
    pair = d.stored(d.label_pair(t))
    return _round(ag.label_statistics(d.stored(ag.contingency(pair)), pair=pair, spacing=d.image_meta(t).select("image_id", "spacing")), "value")


MEMBERS = {"NET": "(1)", "ED": "(2)", "ET": "(4)", "TC": "(1, 4)", "WT": "(1, 2, 4)"}
REGION_PAIR = "regions AS (" + " UNION ALL ".join(
    f"SELECT image_id, x, y, z, '{r}' AS region, CAST(src IN {m} AS INTEGER) AS src, CAST(tgt IN {m} AS INTEGER) AS tgt FROM pair" for r, m in MEMBERS.items()) + ")"


@query("region_masks", d.with_ctes(d.CELLS, d.PAIR, REGION_PAIR, "SELECT image_id, x, y, z, region, 1 AS mask FROM regions WHERE src = 1"))
def region_masks(t):
    return ag.region_masks(d.labelmap(t))


REGION_VOLUMES = ("rv AS (SELECT image_id, region, CAST(sum(src * tgt) AS DOUBLE) AS b, CAST(sum(src) AS DOUBLE) AS s, CAST(sum(tgt) AS DOUBLE) AS t, "
                  "CAST({n} AS DOUBLE) AS n FROM regions GROUP BY 1, 2)")


def _region_sql(n, source="pair", extra=(), far=False):
    c = {m: f"({a}) / nullif({b}, 0)" for m, (a, b) in (OVERLAP | RATES).items()}
    for m in ("dice", "specificity"):
        c[m] = f"CASE WHEN s + t = 0 THEN 1 ELSE {c[m]} END"
    c["sensitivity"] = f"CASE WHEN s + t = 0 THEN 1 ELSE coalesce({c['sensitivity']}, 0) END"
    if far:
        c["hausdorff95"] = REGION_HD
    return d.with_ctes(d.CELLS, d.PAIR, *extra, REGION_PAIR.replace("FROM pair", f"FROM {source}"), REGION_VOLUMES.format(n=n), *([d.META, REGION_SIDES, *REGION_FAR] if far else []),
                       "SELECT image_id, region, " + ", ".join(f"{R(e)} AS {m}" for m, e in c.items()) + " FROM rv"
                       + (" JOIN meta USING (image_id) LEFT JOIN h USING (image_id, region)" if far else ""))


@query("region_statistics", _region_sql("count(*)", far=True))
def region_statistics(t):
    pair = d.stored(d.label_pair(t))
    scores = ag.region_statistics(d.stored(ag.contingency(pair)), pair=pair, extents=d.image_meta(t).select("image_id", "size"))
    return _round(scores, *OVERLAP, *RATES, "hausdorff95")


@query("validation_scores", d.with_ctes(d.CELLS, d.PAIR, REGION_PAIR, REGION_VOLUMES.format(n="count(*)"), d.META, REGION_SIDES, *REGION_FAR, f"""SELECT subject_id AS subject, modality AS arch, region, measure,
  {R('value')} AS value FROM (SELECT subject_id, modality, region, unnest(['Dice', 'Hausdorff95', 'Sensitivity', 'Specificity']) AS measure, unnest([
    CASE WHEN s + t = 0 THEN 1 ELSE 2 * b / nullif(s + t, 0) END, {REGION_HD},
    CASE WHEN s + t = 0 THEN 1 ELSE coalesce(b / nullif(s, 0), 0) END, CASE WHEN s + t = 0 THEN 1 ELSE (n - s - t + b) / nullif(n - s, 0) END]) AS value
  FROM rv JOIN meta USING (image_id) LEFT JOIN h USING (image_id, region) WHERE region IN ('WT', 'TC', 'ET'))"""))
def validation_scores(t):
    """Score table of a validation run: subjects of four scans, one a modality."""
    pair, meta = d.stored(d.label_pair(t)), d.image_meta(t)
    named = lambda df: df.join(meta.select("image_id", F.col("subject_id").alias("subject"), F.col("modality").alias("arch")), "image_id").drop("image_id")
    statistics = named(ag.region_statistics(d.stored(ag.contingency(pair))))
    return _round(cohort.validation_scores(statistics, named(ag.region_hausdorff95(pair, meta.select("image_id", "size")))), "value")


@query("region_statistics_full_grid", _region_sql("960"))
def region_statistics_full_grid(t):
    sizes = d.image_meta(t).select("image_id", F.aggregate("size", F.lit(1).cast("long"), lambda a, v: a * v).cast("double").alias("n"))
    return _round(ag.region_statistics(_pair_table(t), sizes=sizes), *OVERLAP, *RATES)


@query("region_statistics_masked", _region_sql("count(*)", "masked_pair", (d.MASK, """masked_pair AS (SELECT image_id, x, y, z, CASE WHEN m.mask IS NULL THEN 0 ELSE src END AS src,
  CASE WHEN m.mask IS NULL THEN 0 ELSE tgt END AS tgt FROM pair LEFT JOIN (SELECT * FROM mask WHERE mask <> 0) m USING (image_id, x, y, z))""")))
def region_statistics_masked(t):
    masked = ag.apply_metric_mask(d.label_pair(t), d.mask(t))
    return _round(ag.region_statistics(d.stored(ag.contingency(masked))), *OVERLAP, *RATES)


@query("hausdorff", d.with_ctes(d.CELLS, d.PAIR, SIDES, f"""SELECT image_id, {R('sqrt(max(d2))')} AS hausdorff FROM
  (SELECT p.image_id, p.side, p.x, p.y, p.z, min({D2}) AS d2 FROM sides p JOIN sides q ON p.image_id = q.image_id AND p.side <> q.side GROUP BY ALL) GROUP BY 1"""))
def hausdorff(t):
    return _round(ag.hausdorff(d.stored(d.label_pair(t))), "hausdorff")


@query("hausdorff95", d.with_ctes(d.CELLS, d.PAIR, d.META, SIDES, f"border AS {border_sql('sides', 2)}",
       f"""dist AS (SELECT p.image_id, p.side, p.x, p.y, p.z, min((p.x-q.x)*(p.x-q.x)*spacing[1]*spacing[1]+(p.y-q.y)*(p.y-q.y)*spacing[2]*spacing[2]+(p.z-q.z)*(p.z-q.z)*spacing[3]*spacing[3]) AS d2
  FROM border p JOIN sides q ON p.image_id = q.image_id AND p.side <> q.side JOIN meta m ON m.image_id = p.image_id GROUP BY ALL)""",
       f"""SELECT image_id, {R('max(sqrt(d2))')} AS hd95 FROM (SELECT image_id, d2, row_number() OVER (PARTITION BY image_id, side ORDER BY d2) - 1 AS r,
  count(*) OVER (PARTITION BY image_id, side) AS n FROM dist) WHERE r = floor(0.95 * (n - 1)) GROUP BY 1"""))
def hausdorff95(t):
    return _round(ag.hausdorff95(d.stored(d.label_pair(t)), spacing=d.image_meta(t).select("image_id", "spacing")), "hd95")


@query("hausdorff95_pooled", d.with_ctes(d.CELLS, d.PAIR, SIDES, f"border AS {border_sql('sides', 1)}",
       f"""SELECT image_id, {R('quantile_cont(sqrt(d2), 0.95)')} AS hd95 FROM (SELECT p.image_id, p.side, p.x, p.y, p.z, min({D2}) AS d2
  FROM border p JOIN border q ON p.image_id = q.image_id AND p.side <> q.side GROUP BY ALL) GROUP BY 1"""))
def hausdorff95_pooled(t):
    return _round(ag.hausdorff95(d.stored(d.label_pair(t)), pooled=True), "hd95")


@query("region_hausdorff95", d.with_ctes(d.CELLS, d.PAIR, d.META, REGION_PAIR, REGION_SIDES, *REGION_FAR,
       f"SELECT image_id, region, {R(REGION_HD)} AS hausdorff95 FROM (SELECT image_id, region, sum(src) AS s, sum(tgt) AS t FROM regions GROUP BY 1, 2) "
       "JOIN meta USING (image_id) LEFT JOIN h USING (image_id, region)"))
def region_hausdorff95(t):
    found = ag.region_hausdorff95(d.stored(d.label_pair(t)), d.image_meta(t).select("image_id", "size"))
    return _round(found, "hausdorff95")


LONG_CELL = "'img' || (l_orderkey // 500) AS image_id, l_partkey % 64 AS x, l_suppkey % 64 AS y, (l_orderkey * 7 + l_linenumber) % 64 AS z"


@query("distance_long_axes", f"""WITH cells AS (SELECT DISTINCT {LONG_CELL}, l_linestatus AS side FROM lineitem)
SELECT p.image_id, p.x, p.y, p.z, CAST(min({D2}) AS DOUBLE) AS d2 FROM cells p JOIN cells q ON p.image_id = q.image_id AND p.side = 'O' AND q.side = 'F' GROUP BY ALL""")
def distance_long_axes(t):
    """Nearest shipped line of every open one in images with axes of 64 voxels."""
    number = F.col("l_orderkey")
    cells = d.stored(t.lineitem.select(F.concat(F.lit("img"), F.expr("l_orderkey div 500").cast("string")).alias("image_id"), (F.col("l_partkey") % 64).alias("x"),
                                       (F.col("l_suppkey") % 64).alias("y"), ((number * 7 + F.col("l_linenumber")) % 64).alias("z"), F.col("l_linestatus").alias("side")).distinct())
    return joins.nearest_squared(cells.where("side = 'O'"), cells.where("side = 'F'"))


FORMAT = "CASE WHEN {v} IS NULL THEN 'NaN' WHEN abs({v}) > 1e101 THEN 'INF' ELSE printf('%.6f', round({v}, 6) + 0.0) END"


@query("similarity_report_wide", d.with_ctes(d.CELLS, d.PAIR, VOLUMES, "SELECT image_id, CAST(label AS VARCHAR) AS label, "
       + ", ".join(f"{FORMAT.format(v=f'(({a}) / nullif({b}, 0))')} AS {m}" for m, (a, b) in OVERLAP.items()) + " FROM vol"))
def similarity_report_wide(t):
    metrics = _round(ag.label_overlap_by_label(_pair_table(t)), *OVERLAP).withColumn("label", F.col("label").cast("string"))
    return ag.similarity_report(metrics, True, label="label")


@query("similarity_report_long", d.with_ctes(d.CELLS, d.PAIR, VOLUMES, " UNION ALL ".join(
       f"SELECT image_id, CAST(label AS VARCHAR) AS label, '{m}' AS metric, {FORMAT.format(v=f'(({a}) / nullif({b}, 0))')} AS value FROM vol" for m, (a, b) in OVERLAP.items())))
def similarity_report_long(t):
    metrics = _round(ag.label_overlap_by_label(_pair_table(t)), *OVERLAP).withColumn("label", F.col("label").cast("string"))
    return ag.similarity_report(metrics, False, label="label")
