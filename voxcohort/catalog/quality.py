"""Quality control."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxcohort.catalog.regions import reach_sql, recursive
from voxcohort.catalog.registry import query
from voxcohort.operators import quality as qu
from voxcohort.plans import cohort
from voxcohort.plans import derive as d

FIRST = "first_header AS (SELECT subject_id, arg_min(path, path) AS first_path FROM headers GROUP BY 1)"
PAIRED = """paired AS (SELECT h.subject_id, h.path, h.size AS bs, f.size AS fs, h.origin AS bo, f.origin AS fo, h.spacing AS bp, f.spacing AS fp, h.direction AS bd, f.direction AS fd
  FROM headers h JOIN first_header USING (subject_id) JOIN headers f ON f.path = first_path)"""


def differs(a, b, percent=0):
    pair = f"list_transform(list_zip({a}, {b}), lambda p: coalesce(abs(p[1] - p[2]) / nullif(greatest(abs(p[1]), abs(p[2])), 0) * 100 > {percent}, false))"
    return f"(len({a}) <> len({b}) OR (len({a}) = len({b}) AND list_contains({pair}, true)))"


GEOMETRY = f"""concat_ws(', ', CASE WHEN {differs('flatten(fd)', 'flatten(bd)')} THEN 'direction' END, CASE WHEN {differs('fs', 'bs', 0.5)} THEN 'size' END,
  CASE WHEN {differs('fo', 'bo')} THEN 'origin' END, CASE WHEN {differs('fp', 'bp', 30)} THEN 'spacing' END)"""


@query("geometry_check", d.with_ctes(d.HEADERS, FIRST, PAIRED, f"SELECT subject_id, path, {GEOMETRY} AS mismatch, {GEOMETRY} = '' AS same_space FROM paired"))
def geometry_check(t):
    checked = qu.geometry_check(qu.pair_with_first(d.headers(t)), {"size": 0.5, "spacing": 30.0})
    return checked.select("subject_id", "path", "mismatch", "same_space")


SPACE = f"""concat_ws(', ', CASE WHEN bs <> [240, 240, 155] THEN 'NotStandardSize' END, CASE WHEN {differs('fs', 'bs')} THEN 'Size' END,
  CASE WHEN {differs('fo', 'bo')} THEN 'Origin' END, CASE WHEN {differs('fp', 'bp')} THEN 'Spacing' END)"""


@query("standard_space_check", d.with_ctes(d.HEADERS, FIRST, PAIRED, f"SELECT subject_id, path, {SPACE} AS mismatch FROM paired"))
def standard_space_check(t):
    return qu.space_against_first(d.headers(t))


UNEXPECTED = "SELECT image_id, label, count(*) AS voxels FROM (SELECT image_id, CAST(q % 6 AS INTEGER) AS label FROM cells) GROUP BY 1, 2 HAVING label NOT IN (0, 1, 2, 4) AND count(*) > 120"


@query("unexpected_labels", d.with_ctes(d.CELLS, UNEXPECTED))
def unexpected_labels(t):
    labelmap = d.cells(t).select(*d.VOXEL, (F.col("q") % 6).cast("int").alias("label"))
    return qu.unexpected_labels_of(labelmap, min_count=120)


COMPLETENESS = """complete AS (SELECT subject_id, count(DISTINCT CASE WHEN image_id % 7 < 4 THEN image_id % 7 END) AS scans, bool_or(image_id % 7 = 4) AS mask FROM headers GROUP BY 1),
  problems AS (SELECT *, CASE WHEN scans + mask::INT < 4 THEN 'fewer than 4 files' WHEN scans + mask::INT = 4 AND mask THEN 'mask instead of scan' ELSE '' END AS problem FROM complete)"""


@query("modality_completeness", d.with_ctes(d.HEADERS, COMPLETENESS, "SELECT * FROM problems"))
def modality_completeness(t):
    return qu.modality_completeness(d.headers(t))


def _candidates(t):
    method = F.element_at(F.array(*map(F.lit, ["fused_STAPLE_seg", "fused_ITKVoting_seg", "fused_MajorityVoting_seg", "fused_SIMPLE_seg", "other_seg"])), (F.col("l_linenumber") % 5 + 1).cast("int"))
    subject = F.concat(F.lit("sub"), (F.col("l_suppkey") * 10 + F.col("l_partkey") % 10).cast("string"))
    return t.lineitem.select(subject.alias("subject_id"), method.alias("name"), (F.col("l_quantity") > 48).alias("passed"))


CANDIDATES = "cand AS (SELECT 'sub' || (l_suppkey * 10 + l_partkey % 10) AS subject_id, l_linenumber % 5 AS m, l_quantity > 48 AS passed FROM lineitem)"
ADVICE = "advice AS (SELECT subject_id, coalesce(['staple', 'itkvoting', 'majorityvoting'][min(CASE WHEN passed AND m < 3 THEN m END) + 1], 'nnunet_or_deepscan') AS recommended FROM cand GROUP BY 1)"


@query("recommend_fusion", d.with_ctes(CANDIDATES, ADVICE, "SELECT * FROM advice"))
def recommend_fusion(t):
    return qu.recommend_fusion(_candidates(t))


LABELS = """lc AS (SELECT subject_id, CASE WHEN label = 3 AND top = 3 THEN 4 ELSE label END AS label, CAST(sum(voxels) AS BIGINT) AS voxels FROM
  (SELECT *, max(label) OVER (PARTITION BY subject_id) AS top FROM (SELECT 'sub' || (l_suppkey * 10 + l_linenumber) AS subject_id,
    CAST(l_partkey % CASE l_suppkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 7 END AS INTEGER) AS label, l_orderkey % 1500 AS voxels FROM lineitem)) GROUP BY 1, 2),
  odd AS (SELECT subject_id, label, voxels, row_number() OVER (PARTITION BY subject_id ORDER BY label) AS i FROM lc WHERE label NOT IN (0, 1, 2, 4) AND voxels > 1000)"""
STATE = """slots AS (SELECT subject_id, image_id % 7 AS slot, max(path) AS path FROM headers WHERE image_id % 7 < 5 GROUP BY 1, 2),
  held AS (SELECT subject_id, count(slot) AS n, coalesce(bool_or(slot = 4), false) AS mask, min(slot) AS first FROM (SELECT DISTINCT subject_id FROM headers) LEFT JOIN slots USING (subject_id) GROUP BY 1),
  complete AS (SELECT * FROM held WHERE n = 5 OR n = 4 AND NOT mask),
  bad AS (SELECT *, mask AND subject_id IN (SELECT subject_id FROM odd) AS strange, subject_id IN (SELECT subject_id FROM cand) AS folder,
    subject_id IN (SELECT subject_id FROM cand WHERE passed AND m < 4) AS passing FROM complete)"""
REPORT = """report AS (
  SELECT subject_id, 'All_required_modalities_are_not_present' AS problem, '' AS detail, 1 AS counted FROM held WHERE NOT (n = 5 OR n = 4 AND NOT mask) UNION ALL
  SELECT s.subject_id, 'geometry', 'Image_dimension/size/origin/spacing_mismatch_between_' || ['T1', 'T1CE', 'T2', 'FL'][first + 1] || '_and_' || ['T1', 'T1CE', 'T2', 'FL', 'MASK'][s.slot + 1], 1
    FROM complete c JOIN slots s ON s.subject_id = c.subject_id AND s.slot <> first JOIN slots f ON f.subject_id = c.subject_id AND f.slot = first
    JOIN headers a ON a.path = f.path JOIN headers b ON b.path = s.path
    WHERE a.size <> [240, 240, 155] OR b.dims <> 3 OR a.size <> b.size OR a.origin <> b.origin OR a.spacing <> b.spacing UNION ALL
  SELECT subject_id, 'unexpected label', label || ': ' || voxels, CAST(i = 1 AS INTEGER) FROM odd WHERE subject_id IN (SELECT subject_id FROM complete WHERE mask) UNION ALL
  SELECT DISTINCT subject_id, 'unusable fused map', ['fused_STAPLE_seg', 'fused_ITKVoting_seg', 'fused_MajorityVoting_seg', 'fused_SIMPLE_seg'][m + 1], 0 FROM cand JOIN bad USING (subject_id)
    WHERE (strange OR NOT mask) AND NOT passing AND m < 4 AND NOT cand.passed UNION ALL
  SELECT subject_id, 'SegmentationsForQC_folder_is_absent', '', 1 FROM bad WHERE (strange OR NOT mask) AND NOT folder UNION ALL
  SELECT subject_id, 'recommended fusion', coalesce(recommended, 'nnunet_or_deepscan'), 1 FROM bad LEFT JOIN advice USING (subject_id) WHERE NOT mask AND folder)"""


def _report(t):
    label = F.col("l_partkey") % F.when(F.col("l_suppkey") % 4 == 0, 4).when(F.col("l_suppkey") % 4 == 1, 3).otherwise(7)
    counts = t.lineitem.groupBy(F.concat(F.lit("sub"), (F.col("l_suppkey") * 10 + F.col("l_linenumber")).cast("string")).alias("subject_id"), label.cast("int").alias("label")).agg(
        F.sum(F.col("l_orderkey") % 1500).alias("voxels"))
    headers = d.headers(t)
    return cohort.cohort_qc(headers, headers, counts, _candidates(t))


@query("cohort_qc", d.with_ctes(d.HEADERS, LABELS, CANDIDATES, ADVICE, STATE, REPORT, "SELECT * FROM report"))
def cohort_qc(t):
    return _report(t)


@query("problem_count", d.with_ctes(d.HEADERS, LABELS, CANDIDATES, ADVICE, STATE, REPORT, "SELECT CAST(sum(counted) AS BIGINT) AS problem_cases FROM report"))
def problem_count(t):
    return cohort.problem_count(_report(t))


DARK = "shifted AS (SELECT image_id, x, y, z, value - 40 AS value FROM voxels), dark AS (SELECT image_id, x, y, z FROM shifted WHERE value < 0)"


@query("negative_intensity_check", recursive(d.VOXELS, DARK, *reach_sql("dark"), "SELECT image_id, max(size) AS largest FROM comp GROUP BY 1 HAVING max(size) >= 80"))
def negative_intensity_check(t):
    return qu.negative_intensity_check(d.voxels(t).withColumn("value", F.col("value") - 40), 80)


@query("repair_negatives", recursive(d.VOXELS, DARK, *reach_sql("dark"), "blob AS (SELECT image_id, max(size) AS largest FROM comp GROUP BY 1)",
       """SELECT image_id, x, y, z, CASE WHEN coalesce(largest, 0) < 80 AND lo < 0 AND value <> 0 THEN value - lo ELSE value END AS value FROM
  (SELECT *, min(value) OVER (PARTITION BY image_id) AS lo FROM shifted) LEFT JOIN blob USING (image_id)"""))
def repair_negatives(t):
    return qu.repair_negatives(d.stored(d.voxels(t).withColumn("value", F.col("value") - 40)), 80)


@query("preparation_plan", """SELECT CAST(c_custkey AS VARCHAR) AS "ID", c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))""")
def preparation_plan(t):
    key = F.col("o_custkey").cast("string")
    outputs = t.orders.select(
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(key, F.lit("_brain_t1.nii.gz")))
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat(key, F.lit("_t1.nii.gz"))).otherwise(F.concat(key, F.lit("_x.nii.gz"))).alias("output"))
    manifest = t.customer.select(F.col("c_custkey").cast("string").alias("ID"), "c_name")
    return cohort.preparation_plan(manifest, outputs)
