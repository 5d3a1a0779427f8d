"""Manifests, labelled lists, matrices, inventories and score files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from voxcohort.catalog.registry import query, rounded
from voxcohort.plans import derive as d
from voxcohort.session import ensure_checkpoint_dir
from voxcohort.sources import inventories as inv
from voxcohort.sources import manifests as man


@query("resolve_manifest", """SELECT c_custkey || '' AS "ID", '/d/' || c_custkey || '_t1ce' AS "T1GD", '/d/' || c_custkey || '_t1' AS "T1",
  '/d/' || c_custkey || '_t2' AS "T2", '/d/' || c_custkey || '_' || c_mktsegment AS "FLAIR" FROM customer""")
def resolve_manifest(t):
    return man.resolve_manifest(_manifest(t))


def _manifest(t):
    key = F.col("c_custkey").cast("string")
    name = lambda suffix: F.concat(F.lit("/d/"), key, F.lit("_"), suffix)
    return t.customer.select(key.alias("Subject-ID"), name(F.lit("t2")).alias("T2"), name(F.col("c_mktsegment")).alias("T2_FLAIR"),
                             name(F.lit("t1")).alias("T1-pre"), name(F.lit("t1ce")).alias("T1_Post"))


@query("labeled_rows", f"""SELECT p_partkey, '/root/' || p_name || '|' || '/root/' || p_type AS images, {rounded('p_size')} AS size_label, p_retailprice AS price_label,
  0.0::DOUBLE AS text_label FROM part""")
def labeled_rows(t):
    raw = t.part.select("p_partkey", F.concat(F.lit('"'), F.col("p_name"), F.lit('"')).alias("image_a"), F.col("p_type").alias("image_b"),
                        F.concat(F.lit('"'), F.col("p_size").cast("string"), F.lit(' cm"')).alias("size"),
                        F.col("p_retailprice").cast("string").alias("price"), F.col("p_brand").alias("text"))
    rows = man.labeled_rows(raw, ["image_a", "image_b"], prefix="/root/")
    labels = F.col("labels")
    return rows.select("p_partkey", F.array_join("images", "|").alias("images"), labels[0].alias("size_label"),
                       labels[1].alias("price_label"), labels[2].alias("text_label"))


def _lines(t):
    cells = F.concat_ws(",", F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string"), F.col("s_acctbal").cast("string"), F.col("s_name"))
    return t.supplier.select(F.col("s_suppkey").alias("line"), F.concat(cells, F.lit("\r")).alias("value"))


@query("matrix_cells", """SELECT s_suppkey AS row, 0 AS col, CAST(s_suppkey AS DOUBLE) AS value FROM supplier UNION ALL SELECT s_suppkey, 1, s_nationkey FROM supplier
  UNION ALL SELECT s_suppkey, 2, s_acctbal FROM supplier UNION ALL SELECT s_suppkey, 3, 0 FROM supplier""")
def matrix_cells(t):
    return man.matrix_cells(_lines(t))


@query("matrix_vectors", """SELECT n_regionkey AS col, string_agg(n_name, '|' ORDER BY n_nationkey) AS vector FROM nation GROUP BY 1""")
def matrix_vectors(t):
    cells = t.nation.select(F.col("n_nationkey").alias("row"), F.col("n_regionkey").alias("col"), F.col("n_name").alias("value"))
    return man.matrix_vectors(cells, column_major=True).select("col", F.array_join("vector", "|").alias("vector"))


@query("matrix_table", """SELECT CAST(o_custkey AS VARCHAR) AS " ", """ + ", ".join(
       f"""printf('%.6f', CAST(sum(CASE WHEN o_orderkey % 3 = {i} THEN o_orderkey % 101 ELSE 0 END) AS DOUBLE)) AS "{i}" """ for i in range(3)) + " FROM orders GROUP BY 1")
def matrix_table(t):
    cells = t.orders.groupBy(F.col("o_custkey").alias("row")).agg(*[
        F.sum(F.when(F.col("o_orderkey") % 3 == i, F.col("o_orderkey") % 101).otherwise(0)).cast("double").alias(str(i)) for i in range(3)])
    long = cells.unpivot(["row"], [str(i) for i in range(3)], "col", "value")
    return man.matrix_table(long, ["0", "1", "2"])


@query("split_index", """SELECT CAST(i - 1 AS BIGINT) AS "index", cell FROM (SELECT row_number() OVER (ORDER BY page_id, pos) - 1 AS i, cell FROM
  (SELECT page_id, unnest(range(len(c))) AS pos, unnest(c) AS cell FROM (SELECT page_id, string_split(replace(html, chr(13), ''), ',') AS c FROM pages))) WHERE i > 0""")
def split_index(t):
    return man.split_index(t.pages, "page_id", "html")


REGIONS, MEASURES = ("WT", "TC", "ET"), ("Dice", "Hausdorff95", "Sensitivity", "Specificity")


def _scores(t, source):
    """Long score table: one score per subject, architecture, region and measure.

    New scores have all twelve of each order's subject. Stored ones come from single line items, so that some subjects lack some.
    """
    named = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    subject = lambda s: F.concat(F.lit("sub"), s.cast("string")).alias("subject")
    score = lambda o, k: F.max((o * 7 + k) % 1000 / F.lit(1000.0))
    if source == "new":
        # the twelve scores of a subject and architecture come from one group and become rows afterwards
        o = F.col("o_orderkey")
        wide = t.orders.groupBy(subject(F.col("o_custkey")), named(["archA", "archB", "archC"], o % 5 % 3).alias("arch")).agg(
            *[score(o, F.lit(k)).alias(f"k{k}") for k in range(12)])
        scores = [F.struct(F.lit(REGIONS[k // 4]).alias("region"), F.lit(MEASURES[k % 4]).alias("measure"), F.col(f"k{k}").alias("value")) for k in range(12)]
        return wide.select("subject", "arch", F.inline(F.array(*scores)))
    k = F.col("k")
    rows = t.lineitem.select((F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("s"), F.col("l_orderkey").alias("o"), (F.col("l_partkey") % 12).alias("k"))
    return rows.groupBy(subject(F.col("s")), named(["archA", "archB", "archC"], F.col("o") % 5 % 3).alias("arch"),
                        named(REGIONS, F.floor(k / 4)).alias("region"), named(MEASURES, k % 4).alias("measure")).agg(score(F.col("o"), k).alias("value"))


def scores_sql(source):
    rows = ("SELECT o_custkey AS s, o_orderkey AS o, k FROM orders, (SELECT unnest(range(12)) AS k)" if source == "new"
            else "SELECT l_suppkey * 10 + l_linenumber AS s, l_orderkey AS o, l_partkey % 12 AS k FROM lineitem")
    return (f"{source} AS (SELECT 'sub' || s AS subject, ['archA','archB','archC'][o % 5 % 3 + 1] AS arch, ['WT','TC','ET'][k // 4 + 1] AS region, "
            f"['Dice','Hausdorff95','Sensitivity','Specificity'][k % 4 + 1] AS measure, max((o * 7 + k) % 1000 / 1000.0::DOUBLE) AS value FROM ({rows}) GROUP BY ALL)")


@query("merge_cached_metrics", d.with_ctes(scores_sql("new"), scores_sql("cache"), """keyed AS (SELECT subject, arch, sum(h) AS have, max(f) AS fresh FROM
  (SELECT subject, arch, 1 AS h, 0 AS f FROM cache UNION ALL SELECT subject, arch, 0, 1 FROM new) GROUP BY 1, 2)""",
       "SELECT c.*, 'cache' AS origin FROM cache c JOIN keyed USING (subject, arch) WHERE have = 12 OR fresh = 0 UNION ALL "
       "SELECT n.*, 'new' FROM new n JOIN keyed USING (subject, arch) WHERE have <> 12"))
def merge_cached_metrics(t):
    return man.merge_cached_metrics(_scores(t, "new"), _scores(t, "cache"))


def _json_level(inner, key):
    return f"""'{{' || string_agg('"' || {key} || '":' || {inner}, ',' ORDER BY {key}) || '}}'"""


@query("validation_tree", d.with_ctes(scores_sql("new"), f"""SELECT subject, {_json_level('r', 'arch')} AS json FROM
  (SELECT subject, arch, {_json_level('m', 'region')} AS r FROM (SELECT subject, arch, region, {_json_level("'\"' || printf('%.6f', value) || '\"'", 'measure')} AS m
   FROM new GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1"""))
def validation_tree(t):
    return man.validation_tree(_scores(t, "new"))


@query("subject_summary", d.with_ctes(scores_sql("new"), "SELECT subject, arch, " + ", ".join(
       f"coalesce(max(CASE WHEN region = '{r}' AND measure = '{m}' THEN value END), -1) AS {r}_{m}" for r in ("WT", "TC", "ET") for m in ("Dice", "Hausdorff95", "Sensitivity", "Specificity"))
       + " FROM new GROUP BY 1, 2"))
def subject_summary(t):
    from voxcohort.plans.cohort import subject_summary as summary
    return summary(_scores(t, "new")).fillna(-1.0)


# --- files written and read back --------------------------------------------------------------

def _folder(t):
    """A new folder among those that all executors share."""
    ensure_checkpoint_dir(t.spark)
    return f"{t.spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


@query("manifest_files", """SELECT c_custkey || '' AS "ID", '/d/' || c_custkey || '_t1ce' AS "T1GD", '/d/' || c_custkey || '_t1' AS "T1",
  '/d/' || c_custkey || '_t2' AS "T2", '/d/' || c_custkey || '_' || c_mktsegment AS "FLAIR" FROM customer""")
def manifest_files(t):
    """A manifest read from CSV parts with its own header spellings."""
    path = _folder(t)
    _manifest(t).write.csv(path, header=True)
    return man.read_manifest(t.spark, path)


@query("labeled_files", f"""SELECT '/root/' || p_name || '|' || '/root/' || p_type AS images, {rounded('p_size')} AS size_label, p_retailprice AS price_label FROM part""")
def labeled_files(t):
    path = _folder(t)
    t.part.select(F.col("p_name").alias("image_a"), F.col("p_type").alias("image_b"), F.concat(F.col("p_size").cast("string"), F.lit(" cm")).alias("size"),
                  F.col("p_retailprice").cast("string").alias("price")).write.csv(path, header=True)
    rows = man.read_labeled_csv(t.spark, path, ["image_a", "image_b"], prefix="/root/")
    return rows.select(F.array_join("images", "|").alias("images"), F.col("labels")[0].alias("size_label"), F.col("labels")[1].alias("price_label"))


@query("matrix_files", """WITH lines AS (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS row FROM supplier)
  SELECT row, 0 AS col, CAST(s_suppkey AS DOUBLE) AS value FROM lines UNION ALL SELECT row, 1, s_nationkey FROM lines
  UNION ALL SELECT row, 2, s_acctbal FROM lines UNION ALL SELECT row, 3, 0 FROM lines""")
def matrix_files(t):
    """A matrix in several text files of unequal length; its rows are numbered from file to file."""
    path = _folder(t)
    _lines(t).repartitionByRange(5, "line").sortWithinPartitions("line").select("value").write.text(path)
    return man.read_matrix(t.spark, path)


@query("validation_files", d.with_ctes(scores_sql("new"), f"SELECT subject, arch, region, measure, {rounded('value')} AS value FROM new"))
def validation_files(t):
    """Scores written as one JSON document a subject and read back."""
    path = _folder(t)
    man.write_validation(_scores(t, "new"), path)
    document = F.from_json("value", "subject string, scores map<string, map<string, map<string, string>>>").alias("d")
    rows = t.spark.read.text(path).select(document).select("d.subject", F.explode("d.scores").alias("arch", "r"))
    rows = rows.select("subject", "arch", F.explode("r").alias("region", "m")).select("subject", "arch", "region", F.explode("m").alias("measure", "value"))
    return rows.withColumn("value", F.col("value").cast("double"))


# --- inventories ------------------------------------------------------------------------------

def _catalogue_sql(where):
    columns = ", ".join(f"coalesce(CAST({p}[{i + 1}] AS VARCHAR), '') AS \"{p.capitalize()}_{i}\"" for p in ("spacing", "size", "origin") for i in range(4))
    return d.with_ctes(d.HEADERS, f"SELECT path AS \"File\", {columns} FROM headers WHERE {where}")


@query("image_catalogue", _catalogue_sql("path LIKE '%.nii.gz' AND split_part(path, '/', -1) LIKE '%t1%'"))
def image_catalogue(t):
    return inv.image_catalogue(d.headers(t), "t1", ".nii.gz")


@query("image_catalogue_no_extension", _catalogue_sql("split_part(path, '/', -1) NOT LIKE '%.%'"))
def image_catalogue_no_extension(t):
    return inv.image_catalogue(d.headers(t), ext="noExt")


@query("image_information", d.with_ctes(d.HEADERS, """SELECT image_id, unnest(['Dimensions', 'Size', 'Total', 'Origin', 'Spacing', 'Directions']) AS "Property",
  unnest([CAST(dims AS VARCHAR), array_to_string(size, 'x'), CAST(CAST(list_product(size) AS BIGINT) AS VARCHAR), array_to_string(origin, 'x'), array_to_string(spacing, 'x'),
  array_to_string(list_transform(direction, lambda r: array_to_string(r, 'x')), ';')]) AS "Value" FROM headers"""))
def image_information(t):
    return inv.image_information(d.headers(t))


def _tags(t):
    entry = lambda label, value: F.struct(F.lit(label).alias("label"), value.cast("string").alias("value"))
    base = F.create_map(F.lit("0010|0010"), entry("PatientName", F.col("c_name")), F.lit("0010|0020"), entry("PatientID", F.col("c_custkey")))
    extra = F.create_map(F.lit("0008|0060"), entry("Modality", F.col("c_mktsegment")))
    return t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, base).otherwise(F.map_concat(base, extra)).alias("tags"))


@query("dicom_tags", """SELECT c_custkey, '0010|0010' AS tag, 'PatientName' AS label, c_name AS value FROM customer UNION ALL
  SELECT c_custkey, '0010|0020', 'PatientID', CAST(c_custkey AS VARCHAR) FROM customer UNION ALL
  SELECT c_custkey, '0008|0060', 'Modality', c_mktsegment FROM customer WHERE c_custkey % 3 <> 0""")
def dicom_tags(t):
    return inv.dicom_tags(_tags(t), "c_custkey").orderBy("c_custkey", "tag")


@query("tag_value", """SELECT c_custkey, c_custkey % 3 <> 0 AS found, CASE WHEN c_custkey % 3 <> 0 THEN 'Modality' ELSE '' END AS tag_label,
  CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment ELSE '' END AS tag_value FROM customer""")
def tag_value(t):
    return inv.tag_value(_tags(t), "0008|0060").drop("tags")


# Fixed values, written down once more for the SQL: the words of a name, in the order in which they are tried.
MODALITY_CASES = r"""CASE WHEN regexp_matches(s, 't1ce|t1gd|t1gad|t1-ce|t1-gd|t1-gad') THEN 'T1CE' WHEN regexp_matches(s, 't1') THEN 'T1'
  WHEN regexp_matches(s, 't2') AND regexp_matches(s, 'flair') THEN 'FLAIR' WHEN regexp_matches(s, 't2') THEN 'T2' WHEN regexp_matches(s, 'flair') THEN 'FLAIR'
  WHEN regexp_matches(s, 'dti|b0') THEN 'DTI' WHEN regexp_matches(s, 'rad') THEN 'RAD' WHEN regexp_matches(s, 'ax') THEN 'AX' WHEN regexp_matches(s, 'fractional|fa') THEN 'FA'
  WHEN regexp_matches(s, 'tr') THEN 'TR' WHEN regexp_matches(s, 'rcbv') THEN 'RCBV' WHEN regexp_matches(s, 'psr') THEN 'PSR' WHEN regexp_matches(s, 'ph') THEN 'PH'
  WHEN regexp_matches(s, 'perf|dsc') THEN 'PERFUSION' WHEN regexp_matches(s, 'ct') THEN 'CT' WHEN regexp_matches(s, 'pet') THEN 'PET'
  WHEN regexp_matches(s, 'label|segmentation|annotation|roi') THEN 'SEG' ELSE 'UNDEFINED' END"""
STRICT_CASES = r"""CASE WHEN regexp_matches(s, 't1ce|t1-gad|t1-ce|t1-gd|_t1gd|t1gd_|t1gd\.nii\.gz') THEN 'T1CE' WHEN regexp_matches(s, '_t1|t1_|t1\.nii\.gz') THEN 'T1'
  WHEN regexp_matches(s, '_t2|t2_|t2\.nii\.gz') AND regexp_matches(s, 'flair') THEN 'FLAIR' WHEN regexp_matches(s, '_t2|t2_|t2\.nii\.gz') THEN 'T2'
  WHEN regexp_matches(s, '_flair|flair_|\.flair\.|flair\.nii\.gz|fl\.nii\.gz') THEN 'FLAIR' WHEN regexp_matches(s, '_dti|dti_|_b0|b0_') THEN 'DTI'
  WHEN regexp_matches(s, '_rad|rad_|radial_|radial\.nii\.gz|rad\.nii\.gz') THEN 'RAD' WHEN regexp_matches(s, '_ax|ax_|axial_|axial\.nii\.gz|ax\.nii\.gz') THEN 'AX'
  WHEN regexp_matches(s, '_fa|fa_|fractional_|_fractional|fractional\.nii\.gz|fa\.nii\.gz') THEN 'FA' WHEN regexp_matches(s, '_tr|tr_|trace_|trace\.nii\.gz|tr\.nii\.gz') THEN 'TR'
  WHEN regexp_matches(s, 'rcbv') THEN 'RCBV' WHEN regexp_matches(s, 'psr') THEN 'PSR' WHEN regexp_matches(s, 'ph') THEN 'PH' WHEN regexp_matches(s, 'perf') THEN 'PERFUSION'
  WHEN regexp_matches(s, 'label|segmentation') THEN 'SEG' WHEN regexp_matches(s, 'ct2pet|_ct\.') THEN 'CT' WHEN regexp_matches(s, '_pet|pet_') THEN 'PET' ELSE 'UNDEFINED' END"""


@query("guess_modality", f"SELECT id, {MODALITY_CASES} AS modality FROM (SELECT 'd' || doc_id AS id, lower(text) AS s FROM documents "
       "UNION ALL SELECT 'p' || page_id, lower(url) FROM pages)")
def guess_modality(t):
    names = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("s")).unionByName(
        t.pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("url").alias("s")))
    return names.select("id", inv.guess_modality(F.col("s")).alias("modality"))


@query("guess_modality_strict", d.with_ctes(d.HEADERS, f"SELECT id, {STRICT_CASES} AS modality FROM (SELECT 'h' || image_id AS id, lower(split_part(path, '/', -1)) AS s FROM headers "
       "UNION ALL SELECT 'p' || page_id, lower(split_part(url, '/', -1)) FROM pages)"))
def guess_modality_strict(t):
    names = d.headers(t).select(F.concat(F.lit("h"), F.col("image_id").cast("string")).alias("id"), F.col("path").alias("s")).unionByName(
        t.pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("url").alias("s")))
    return names.select("id", inv.guess_modality(F.col("s"), strict=True).alias("modality"))


SLOTS = {"T1GD": "_t1ce.nii.gz", "T1": "_t1.nii.gz", "T2": "_t2.nii.gz", "FLAIR": "_flair.nii.gz"}
INVENTORY = "inventory AS (SELECT subject_id, " + ", ".join(
    f"min(CASE WHEN path LIKE '%{s.replace('_', chr(92) + '_')}' ESCAPE '\\' THEN path END) AS {n}" for n, s in SLOTS.items()) + " FROM headers GROUP BY 1)"


@query("subject_inventory", d.with_ctes(d.HEADERS, INVENTORY, "SELECT subject_id, " + ", ".join(f"coalesce({n}, '') AS {n}" for n in SLOTS) + " FROM inventory"))
def subject_inventory(t):
    return inv.subject_inventory(d.headers(t)).fillna("")


@query("missing_slots", d.with_ctes(d.HEADERS, INVENTORY, " UNION ALL ".join(
       f"SELECT subject_id AS \"SubjectID\", '{n}' AS \"Modality\" FROM inventory WHERE {n} IS NULL" for n in SLOTS)))
def missing_slots(t):
    return inv.missing_slots(inv.subject_inventory(d.headers(t)))


@query("qualified_subjects", d.with_ctes(d.HEADERS, "SELECT subject_id FROM headers WHERE image_id % 7 IN (0, 1, 4) GROUP BY 1 HAVING count(DISTINCT image_id % 7) = 3"))
def qualified_subjects(t):
    kind = F.element_at(F.array(*map(F.lit, ["t1", "t1ce", "t2", "flair", "seg", "dcm", "none"])), (F.col("image_id") % 7 + 1).cast("int"))
    return inv.qualified_subjects(d.headers(t).withColumn("kind", kind), ["t1", "t1ce", "seg"])


@query("pending_work", "SELECT 'a' || c_custkey AS first_name, 'b' || c_custkey AS second_name, c_custkey FROM customer WHERE 'a' || c_custkey NOT IN "
       "(SELECT 'a' || o_custkey FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'F') AND 'b' || c_custkey NOT IN "
       "(SELECT 'b' || o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O')")
def pending_work(t):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    plan = t.customer.select(name("a", "c_custkey").alias("first_name"), name("b", "c_custkey").alias("second_name"), "c_custkey")
    # every order leaves a file; those of other names are no output that was planned
    is_ = lambda priority, status: (F.col("o_orderpriority") == priority) & (F.col("o_orderstatus") == status)
    kind = F.when(is_("5-LOW", "F"), "a").when(is_("1-URGENT", "O"), "b").otherwise("log")
    outputs = t.orders.select(F.concat(kind, F.col("o_custkey").cast("string")).alias("output"))
    return inv.pending_work(plan, outputs, ["first_name", "second_name"])


@query("error_rollup", """SELECT user_id AS "SubjectID", CASE WHEN event_id % 2 = 0 THEN 'Inference' ELSE 'Fusion' END AS "Application",
  string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS "Algorithms" FROM events WHERE value < 20 GROUP BY 1, 2""")
def error_rollup(t):
    runs = t.events.select(F.col("user_id").alias("SubjectID"), F.when(F.col("event_id") % 2 == 0, "Inference").otherwise("Fusion").alias("Application"),
                           F.col("event_type").alias("Algorithm"), "value")
    return inv.error_rollup(runs, failed=F.col("value") < 20)


LISTED = "listed AS (SELECT path, CAST(h.dims * 1000 + image_id % 977 AS BIGINT) AS length, subject_id FROM headers h)"


def _listed(t):
    return d.headers(t).select("path", (F.col("dims") * 1000 + F.col("image_id") % 977).cast("long").alias("length"), "subject_id", "image_id")


@query("folder_sizes", d.with_ctes(d.HEADERS, LISTED, """SELECT folder, CAST(sum(length) AS BIGINT) AS bytes FROM (SELECT array_to_string(p[:n], '/') AS folder, length FROM
  (SELECT string_split(path, '/') AS p, length, unnest(range(2, len(string_split(path, '/')))) AS n FROM listed)) GROUP BY 1"""))
def folder_sizes(t):
    return inv.folder_sizes(_listed(t))


@query("fits_limit", d.with_ctes(d.HEADERS, LISTED, "SELECT CAST(sum(length) AS BIGINT) AS bytes, sum(length) <= 40000000 AS fits FROM listed"))
def fits_limit(t):
    return inv.fits_limit(_listed(t), 40_000_000)


@query("series_check", d.with_ctes(d.HEADERS, """SELECT f.folder, series, path, n AS series_count, n > 1 AS multiple_series FROM
  (SELECT regexp_extract(path, '^(.*)/', 1) AS folder, 'ser' || (image_id % 2) AS series, path FROM headers) f JOIN
  (SELECT regexp_extract(path, '^(.*)/', 1) AS folder, count(DISTINCT image_id % 2) AS n FROM headers GROUP BY 1) g ON f.folder = g.folder"""))
def series_check(t):
    slices = _listed(t).select("path", F.concat(F.lit("ser"), (F.col("image_id") % 2).cast("string")).alias("series"))
    return inv.series_check(slices)
