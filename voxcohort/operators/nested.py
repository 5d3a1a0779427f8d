"""Structured measurement reports, code tables, frames and segment descriptions."""

from __future__ import annotations

import json as jsonlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxcohort.functions import geometry
from voxcohort.operators.ordering import WHOLE_ROWS, large_groups, rank_in_group
from voxcohort.operators.voxels import with_index
from voxcohort.session import attach, fits_broadcast, join_summary, settle

IMAGE = ["image_id"]

# Field names of the report and segment documents.
CODE = "struct<CodeValue:string,CodingSchemeDesignator:string,CodeMeaning:string>"
ALGORITHM = "struct<AlgorithmName:string,AlgorithmVersion:string,AlgorithmParameters:array<string>>"
ITEM = (f"struct<value:string,quantity:{CODE},units:{CODE},derivationModifier:{CODE},derivationParameters:array<struct<"
        f"derivationParameter:{CODE},derivationParameterValue:string,derivationParameterUnits:{CODE}>>,"
        f"otherModifiers:array<struct<modifier:{CODE},modifierValue:{CODE}>>>")
GROUP = (f"struct<TrackingIdentifier:string,TrackingUniqueIdentifier:string,ReferencedSegment:int,Finding:{CODE},FindingSite:{CODE},"
         f"Laterality:{CODE},measurementAlgorithmIdentification:{ALGORITHM},measurementItems:array<{ITEM}>,"
         f"qualitativeEvaluations:array<struct<conceptCode:{CODE},conceptValue:string>>>")
REPORT = f"struct<SeriesDescription:string,SeriesNumber:string,activitySession:string,timePoint:string,Measurements:array<{GROUP}>>"


def flatten_report(reports: DataFrame, json: str = "json") -> DataFrame:
    """One row per measurement item or qualitative evaluation, with the attributes of its group."""
    keys = [c for c in reports.columns if c != json]
    parsed = reports.select(*keys, F.explode_outer(F.from_json(json, REPORT)["Measurements"]).alias("g"))
    empty = lambda t: F.array().cast(f"array<{t}>")
    code = lambda c, n: c[n]["CodeMeaning"]
    numeric = F.transform(F.coalesce("g.measurementItems", empty(ITEM)), lambda m: F.struct(
        F.lit("numeric").alias("kind"), m["value"].alias("value"), code(m, "quantity").alias("quantity"), m["units"]["CodeValue"].alias("units"),
        code(m, "derivationModifier").alias("derivation"),
        F.array_join(F.transform(m["derivationParameters"], lambda p: F.concat_ws("=", p["derivationParameter"]["CodeMeaning"], p["derivationParameterValue"])), ";").alias("derivation_parameters"),
        F.array_join(F.transform(m["otherModifiers"], lambda o: F.concat_ws("=", o["modifier"]["CodeMeaning"], o["modifierValue"]["CodeMeaning"])), ";").alias("other_modifiers")))
    # a coded value is an object and a text value a plain string; both arrive as text here
    meaning = lambda v: F.coalesce(F.get_json_object(v, "$.CodeMeaning"), v)
    none = F.lit(None).cast("string")
    qualitative = F.transform(F.coalesce("g.qualitativeEvaluations", empty(f"struct<conceptCode:{CODE},conceptValue:string>")), lambda q: F.struct(
        F.lit("qualitative").alias("kind"), meaning(q["conceptValue"]).alias("value"), q["conceptCode"]["CodeMeaning"].alias("quantity"),
        none.alias("units"), none.alias("derivation"), none.alias("derivation_parameters"), none.alias("other_modifiers")))
    rows = parsed.select(
        *keys, F.col("g.TrackingIdentifier").alias("tracking"), F.col("g.ReferencedSegment").alias("segment"),
        F.col("g.Finding.CodeMeaning").alias("finding"), F.col("g.FindingSite.CodeMeaning").alias("finding_site"),
        F.col("g.Laterality.CodeMeaning").alias("laterality"), F.col("g.measurementAlgorithmIdentification.AlgorithmName").alias("algorithm"),
        F.explode_outer(F.concat(numeric, qualitative)).alias("m"))
    return rows.select(*[c for c in rows.columns if c != "m"], "m.*")


def fitting_number(value: Column) -> Column:
    """Number text of at most 16 characters: cut behind the decimal point, else an error."""
    text = value.cast("string")
    point = F.instr(text, ".")
    message = F.concat(F.lit("value does not fit 16 characters: "), text)
    return (F.when(F.length(text) <= 16, text).when((point > 0) & (point < 16), F.substring(text, 1, 16))
            .otherwise(F.raise_error(message).cast("string")))


def build_report(items: DataFrame, report: str = "report_id", group: Sequence[str] = ("tracking", "segment", "finding", "finding_site"),
                 order: str = "item", attributes: dict[str, str] | None = None) -> DataFrame:
    """One JSON document per report: items (value, quantity, units) gathered into measurement groups.

    A document is whole by its nature; items are gathered per group first and groups per report.
    """
    item = F.struct(order, fitting_number(F.col("value")).alias("value"), "quantity", "units")
    groups = items.groupBy(report, *group).agg(F.array_sort(F.collect_list(item)).alias("items"))
    plain = F.transform("items", lambda i: F.struct(i["value"].alias("value"), i["quantity"].alias("quantity"), i["units"].alias("units")))
    names = ("TrackingIdentifier", "ReferencedSegment", "Finding", "FindingSite")
    entry = F.struct(*[F.col(g).alias(n) for g, n in zip(group, names)], plain.alias("measurementItems"))
    constant = {"SeriesDescription": "Measurements", "InstanceNumber": "1", "VerificationFlag": "VERIFIED", "CompletionFlag": "COMPLETE",
                "activitySession": "1", **(attributes or {})}
    documents = groups.groupBy(report).agg(F.array_sort(F.collect_list(entry)).alias("Measurements"))
    return documents.select(report, F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in constant.items()], "Measurements")).alias("json"))


def mapped_value_range(image: DataFrame, keys: Sequence[str] = IMAGE, value: str = "value") -> DataFrame:
    return image.groupBy(*keys).agg(F.min(value).alias("first_mapped"), F.max(value).alias("last_mapped"))


def label_attribute_match(labels: DataFrame, attributes: DataFrame, on: Sequence[str] = ("file", "label")) -> DataFrame:
    """Labels without metadata; an empty result means that all match."""
    return labels.select(*on).distinct().join(attributes.select(*on), list(on), "left_anti")


# --- code tables ------------------------------------------------------------------------------

def code_term(text: Column) -> dict[str, Column]:
    """(code,scheme,"meaning") split up; all parts empty on a mismatch. The meaning keeps its quotes."""
    pattern = r'\((.*),(.*),(".*")\)'
    return {"code": F.regexp_extract(text, pattern, 1), "scheme": F.regexp_extract(text, pattern, 2), "meaning": F.regexp_extract(text, pattern, 3)}


def colour(text: Column) -> Column:
    """rgb(r,g,b) as "r,g,b", or empty."""
    return F.regexp_replace(F.regexp_extract(text, r"(rgb\([0-9]*,[0-9]*,[0-9]*\))", 1), r"^rgb\(|\)$", "")


def tree_entries(tree: DataFrame, column: str = "tree") -> DataFrame:
    """Leaves of a category → type → modifier tree with their composite key."""
    keys = [c for c in tree.columns if c != column]
    types = tree.select(*keys, F.col(f"{column}.codeValue").alias("category"), F.explode(f"{column}.Type").alias("t"))
    leaves = types.select(*keys, "category", F.col("t.codeValue").alias("type"), F.explode_outer("t.Modifier").alias("m"))
    modifier = F.coalesce("m.codeValue", F.lit(""))
    return leaves.select(*keys, F.concat_ws(",", "category", "type", modifier).alias("key"), "category", "type", modifier.alias("modifier"))


def colour_entries(rows: DataFrame, category: str, kind: str, modifier: str, name: str, rgb: str) -> DataFrame:
    """Composite key, name and colour of each CSV row with a valid category; of repeated keys the largest name is kept."""
    code = lambda c: code_term(F.col(c))["code"]
    valid = rows.where(code(category) != "").select(
        F.concat_ws(",", code(category), code(kind), code(modifier)).alias("key"), F.trim(name).alias("name"), colour(F.col(rgb)).alias("rgb"))
    return valid.groupBy("key").agg(F.max(F.struct("name", "rgb")).alias("e")).select("key", "e.*")


def join_codes(entries: DataFrame, colours: DataFrame) -> DataFrame:
    """Full outer match of tree leaves and colours: side is matched, tree only or table only."""
    joined = entries.withColumn("_t", F.lit(1)).join(colours.withColumn("_c", F.lit(1)), "key", "full")
    side = F.when(F.col("_t").isNull(), "table only").when(F.col("_c").isNull(), "tree only").otherwise("matched")
    return joined.select("key", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("rgb", F.lit("")).alias("rgb"), side.alias("side"))


def prune_code_tree(tree: DataFrame, column: str = "tree", label: str = "label") -> DataFrame:
    """Keep modifiers with a label, types with a label or modifiers, and categories with types."""
    labelled = lambda e: e[label].isNotNull()
    trimmed = F.transform(F.col(f"{column}.Type"), lambda t: t.withField("Modifier", F.filter(t["Modifier"], labelled)))
    kept = F.filter(trimmed, lambda t: labelled(t) | (F.coalesce(F.size(t["Modifier"]), F.lit(0)) > 0))
    pruned = tree.withColumn(column, F.col(column).withField("Type", kept))
    return pruned.where(F.size(F.col(f"{column}.Type")) > 0)


# --- JSON comparison --------------------------------------------------------------------------

def differing_json(expected: Column, actual: Column, ignore_keys: Sequence[str] = (), contains: bool = True) -> Column:
    """Two JSON texts (_e, _a) in sorted form, without what agrees; both null if all does.

    Sorted form has no ignored keys, and the elements of every array are in the order of their own sorted text. What agrees has the same
    type and value: it goes from objects with its key, while arrays keep null in its place. With ``contains``, what only the actual document has
    goes too. Values that are left are those of the documents, so whether and how they differ is for the reader to tell.
    """
    ignored = frozenset(ignore_keys)
    # made once: jsonlib.dumps with options makes an encoder each time
    ordering, written = jsonlib.JSONEncoder(sort_keys=True).encode, jsonlib.JSONEncoder(ensure_ascii=False).encode

    def refuse(constant: str):
        raise ValueError(f"{constant} is not JSON")

    def sort(node):
        kind = type(node)
        if kind is list:
            for v in node:
                if type(v) is dict or type(v) is list:
                    sort(v)
            if len(node) > 1:
                node.sort(key=ordering)
        elif kind is dict:
            for k in ignored:
                node.pop(k, None)
            for v in node.values():
                if type(v) is dict or type(v) is list:
                    sort(v)
        return node

    def agree(e, a) -> bool:
        kind = type(e)
        if kind is not type(a):  # 1 and 1.0, too: which numbers are the same is told by the reader
            return False
        if kind is dict:
            for k, x in list(e.items()):
                if k in a and (x == a[k] if type(x) is str else agree(x, a[k])):
                    del e[k], a[k]
            if contains and a:
                for k in a.keys() - e.keys():
                    del a[k]
            return not e and not a
        if kind is list:
            if contains:
                del a[len(e):]
            same = len(e) == len(a)
            for i, (x, y) in enumerate(zip(e, a)):
                if agree(x, y):
                    e[i] = a[i] = None
                else:
                    same = False
            return same
        return e == a

    def texts(expected: pd.Series, actual: pd.Series) -> pd.DataFrame:
        read = jsonlib.JSONDecoder(parse_constant=refuse).decode  # one a batch, as it cannot be sent to a worker
        out = []
        for pair in zip(expected, actual):
            e, a = (None if t is None else [sort(read(t))] for t in pair)  # in a list, as a document may be null itself
            if e is not None and a is not None and agree(e[0], a[0]):
                e = a = None
            out.append([None if d is None else written(d[0]) for d in (e, a)])
        return pd.DataFrame(out, columns=["_e", "_a"])

    # a filter on the texts would else be pushed below the exchange and sort each document a second time
    return F.pandas_udf(texts, "_e string, _a string").asNondeterministic()(expected, actual)


#: Levels of documents that are opened in one plan.
JSON_LEVELS = 8


def _json_kind(text: Column) -> Column:
    """The first character of a value as JSON text, made the same for all numbers and for both truth values."""
    return F.translate(F.left(text, F.lit(1)), "f0123456789", "t" + "-" * 10)


def json_diff(df: DataFrame, key: str, expected: str, actual: str, ignore_keys: Sequence[str] = (), ignore_order: bool = False,
              contains: bool = True) -> DataFrame:
    """First difference of each pair of documents in path order; pairs that agree are not returned.

    Reasons: missing key, extra key, length mismatch, type mismatch, different value. The actual document may have more keys and
    elements than the expected one unless ``contains`` is off. With ``ignore_order`` the elements of arrays are addressed by their
    place in sorted form (``differing_json``). Keys are compared at every depth. The pairs are spread by key once and opened level by level:
    what agrees as text is left out, and below a difference nothing can come before it, so a pair has few rows at any level. After
    ``JSON_LEVELS`` levels the differences found are stored, and what is still open goes on.
    """
    unequal = ~F.col(expected).eqNullSafe(F.col(actual))  # equal texts cannot differ
    # not a filter: it would be pushed below what makes the texts, which would then be made twice
    pairs = df.select(key, F.inline(F.when(unequal, F.array(F.struct(F.col(expected).alias("_e"), F.col(actual).alias("_a")))))).repartition(key)
    if ignore_order:
        pairs = pairs.select(key, differing_json(F.col("_e"), F.col("_a"), ignore_keys, contains).alias("_d")).select(key, "_d._e", "_d._a")
        pairs = pairs.where(~F.col("_e").eqNullSafe(F.col("_a")))
    if contains:
        pairs = pairs.where(F.col("_e").isNotNull())
    child = lambda name, e, a: F.struct(name.alias("name"), e.alias("e"), a.alias("a"))
    in_full = lambda c: F.struct(c["name"], c["e"], c["a"], F.to_json(c["e"]).alias("t1"), F.to_json(c["a"]).alias("t2"))

    def differing(nodes: Column) -> Column:
        return F.filter(F.transform(nodes, in_full), lambda c: ~c["t1"].eqNullSafe(c["t2"]))

    def judged(rows: DataFrame, nodes: Column) -> DataFrame:
        """A row (path, _e, _a) a node, with the reason, or none where both are objects or both are arrays."""
        rows = rows.select(key, "path", "_reason", F.inline(nodes))
        rows = rows.select(key, F.concat("path", "name").alias("path"), "_reason", "e", "a", _json_kind(F.col("t1")).alias("t1"), _json_kind(F.col("t2")).alias("t2"))
        in_array = F.col("path").endswith("]") & ~F.col("path").endswith('"]')
        absent = F.when(in_array, "length mismatch")
        reason = (F.when(F.col("_reason").isNotNull(), F.col("_reason"))
                  .when(F.col("t2").isNull(), absent.otherwise("missing key")).when(F.col("t1").isNull(), absent.otherwise("extra key"))
                  .when(F.col("t1") != F.col("t2"), "type mismatch").when(~F.col("t1").isin("{", "["), "different value"))
        rows = rows.select(key, "path", reason.alias("_reason"), "e", "a", "t1")
        held = lambda c: F.when(F.col("_reason").isNull(), F.col(c))
        return rows.select(key, "path", "_reason", held("t1").alias("_kind"), held("e").alias("_e"), held("a").alias("_a"))

    def opened(rows: DataFrame) -> DataFrame:
        """The children of open rows that differ; rows with a reason pass as they are."""
        part = lambda c, kind, name: F.when(F.col("_kind") == kind, F.col(c).try_cast("map<string,variant>" if kind == "{" else "array<variant>")).alias(name)
        rows = rows.select(key, "path", "_reason", "_e", "_a", part("_e", "{", "_eo"), part("_a", "{", "_ao"), part("_e", "[", "_ea"), part("_a", "[", "_aa"))
        names = F.map_keys("_eo") if contains else F.array_union(F.map_keys("_eo"), F.map_keys("_ao"))
        if ignore_keys:
            names = F.filter(names, lambda n: ~n.isin(*ignore_keys))
        label = lambda n: F.when(F.regexp_like(n, F.lit(r"[.\[\]]")), F.concat(F.lit('["'), n, F.lit('"]'))).otherwise(F.concat(F.lit("."), n))
        fields = F.transform(names, lambda n: child(n, F.try_element_at("_eo", n), F.try_element_at("_ao", n)))
        fields = F.transform(differing(fields), lambda c: c.withField("name", label(c["name"])))
        size = F.size("_ea") if contains else F.greatest(F.size("_ea"), F.size("_aa"))
        places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).when(F.col("_ea").isNotNull(), F.array().cast("array<int>"))
        elements = F.transform(places, lambda i: child(F.concat(F.lit("["), i.cast("string"), F.lit("]")), F.get("_ea", i), F.get("_aa", i)))
        itself = F.transform(F.array(child(F.lit(""), F.col("_e"), F.col("_a"))), in_full)
        return judged(rows, F.coalesce(fields, differing(elements), itself))

    top = F.array(child(F.lit("$"), F.parse_json("_e"), F.parse_json("_a")))
    rows = judged(pairs.select(key, F.lit("").alias("path"), F.lit(None).cast("string").alias("_reason"), "_e", "_a"), differing(top))
    found = None
    while True:
        for _ in range(JSON_LEVELS):
            rows = opened(rows)
        rows = settle(rows)
        done = rows.where(F.col("_reason").isNotNull()).select(key, "path", "_reason")
        found = done if found is None else found.unionByName(done)
        rows = rows.where(F.col("_reason").isNull())
        if rows.isEmpty():
            break
    return found.groupBy(key).agg(F.min(F.struct("path", F.col("_reason").alias("reason"))).alias("d")).select(
        key, "d.path", "d.reason")


# --- frames -----------------------------------------------------------------------------------

def _along(direction: Column, position: Column) -> Column:
    return geometry.dot(geometry.items(direction), geometry.items(position))


def order_frames(frames: DataFrame, keys: Sequence[str] = ("series_id",), identity: bool = False, order: str = "frame") -> DataFrame:
    """Position of each frame along the slice direction of its series; ``identity`` keeps the stored order.

    ``frames`` has row_dir, col_dir and position arrays.
    """
    place = F.col(order).cast("double") if identity else F.round(
        _along(geometry.slice_direction(F.col("row_dir"), F.col("col_dir")), F.col("position")), 9)
    return rank_in_group(frames.withColumn("distance", place), list(keys), "distance", order)


def segment_slices(labelmap: DataFrame, meta: DataFrame, skip_empty: bool = True, keys: Sequence[str] = IMAGE, label: str = "label") -> DataFrame:
    """Bounding box, first slice, slice behind the last and slice count of every label but 0."""
    box = labelmap.where(F.col(label) != 0).groupBy(*keys, label).agg(
        *[f(c).cast("long").alias(f"{n}_{c}") for c in ("x", "y", "z") for n, f in (("min", F.min), ("max", F.max))])
    if skip_empty:
        first, end = F.col("min_z"), F.col("max_z") + 1
    else:
        box = attach(box, meta.select(*keys, "size"), list(keys))
        first, end = F.lit(0).cast("long"), F.col("size")[2].cast("long")
    return box.select(*keys, label, *[f"{n}_{c}" for c in ("x", "y", "z") for n in ("min", "max")],
                      first.alias("first_slice"), end.alias("end_slice"), (end - first).alias("slices"))


def volume_extent(frames: DataFrame, direction: str = "direction", keys: Sequence[str] = ("series_id",), order: str = "frame",
                  whole_rows: int = WHOLE_ROWS) -> DataFrame:
    """Origin, slice spacing, extent and counts of the frames of each series.

    Distances are measured along ``direction`` from the first frame. A series of at most ``whole_rows`` frames meets in one task,
    after one shuffle; the frames of a larger one stay spread, and what they are compared with is joined to them.
    """
    keys = list(keys)
    rows = frames.select(*keys, "position", F.col(order).alias("_order"), *[F.col(direction)[i].alias(f"_d{i}") for i in range(3)])
    large = large_groups(rows, keys, whole_rows)
    if large.isEmpty():
        return _extent_of(_placed_whole(rows, keys), keys)
    small = fits_broadcast(large)
    rest = join_summary(rows, large, keys, "left_anti", small)
    hot = join_summary(rows, large, keys, "left_semi", small)
    return _extent_of(_placed_whole(rest, keys), keys).unionByName(_extent_of(_placed_spread(hot, keys), keys))


def _positions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row a distinct position, with its number of frames and its first one in the stored order."""
    return rows.groupBy(*keys, "position").agg(
        F.count(F.lit(1)).alias("copies"), F.min("_order").alias("_order"), *[F.first(f"_d{i}").alias(f"_d{i}") for i in range(3)])


def _offset() -> Column:
    offset = F.zip_with("position", "_ref", lambda p, r: p - r)
    return F.round(_along(F.array("_d0", "_d1", "_d2"), offset), 9)


def _placed_whole(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Positions with their distance d and the lowest of their series; all steps run on rows dealt by series once."""
    series = Window.partitionBy(*keys)
    placed = _positions(rows.repartition(*keys), keys).withColumn("_ref", F.min_by("position", "_order").over(series))
    placed = placed.select(*keys, "position", "copies", _offset().alias("d"))
    return placed.withColumn("_low", F.min(F.struct("d", "position")).over(series))


def _placed_spread(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The same with the positions of a series spread over tasks."""
    first = rows.groupBy(*keys).agg(F.min_by("position", "_order").alias("_ref"))
    placed = attach(_positions(rows, keys), first, keys).withColumn("d", _offset())
    return attach(placed, placed.groupBy(*keys).agg(F.min(F.struct("d", "position")).alias("_low")), keys)


def _extent_of(placed: DataFrame, keys: list[str]) -> DataFrame:
    is_low = (F.col("d") == F.col("_low.d")) & (F.col("position") == F.col("_low.position"))
    sums = placed.groupBy(*keys).agg(
        F.min("_low").alias("low"), F.min(F.when(~is_low, F.col("d"))).alias("second"), F.max("d").alias("high"),
        F.sum("copies").alias("frames"), F.count(F.lit(1)).alias("positions"), F.count_if(F.col("copies") > 1).alias("overlapping"))
    spacing = F.coalesce(F.abs(F.col("low.d") - F.col("second")), F.lit(0.0))
    extent = F.abs(F.col("high") - F.col("low.d"))
    slices = F.coalesce(F.ceil(F.try_divide(extent, spacing)) + 1, F.lit(1)).cast("long")
    return sums.select(*keys, "frames", "positions", "overlapping", F.col("low.position").alias("origin"),
                       spacing.alias("spacing"), extent.alias("extent"), slices.alias("slices"))


def slice_source_map(instances: DataFrame, meta: DataFrame, keys: Sequence[str] = IMAGE, name: str = "instance") -> DataFrame:
    """Source instances with the slice of the label image that their position falls into.

    ``instances`` has wx, wy, wz of the instance origin; those outside of the image are left out.
    """
    placed = with_index(instances, meta)
    sized = attach(placed, meta.select(*keys, "size"), list(keys))
    inside = None
    for axis, c in enumerate(("ix", "iy", "iz")):
        here = (F.col(c) >= 0) & (F.col(c) < F.col("size")[axis])
        inside = here if inside is None else inside & here
    return sized.where(inside).select(*keys, F.col("iz").alias("slice"), name)


# --- segment descriptions ---------------------------------------------------------------------

SEGMENT = (f"struct<labelID:int,SegmentDescription:string,SegmentLabel:string,SegmentAlgorithmType:string,SegmentAlgorithmName:string,"
           f"SegmentedPropertyCategoryCodeSequence:{CODE},SegmentedPropertyTypeCodeSequence:{CODE},AnatomicRegionSequence:{CODE},"
           f"recommendedDisplayRGBValue:array<int>>")
SEGMENTS = f"struct<segmentAttributes:array<array<{SEGMENT}>>>"

# The code used where a given code sequence lacks a part, and the default label.
DEFAULT_CODE = ("T-D0050", "SRT", "Tissue")
DEFAULT_LABEL_ID = 1


def flatten_segments(documents: DataFrame, json: str = "json") -> DataFrame:
    """One row per segment with its file number; absent code parts get the defaults.

    A label that occurs twice in a file stops the job.
    """
    keys = [c for c in documents.columns if c != json]
    files = documents.select(*keys, F.posexplode(F.from_json(json, SEGMENTS)["segmentAttributes"]).alias("file", "segments"))
    label = lambda s: F.coalesce(s["labelID"], F.lit(DEFAULT_LABEL_ID))
    distinct = F.size(F.array_distinct(F.transform("segments", label)))
    message = F.concat(F.lit("duplicate label in file "), F.col("file").cast("string"))
    checked = files.withColumn("segments", F.when(distinct == F.size("segments"), F.col("segments")).otherwise(F.raise_error(message).cast(f"array<{SEGMENT}>")))
    rows = checked.select(*keys, "file", F.explode("segments").alias("s"))

    def code(name: str) -> Column:
        parts = [F.coalesce(F.col(f"s.{name}")[p], F.lit(v)) for p, v in zip(("CodeValue", "CodingSchemeDesignator", "CodeMeaning"), DEFAULT_CODE)]
        return F.when(F.col(f"s.{name}").isNotNull(), F.concat_ws("|", *parts)).otherwise("")

    text = lambda n: F.coalesce(F.col(f"s.{n}"), F.lit(""))
    return rows.select(
        *keys, "file", label(F.col("s")).alias("label_id"), text("SegmentLabel").alias("label"), text("SegmentDescription").alias("description"),
        text("SegmentAlgorithmType").alias("algorithm_type"), code("SegmentedPropertyCategoryCodeSequence").alias("category"),
        code("SegmentedPropertyTypeCodeSequence").alias("type"), code("AnatomicRegionSequence").alias("region"),
        F.coalesce(F.array_join(F.transform("s.recommendedDisplayRGBValue", lambda v: v.cast("string")), ","), F.lit("")).alias("rgb"))


def build_segments(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """JSON list of lists, each inner list with one segment, in label order."""
    parts = lambda c: F.split(c, r"\|")
    code = lambda c: F.when(F.col(c) != "", F.struct(parts(F.col(c))[0].alias("CodeValue"), parts(F.col(c))[1].alias("CodingSchemeDesignator"),
                                                      parts(F.col(c))[2].alias("CodeMeaning")))
    segment = F.struct(
        F.col("label_id").alias("labelID"), F.col("description").alias("SegmentDescription"), F.col("label").alias("SegmentLabel"),
        F.col("algorithm_type").alias("SegmentAlgorithmType"), code("category").alias("SegmentedPropertyCategoryCodeSequence"),
        code("type").alias("SegmentedPropertyTypeCodeSequence"),
        F.when(F.col("rgb") != "", F.transform(F.split("rgb", ","), lambda v: v.try_cast("int"))).alias("recommendedDisplayRGBValue"))
    gathered = rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(segment)), lambda s: F.array(s)).alias("segmentAttributes"))
    return gathered.select(*keys, F.to_json(F.struct("segmentAttributes")).alias("json"))


def frames_to_labelmaps(frames: DataFrame, pixels: DataFrame, meta: DataFrame) -> DataFrame:
    """Label maps from binary frames: slice from the frame position, non-zero pixels get the segment id.

    ``frames`` has image_id, frame, segment, wx, wy, wz; ``pixels`` image_id, frame, x, y, value. Segment
    0 or a frame outside of the geometry stops the job.
    """
    sized = attach(with_index(frames, meta), meta.select("image_id", "size"), IMAGE)
    bad = (F.col("segment") == 0) | (F.col("iz") < 0) | (F.col("iz") >= F.col("size")[2])
    message = F.concat_ws(" ", F.lit("invalid segment or frame"), "image_id", F.col("frame").cast("string"))
    placed = sized.select("image_id", "frame", "segment", F.when(bad, F.raise_error(message).cast("long")).otherwise(F.col("iz")).alias("z"))
    return pixels.where("value <> 0").join(placed, ["image_id", "frame"]).select(
        "image_id", "x", "y", "z", F.col("segment").alias("label")).distinct()
