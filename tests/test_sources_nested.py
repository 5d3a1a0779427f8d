import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxcohort.functions import geometry, intensity
from voxcohort.operators import nested as ne
from voxcohort.operators import normalize as no
from voxcohort.operators import voxels
from voxcohort.sources import inventories as inv
from voxcohort.sources import manifests as man


@pytest.mark.parametrize("headers", ["Patient-ID,T1_Post,t1,T2,FL-air", "SUBJECTID,T1CE,T1pre,t2,t2flair", "sub_id,T1GD,T1,T2,myflx"])
def test_manifest_aliases(spark, tmp_path, headers):
    (tmp_path / "m.csv").write_text(headers + "\np1,a,b,c,d\np2,e,f,g,h\n")
    rows = man.read_manifest(spark, str(tmp_path / "m.csv")).orderBy("ID").collect()
    assert [tuple(r[c] for c in ("ID", "T1GD", "T1", "T2", "FLAIR")) for r in rows] == [("p1", "a", "b", "c", "d"), ("p2", "e", "f", "g", "h")]


def test_manifest_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="FLAIR"):
        man.manifest_columns(["subject", "t1", "t1ce", "t2"])
    with pytest.raises(ValueError, match="ID"):
        man.manifest_columns(["patient-id", "t1", "t1ce", "t2", "flair"], strip_separators=False)
    (tmp_path / "m.csv").write_text("subject,t1,t1ce,t2,flair\np1,a b,c,d,e\n")
    with pytest.raises(Exception, match="space in column t1"):
        man.read_manifest(spark, str(tmp_path / "m.csv")).collect()


def test_labeled_csv(spark, tmp_path):
    (tmp_path / "l.csv").write_text('img,other,l1,l2\na.nii,/abs/b.nii,3.5kg,x\n')
    row = man.read_labeled_csv(spark, str(tmp_path / "l.csv"), ["img", "other"], prefix="/p/").first()
    assert row["images"] == ["/p/a.nii", "/abs/b.nii"] and row["labels"] == [3.5, 0.0]
    assert man.read_labeled_csv(spark, str(tmp_path / "l.csv"), ["img"], ["l1"]).first()["labels"] == [3.5]
    (tmp_path / "n.csv").write_text("img\na.nii\n")
    assert man.read_labeled_csv(spark, str(tmp_path / "n.csv"), ["img"]).first()["labels"] == [1.0]


def test_matrix_and_model_tables(spark, tmp_path):
    (tmp_path / "m.csv").write_text("1,2,3\n4,5,x\n")
    cells = man.read_matrix(spark, str(tmp_path / "m.csv"))
    assert {r["row"]: r["vector"] for r in man.matrix_vectors(cells).collect()} == {0: [1.0, 2.0, 3.0], 1: [4.0, 5.0, 0.0]}
    assert {r["col"]: r["vector"] for r in man.matrix_vectors(cells, True).collect()}[2] == [3.0, 0.0]
    man.write_matrix(cells.withColumn("col", F.col("col").cast("string")), ["0", "1"], str(tmp_path / "out"))
    text = sorted(line for f in (tmp_path / "out").glob("*.csv") for line in f.read_text().splitlines())
    assert "0,1.000000,2.000000" in text and "1,4.000000,5.000000" in text
    scaling = spark.createDataFrame([(0, 1.0, 2.0)], "feature int, mean double, std double")
    man.save_model_tables(str(tmp_path / "model"), scaling, flags={"T1": True})
    loaded = man.load_model_tables(spark, str(tmp_path / "model"))
    assert set(loaded) == {"scaling", "flags"} and loaded["scaling"].first()["std"] == 2.0


def test_modalities(spark):
    names = {"a_t1ce.nii.gz": "T1CE", "b_T1.nii": "T1", "t2_flair": "FLAIR", "x_flair": "FLAIR", "ct2pet": "T2", "brain_ct": "CT", "q_label-map": "SEG", "zzz": "UNDEFINED"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r["n"]: r["m"] for r in df.select("n", inv.guess_modality(F.col("n")).alias("m")).collect()} == names
    strict = spark.createDataFrame([("/t1/scan_ct.nii",), ("/d/at1b",), ("/d/at1_b",)], "n string")
    assert [r[0] for r in strict.select(inv.guess_modality(F.col("n"), strict=True)).collect()] == ["CT", "UNDEFINED", "T1"]


def test_cascading_change_and_lengths(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (5.0,)], "v double")
    assert [r[0] for r in df.select(intensity.change_values(F.col("v"), [1, 2], [2, 3])).collect()] == [3.0, 3.0, 5.0]
    with pytest.raises(ValueError):
        intensity.change_values(F.col("v"), [1], [])


def test_world_round_trip_and_orientation_codes(spark):
    meta = spark.createDataFrame([("a", [4, 5, 6], [1.0, 2.0, 0.5], [3.0, -1.0, 2.0], [[0.0, 0.0, 1.0], [1.0, 0.0, 0.0], [0.0, -1.0, 0.0]])],
                                 "image_id string, size array<int>, spacing array<double>, origin array<double>, direction array<array<double>>")
    points = spark.createDataFrame([("a", x, y, z, 1.0) for x in range(4) for y in range(5) for z in range(6)], "image_id string, x bigint, y bigint, z bigint, value double")
    back = voxels.with_index(voxels.with_world(points, meta), meta)
    assert back.where("x <> ix OR y <> iy OR z <> iz").count() == 0 and back.count() == 120
    there = voxels.reorient(points, meta, "RAI")
    assert there.select("source_code").distinct().collect()[0][0] == "ASR"
    assert there.select("x", "y", "z").distinct().count() == 120
    valid = [a + b + c for a in "RLAPIS" for b in "RLAPIS" for c in "RLAPIS" if len({geometry.AXIS_OF_LETTER[v][0] for v in (a, b, c)}) == 3]
    assert len(valid) == 48
    for code in valid:
        assert geometry.orientation_steps(code, code) == [(0, 1), (1, 1), (2, 1)]
    for wrong in ("RRI", "XYZ", "RA"):
        with pytest.raises(ValueError):
            geometry.parse_orientation(wrong)


def test_stack_refuses_mixed_geometry(spark):
    meta = spark.createDataFrame([("a", [1, 1, 1], 1.0), ("b", [1, 1, 2], 1.0)], "image_id string, size array<int>, s double").select(
        "image_id", "size", F.array("s").alias("spacing"), F.array("s").alias("origin"), F.array("s").alias("direction"))
    images = spark.createDataFrame([("a", 0, 0, 0, 1.0), ("b", 0, 0, 0, 2.0)], "image_id string, x bigint, y bigint, z bigint, value double")
    order = spark.createDataFrame([("a", "s", 0), ("b", "s", 1)], "image_id string, series_id string, t bigint")
    assert voxels.stack(images, order).count() == 2
    with pytest.raises(Exception, match="geometry differs"):
        voxels.stack(images, order, meta).collect()


def test_resample_identity_and_constant(spark, voxel_table):
    rng = np.random.default_rng(3)
    volume = rng.integers(1, 9, (4, 3, 5)).astype(float)
    meta = spark.createDataFrame([("a", [4, 3, 5], [2.0, 1.0, 1.0])], "image_id string, size array<int>, spacing array<double>")
    image = voxel_table({"a": volume})
    for mode in ("linear", "nearest"):
        same = no.resample(image, meta, [2.0, 1.0, 1.0], mode)
        assert {(r["x"], r["y"], r["z"]): r["value"] for r in same.collect()} == {p: volume[p] for p in np.ndindex(volume.shape)}
    constant = no.resample(voxel_table({"a": np.full((4, 3, 5), 7.0)}), meta, 0.75)
    rows = constant.collect()
    assert len(rows) == 11 * 4 * 7 and all(r["value"] == pytest.approx(7.0) for r in rows)


def test_resample_over_cubes_without_a_row_for_each_output(spark):
    rng = np.random.default_rng(4)
    size, step = (21, 5, 9), 0.6
    volume = {tuple(int(c) for c in p): float(rng.integers(1, 9)) for p in np.argwhere(rng.random(size) < 0.4)}
    rows = [("a", 1, *p, v) for p, v in volume.items()] + [("a", 1, *next(iter(volume)), 2.0), ("a", 2, 3, 3, 3, None)]
    image = spark.createDataFrame(rows, "image_id string, t bigint, x bigint, y bigint, z bigint, value double")
    meta = spark.createDataFrame([("a", list(size), [1.0] * 3)], "image_id string, size array<int>, spacing array<double>")
    volume[next(iter(volume))] += 2.0  # a place stored twice counts twice
    new = no.resample(image, meta, step)
    wanted = {}
    for o in np.ndindex(*[round(s / step) for s in size]):
        place = [min(o[i] * step, size[i] - 1.0) for i in range(3)]
        near = [[(c, 1 - abs(p - c)) for c in (int(p), int(p) + 1) if 1 - abs(p - c) > 1e-12] for p in place]
        parts = [wx * wy * wz * volume[x, y, z] for x, wx in near[0] for y, wy in near[1] for z, wz in near[2] if (x, y, z) in volume]
        if parts:
            wanted[o] = sum(parts)
    found = {(r["x"], r["y"], r["z"]): r["value"] for r in new.where("t = 1").collect()}
    assert found == pytest.approx(wanted) and max(o[0] for o in found) > 32
    unknown = new.where("t = 2").collect()
    assert len(unknown) > 8 and all(r["value"] is None for r in unknown)
    assert "sum(" not in new._jdf.queryExecution().optimizedPlan().toString()


def test_volume_extent_joins_nothing_to_small_series(spark):
    rng = np.random.default_rng(5)
    rows = [(int(s), int(f), [float(rng.integers(0, 3)), 0.0, float(rng.integers(0, 5)) * 2.5], [0.0, 0.0, 1.0])
            for s, n in enumerate((1, 2, 7, 40)) for f in range(n)]
    frames = spark.createDataFrame(rows, "series_id bigint, frame bigint, position array<double>, direction array<double>")
    whole = ne.volume_extent(frames)
    assert "Join" not in whole._jdf.queryExecution().optimizedPlan().toString()
    found = {r["series_id"]: r for r in whole.collect()}
    for s in range(4):
        own = [r for r in rows if r[0] == s]
        places = sorted((p[2] - own[0][2][2], p) for p in {tuple(r[2]) for r in own})
        assert found[s]["frames"] == len(own) and found[s]["positions"] == len(places) and tuple(found[s]["origin"]) == places[0][1]
        assert found[s]["spacing"] == (places[1][0] - places[0][0] if len(places) > 1 else 0) and found[s]["extent"] == places[-1][0] - places[0][0]
        assert found[s]["overlapping"] == sum([tuple(r[2]) for r in own].count(p) > 1 for _, p in places)
    spread = ne.volume_extent(frames, whole_rows=5)
    assert sorted(spread.collect()) == sorted(whole.collect())


def documents(spark, expected, actual):
    return spark.createDataFrame([(1, json.dumps(expected), json.dumps(actual))], "id int, e string, a string")


@pytest.mark.parametrize("expected,actual,options,result", [
    ({"a": 1}, {"a": 1}, {}, None),
    ({"a": 1}, {"a": "1"}, {}, ("$.a", "type mismatch")),
    ({"a": 1, "b": 2}, {"a": 1}, {}, ("$.b", "missing key")),
    ({"a": [1, 2]}, {"a": [1]}, {}, ("$.a[1]", "length mismatch")),
    ({"a": [1, 2]}, {"a": [2, 1]}, {}, ("$.a[0]", "different value")),
    ({"a": [1, 2]}, {"a": [2, 1]}, {"ignore_order": True}, None),
    ({"a": 1}, {"a": 1, "b": 3}, {"contains": False}, ("$.b", "extra key")),
    ({"a": 1}, {"a": 1, "b": 3}, {}, None),
    ({"a": 1, "t": 5}, {"a": 1, "t": 6}, {"ignore_keys": ["t"]}, None),
    ({"a": {"b": {"c": {"d": {"e": {"f": 1}}}}}}, {"a": {"b": {"c": {"d": {"e": {"f": 2}}}}}}, {}, ("$.a.b.c.d.e.f", "different value")),
    ({"a": [[{"b": [{"t": 1, "c": [1, 2]}, {"t": 2, "c": [3]}]}]]}, {"a": [[{"b": [{"t": 5, "c": [3]}, {"t": 4, "c": [2, 1]}]}]]},
     {"ignore_order": True, "ignore_keys": ["t"]}, None),
    ({"a": '}}\\"]{'}, {"a": '}}\\"]['}, {}, ("$.a", "different value")),
    ({"a": {}}, {"a": []}, {}, ("$.a", "type mismatch")),
    ({"a.b": 1, "a": {"b": 2}}, {"a.b": 1, "a": {"b": 3}}, {}, ("$.a.b", "different value")),
])
def test_json_diff(spark, expected, actual, options, result):
    rows = ne.json_diff(documents(spark, expected, actual), "id", "e", "a", **options).collect()
    assert [(r["path"], r["reason"]) for r in rows] == ([] if result is None else [result])


def test_report_numbers_and_segment_errors(spark):
    values = spark.createDataFrame([("1.25",), ("123456.78901234567",)], "v string")
    assert [r[0] for r in values.select(ne.fitting_number(F.col("v"))).collect()] == ["1.25", "123456.789012345"]
    with pytest.raises(Exception, match="does not fit"):
        spark.createDataFrame([("12345678901234567",)], "v string").select(ne.fitting_number(F.col("v"))).collect()
    twice = json.dumps({"segmentAttributes": [[{"labelID": 2}, {"labelID": 2}]]})
    with pytest.raises(Exception, match="duplicate label"):
        ne.flatten_segments(spark.createDataFrame([(twice,)], "json string")).collect()


def test_deep_documents_are_made_without_a_join(spark, monkeypatch):
    from voxcohort import catalog
    from voxcohort.operators import nested
    monkeypatch.setattr(nested, "json_diff", lambda df, *_, **__: df)
    pairs = catalog.queries()["json_diff_deep"](spark, "/root/testdata/sf0.001")
    assert "Join" not in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_json_diff_below_the_levels_of_one_plan(spark):
    from voxcohort.operators import nested
    deep = lambda v: "[" * 11 + '{"a":' + v + "}" + "]" * 11
    rows = [(1, deep("1"), deep("2")), (2, deep("1"), deep("1")), (3, '{"b":[1,{"c":null}],"a":1}', '{"a":1,"b":[1,{}]}'), (4, "[1,2]", "[1]"), (5, "[1]", '{"a":1}')]
    found = {r["k"]: (r["path"], r["reason"]) for r in nested.json_diff(spark.createDataFrame(rows, "k long, e string, a string"), "k", "e", "a").collect()}
    assert found == {1: ("$" + "[0]" * 11 + ".a", "different value"), 3: ("$.b[1].c", "missing key"), 4: ("$[1]", "length mismatch"), 5: ("$", "type mismatch")}


def test_json_diff_sorts_each_document_once(spark, monkeypatch):
    from voxcohort.operators import nested
    plans, settle = [], nested.settle
    monkeypatch.setattr(nested, "settle", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or settle(df))
    rows = [(1, '{"a": [2, 1], "b": 1}', '{"a": [1, 2], "b": 2}'), (2, '{"a": [2, 1]}', '{"a": [1, 2]}')]
    found = nested.json_diff(spark.createDataFrame(rows, "k long, e string, a string"), "k", "e", "a", ignore_order=True).collect()
    assert [(r["k"], r["path"], r["reason"]) for r in found] == [(1, "$.b", "different value")]
    assert plans[0].count("ArrowEvalPython") == 1


@pytest.mark.parametrize("expected, actual, contains, left", [
    ('{"a": [2, {"x": 1, "s": 5}], "b": "t"}', '{"b": "t", "a": [{"s": 6, "x": 1}, 2]}', True, (None, None)),
    ('{"a": [2, {"x": 1}], "b": "t", "c": null}', '{"b": "t", "a": [{"x": 3}, 2], "d": 1}', True, ('{"a": [null, {"x": 1}], "c": null}', '{"a": [null, {"x": 3}]}')),
    ('{"a": [], "b": {}}', '{"a": [1], "b": {"k": 1}}', True, (None, None)),
    ('{"a": [], "b": {}}', '{"a": [1], "b": {"k": 1}}', False, ('{"a": [], "b": {}}', '{"a": [1], "b": {"k": 1}}')),
    ('[1, true, 0, "1"]', '[1.0, 1, false, "1"]', True, ('[null, 0, 1, true]', '[null, 1, 1.0, false]')),
    ("null", "null", True, (None, None)), ("null", "{}", True, ("null", "{}")), ("[2, 1]", None, True, ("[1, 2]", None)),
])
def test_differing_json(spark, expected, actual, contains, left):
    rows = spark.createDataFrame([(expected, actual)], "e string, a string")
    found = rows.select(ne.differing_json(F.col("e"), F.col("a"), ["s"], contains).alias("d")).select("d.*").first()
    assert tuple(found) == left


def test_json_diff_takes_nulls_and_numbers_of_one_value(spark):
    rows = [(1, "[1, 2.50]", "[2.5, 1.0]"), (2, "[1]", "[true]"), (3, "[1e0]", "[2]"), (4, "{}", None), (5, None, "{}"), (None, "[1]", "[2]"), (None, "[[1]]", "[2]")]
    table = spark.createDataFrame(rows, "k long, e string, a string")
    for contains, extra in ((True, set()), (False, {(5, "$", "extra key")})):
        found = ne.json_diff(table, "k", "e", "a", ignore_order=True, contains=contains).collect()
        assert {tuple(r) for r in found} == {(2, "$[0]", "type mismatch"), (3, "$[0]", "different value"), (4, "$", "missing key"), (None, "$[0]", "different value")} | extra


def test_deep_documents_are_made_once_from_dealt_orders(spark, tmp_path, monkeypatch):
    from voxcohort import catalog
    plans, settle = [], ne.settle
    monkeypatch.setattr(ne, "settle", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or settle(df))
    rows = [(k, 7 * k % 11, "F", "5-LOW") for k in range(40)] + [(6, 1, "O", "1-URGENT"), (None, 2, None, None)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    found = catalog.queries()["json_diff_deep"](spark, str(tmp_path)).collect()
    items = "$.Measurements[0].measurementItems"
    wanted = {1: (f"{items}[1].units.CodeValue", "different value"), 2: (f"{items}[0].units.CodingSchemeDesignator", "missing key")}
    assert sorted(map(tuple, found)) == [(k, *wanted[k % 5]) for k in range(40) if k % 5 in wanted]
    report = "StructsToJsonEvaluator(Map(),StructType(StructField(SeriesDescription"
    assert plans[0].count(report) == 2 and plans[0].count("Exchange") == 1 and plans[0].index(report) < plans[0].index("Exchange")


def test_validation_documents_are_dealt_by_subject_once(spark, tmp_path):
    rows = [(s, a, r, m, 0.5) for s in ("s1", "s2") for a in ("B", "A") for r in ("WT", "ET") for m in ("Dice", "Sensitivity")]
    metrics = spark.createDataFrame(rows, "subject string, arch string, region string, measure string, value double")
    tree = man.validation_tree(metrics)
    assert tree._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    region = '{"Dice":"0.500000","Sensitivity":"0.500000"}'
    wanted = "{" + ",".join(f'"{a}":{{"ET":{region},"WT":{region}}}' for a in "AB") + "}"
    assert {(r["subject"], r["json"]) for r in tree.collect()} == {("s1", wanted), ("s2", wanted)}
    man.write_validation(metrics, str(tmp_path / "v"))
    assert {r["value"] for r in spark.read.text(str(tmp_path / "v")).collect()} == {f'{{"subject":"{s}","scores":{wanted}}}' for s in ("s1", "s2")}
