import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxcohort.operators import agreement as ag
from voxcohort.operators import histograms, joins, quality, regions, tiles
from voxcohort.operators.envelope import line_minima


def brute_d2(points, targets, spacing=(1, 1, 1)):
    difference = (points[:, None, :] - targets[None, :, :]) * np.array(spacing)
    return (difference ** 2).sum(axis=2).min(axis=1)


def border(mask, offsets):
    at = {tuple(p) for p in np.argwhere(mask)}
    return {p for p in at if any((p[0] + o[0], p[1] + o[1], p[2] + o[2]) not in at for o in offsets)}


def components(mask, full=False):
    left, found = {tuple(p) for p in np.argwhere(mask)}, []
    steps = [o for o in itertools.product((-1, 0, 1), repeat=3) if any(o) and (full or sum(map(abs, o)) == 1)]
    while left:
        queue, seen = [left.pop()], set()
        while queue:
            p = queue.pop()
            seen.add(p)
            for o in steps:
                q = (p[0] + o[0], p[1] + o[1], p[2] + o[2])
                if q in left:
                    left.remove(q)
                    queue.append(q)
        found.append(frozenset(seen))
    return set(found)


def pair_table(spark, pairs):
    rows = [(name, *map(int, p), int(s[p]), int(t[p])) for name, (s, t) in pairs.items() for p in np.ndindex(s.shape)]
    return spark.createDataFrame(rows, "image_id string, x bigint, y bigint, z bigint, src int, tgt int")


@pytest.fixture(scope="module")
def label_pairs():
    base = np.zeros((5, 5, 5), dtype=int)
    base[1:3, 1:4, 1:4] = 1
    base[2, 2, 2] = 4
    shifted = np.roll(base, 1, axis=0)
    other = np.zeros_like(base)
    other[4, 4, 4] = 1
    empty = np.zeros_like(base)
    return {"same": (base, base), "shift": (base, shifted), "apart": (base, other), "one": (base, empty), "none": (empty, empty)}


def test_overlap_identities(spark, label_pairs):
    table = ag.contingency(pair_table(spark, label_pairs))
    rows = {r["image_id"]: r for r in ag.label_overlap(table).collect()}
    assert rows["same"]["dice"] == rows["same"]["jaccard"] == rows["same"]["overlap"] == 1.0
    assert rows["apart"]["dice"] == 0.0
    assert rows["shift"]["dice"] == pytest.approx(2 * rows["shift"]["jaccard"] / (1 + rows["shift"]["jaccard"]))
    assert rows["one"]["overlap"] is None and rows["one"]["dice"] == 0.0
    # only maps with more than two labels are scored per label, and only equal label sets in the long report
    assert {r["image_id"] for r in ag.label_overlap_by_label(table).collect()} == {"same", "shift", "apart", "one"}
    assert {r["image_id"] for r in ag.label_statistics(table).collect()} == {"same", "shift", "none"}


def test_region_rules_for_empty_masks(spark, label_pairs):
    rows = {(r["image_id"], r["region"]): r for r in ag.region_statistics(ag.contingency(pair_table(spark, label_pairs))).collect()}
    assert len(rows) == 25
    both = rows["none", "WT"]
    assert (both["dice"], both["sensitivity"], both["specificity"]) == (1.0, 1.0, 1.0)
    assert rows["one", "WT"]["sensitivity"] == 0.0 and rows["one", "WT"]["precision"] is None
    assert rows["same", "ED"]["dice"] == 1.0
    assert rows["same", "WT"]["accuracy"] == 1.0


def test_regions_contain_each_other(spark, voxel_table):
    rng = np.random.default_rng(0)
    labels = voxel_table({"a": rng.choice([0, 1, 2, 4], size=(4, 4, 4))}, "label", kind="int")
    sets = {}
    for r in ag.region_masks(labels).collect():
        sets.setdefault(r["region"], set()).add((r["x"], r["y"], r["z"]))
    assert sets["ET"] < sets["TC"] < sets["WT"] and sets["NET"] | sets["ET"] == sets["TC"] and sets["ED"] == sets["WT"] - sets["TC"]


@pytest.mark.parametrize("spacing", [None, (1.0, 2.5, 0.5)])
def test_nearest_distance_matches_brute_force(spark, spacing):
    rng = np.random.default_rng(5)
    points, targets, expected, metas = [], [], {}, []
    for name, n, m in (("a", 60, 40), ("b", 5, 1), ("c", 1, 30)):
        p, t = rng.integers(-70, 90, (n, 3)), rng.integers(-70, 90, (m, 3))
        points += [(name, *map(int, v)) for v in p]
        targets += [(name, *map(int, v)) for v in t]
        metas.append((name, list(spacing or (1.0, 1.0, 1.0))))
        expected |= {(name, *map(int, v)): d for v, d in zip(p, brute_d2(p, t, spacing or (1, 1, 1)))}
    schema = "image_id string, x bigint, y bigint, z bigint"
    points.append(("lonely", 1, 1, 1))
    meta = spark.createDataFrame([*metas, ("lonely", [1.0, 1.0, 1.0])], "image_id string, spacing array<double>")
    found = joins.nearest_squared(spark.createDataFrame(points, schema), spark.createDataFrame(targets, schema), spacing=None if spacing is None else meta)
    result = {(r["image_id"], r["x"], r["y"], r["z"]): r["d2"] for r in found.collect()}
    assert result.keys() == expected.keys()
    assert all(result[k] == pytest.approx(v) for k, v in expected.items())


@pytest.mark.parametrize("rows", [0, 50, 4096])
def test_nearest_distance_by_lines_and_by_pairs(spark, rows):
    rng = np.random.default_rng(6)
    schema, points, targets, expected = "image_id string, x bigint, y bigint, z bigint", [], [], {}
    for name, n, m in (("a", 60, 40), ("b", 5, 3), ("c", 1, 30)):
        p, t = rng.integers(-70, 90, (n, 3)), rng.integers(-70, 90, (m, 3))
        points += [(name, *map(int, v)) for v in p] * 2  # a point that is listed twice is one
        targets += [(name, *map(int, v)) for v in t]
        expected |= {(name, *map(int, v)): d for v, d in zip(p, brute_d2(p, t))}
    found = joins.nearest_squared(spark.createDataFrame(points, schema), spark.createDataFrame(targets, schema), direct_rows=rows).collect()
    assert len(found) == len(expected) and {(r["image_id"], r["x"], r["y"], r["z"]): r["d2"] for r in found} == expected


def test_few_voxels_in_wide_images_stay_few_rows(spark, monkeypatch):
    """By lines the rows grow with the volume of the image, not with its voxels."""
    monkeypatch.setattr(joins, "line_minima", None)
    place = [("a", x, x * 7 % 100, x * 13 % 100) for x in range(0, 2000, 40)]
    df = spark.createDataFrame(place, "image_id string, x bigint, y bigint, z bigint")
    assert joins.nearest_squared(df, df).where("d2 = 0").count() == 50


@pytest.mark.parametrize("shape", ["ball", "cross"])
def test_surface_across_words(spark, shape):
    rng = np.random.default_rng(2)
    mask = rng.random((140, 4, 4)) < 0.8
    mask[60:70, 1:4, 0:3] = True
    rows = [("a", *map(int, p)) for p in np.argwhere(mask)]
    rows = [(n, x - 70, y, z) for n, x, y, z in rows]  # negative coordinates too
    found = regions.surface(spark.createDataFrame(rows, "image_id string, x bigint, y bigint, z bigint"), shape=shape)
    expected = {(p[0] - 70, p[1], p[2]) for p in border(mask, joins.offsets(1, shape, include_centre=False))}
    assert {(r["x"], r["y"], r["z"]) for r in found.collect()} == expected
    assert len(joins.offsets(1, "ball")) == 19 and len(joins.offsets(1, "cross")) == 7


def test_dilate_across_words(spark):
    seeds = [(62, 3, 3), (0, 0, 0), (130, 1, 5)]
    df = spark.createDataFrame([("a", *s) for s in seeds], "image_id string, x bigint, y bigint, z bigint")
    expected = {(s[0] + o[0], s[1] + o[1], s[2] + o[2]) for s in seeds for o in joins.offsets(5, "ball")}
    assert {(r["x"], r["y"], r["z"]) for r in regions.dilate(df, 5).collect()} == expected
    cut = {p for p in expected if 0 <= p[0] < 64 and 0 <= p[1] < 5 and 0 <= p[2] < 8}
    assert {(r["x"], r["y"], r["z"]) for r in regions.dilate(df, 5, size=[64, 5, 8]).collect()} == cut


@pytest.mark.parametrize("full", [False, True])
def test_components_match_flood_fill(spark, full):
    rng = np.random.default_rng(8)
    mask = rng.random((9, 8, 7)) < (0.12 if full else 0.4)
    df = spark.createDataFrame([("a", *map(int, p)) for p in np.argwhere(mask)], "image_id string, x bigint, y bigint, z bigint")
    rows = regions.component_voxels(regions.connected_components(df, full=full)).collect()
    found = {}
    for r in rows:
        found.setdefault(tuple(r["component"]), set()).add((r["x"], r["y"], r["z"]))
    assert {frozenset(v) for v in found.values()} == components(mask, full)


def test_fill_holes_and_snake(spark):
    shell = np.zeros((5, 5, 5), dtype=bool)
    shell[1:4, 1:4, 1:4] = True
    shell[2, 2, 2] = False
    df = spark.createDataFrame([("a", *map(int, p)) for p in np.argwhere(shell)], "image_id string, x bigint, y bigint, z bigint")
    sizes = spark.createDataFrame([("a", [5, 5, 5])], "image_id string, size array<int>")
    filled = {(r["x"], r["y"], r["z"]) for r in regions.fill_holes(df, sizes).collect()}
    assert filled == {tuple(p) for p in np.argwhere(shell)} | {(2, 2, 2)}
    snake = [("a", x if y % 4 == 0 or x == (0 if y % 4 == 3 else 9) else None, y, 0) for y in range(13) for x in range(10)]
    line = spark.createDataFrame([s for s in snake if s[1] is not None], "image_id string, x bigint, y bigint, z bigint")
    assert regions.component_sizes(regions.connected_components(line)).count() == len(components(np.array(
        [[[any(s[1] == x and s[2] == y for s in snake)] for y in range(13)] for x in range(10)])))


def test_hausdorff_variants(spark, label_pairs):
    pairs = pair_table(spark, label_pairs)
    plain = {r["image_id"]: r["hd95"] for r in ag.hausdorff95(pairs).collect()}
    assert plain["same"] == 0.0 and plain["none"] == 0.0 and plain["one"] == float("inf")
    sizes = spark.createDataFrame([(n, [5, 5, 5]) for n in label_pairs], "image_id string, size array<int>")
    region = {(r["image_id"], r["region"]): r["hausdorff95"] for r in ag.region_hausdorff95(pairs, sizes).collect()}
    assert len(region) == 25
    assert region["none", "WT"] == 0.0 and region["one", "WT"] == pytest.approx(75 ** 0.5) and region["shift", "ET"] == 1.0
    s, t = (np.argwhere(v != 0) for v in label_pairs["shift"])
    assert {r["image_id"]: r["hausdorff"] for r in ag.hausdorff(pairs).collect()}["shift"] == pytest.approx(
        max(brute_d2(s, t).max(), brute_d2(t, s).max()) ** 0.5)


def plain_hd95(s, t, spacing, pooled):
    """95th percentile of surface distances of two masks, pair by pair."""
    steps = joins.offsets(1, "cross" if pooled else "ball", include_centre=False)
    surface = [np.array(sorted(border(m, steps))) for m in (s, t)]
    whole = surface if pooled else [np.argwhere(m) for m in (s, t)]
    far = [np.sqrt(brute_d2(surface[i], whole[1 - i], spacing)) for i in (0, 1)]
    if pooled:
        return np.percentile(np.concatenate(far), 95)
    return max(np.sort(d)[int(np.floor(0.95 * (len(d) - 1)))] for d in far)


def test_surface_distances_of_all_labels_and_regions(spark, label_pairs):
    rng = np.random.default_rng(17)
    noisy = [rng.choice([0, 0, 1, 2, 4, 4], size=(70, 6, 5)) for _ in range(2)]
    pairs = label_pairs | {"noisy": tuple(noisy)}
    table, spacing = pair_table(spark, pairs), (1.0, 1.5, 2.0)
    meta = spark.createDataFrame([(n, list(map(float, spacing)), list(s.shape)) for n, (s, _) in pairs.items()], "image_id string, spacing array<double>, size array<int>")
    counts = ag.contingency(table)
    got = {(r["image_id"], r["metric"]): r["value"] for r in ag.label_statistics(counts, pair=table, spacing=meta.select("image_id", "spacing")).collect()}
    far = {k: v for k, v in got.items() if k[1].startswith("hausdorff95")}
    expected = {("none", "hausdorff95_overall"): 0.0}
    for name in ("same", "shift", "noisy"):
        s, t = pairs[name]
        expected[name, "hausdorff95_overall"] = plain_hd95(s != 0, t != 0, spacing, False)
        expected |= {(name, f"hausdorff95_label{v}"): plain_hd95(s == v, t == v, spacing, False) for v in np.unique(s) if v}
    assert far == pytest.approx(expected)
    assert len(got) > len(far) and ag.label_statistics(counts).count() == len(got) - len(far)

    rows = {(r["image_id"], r["region"]): r["hausdorff95"] for r in ag.region_statistics(counts, pair=table, extents=meta.select("image_id", "size")).collect()}
    for (name, region), value in rows.items():
        s, t = (np.isin(x, ag.REGIONS[region]) for x in pairs[name])
        if s.any() and t.any():
            want = plain_hd95(s, t, (1, 1, 1), True)
        else:
            want = np.linalg.norm(pairs[name][0].shape) if s.any() or t.any() else 0.0
        assert value == pytest.approx(want), (name, region)


def test_line_minima_against_all_pairs():
    rng = np.random.default_rng(3)
    for trial in range(60):
        lines = []
        for _ in range(rng.integers(1, 25)):
            n = rng.integers(0, 20)
            costs = rng.integers(0, 200, n) if trial % 2 else np.zeros(n, int)
            lines.append((rng.integers(-30, 30, n), costs, rng.choice(np.arange(-40, 40), rng.integers(0, 30), replace=False), float(rng.choice([1, 1, 2.25, 0]))))
        batch = pa.RecordBatch.from_pylist(
            [{"k": i, "sources": [{"at": int(p), "cost": float(c)} for p, c in zip(at, cost)], "asked": asked.tolist(), "weight": w} for i, (at, cost, asked, w) in enumerate(lines)],
            pa.schema([("k", pa.int64()), ("sources", pa.list_(pa.struct([("at", pa.int64()), ("cost", pa.float64())]))), ("asked", pa.list_(pa.int64())), ("weight", pa.float64())]))
        got = {r["k"]: (r["asked"], r["minima"]) for out in line_minima([batch], ["k"]) for r in out.to_pylist()}
        assert got.keys() == {i for i, line in enumerate(lines) if len(line[0])}
        for i, (asked, minima) in got.items():
            at, cost, questions, w = lines[i]
            assert asked == sorted(questions.tolist()) and minima == [float((w * (x - at) ** 2 + cost).min()) for x in asked]


def test_formatted_metrics(spark):
    df = spark.createDataFrame([(1.5,), (float("nan"),), (None,), (float("inf"),), (2e101,)], "v double")
    assert [r[0] for r in df.select(ag.formatted_metric(F.col("v"))).collect()] == ["1.500000", "NaN", "NaN", "INF", "INF"]


def test_unexpected_labels_and_negative_repair(spark, voxel_table):
    volume = np.zeros((12, 12, 12), dtype=int)
    volume[:8] = 7
    volume[8:, :2] = 3
    found = quality.unexpected_labels_of(voxel_table({"a": volume}, "label", kind="int")).collect()
    assert [(r["label"], r["voxels"]) for r in found] == [(7, 8 * 144)]
    small, large = np.ones((4, 4, 4)), np.ones((4, 4, 4))
    small[0, 0, 0], large[:2] = -2.0, -1.0
    small[3, 3, 3] = 0.0
    images = voxel_table({"small": small, "large": large})
    assert [r["image_id"] for r in quality.negative_intensity_check(images, 20).collect()] == ["large"]
    repaired = {(r["image_id"], r["x"], r["y"], r["z"]): r["value"] for r in quality.repair_negatives(images, 20).collect()}
    assert repaired["small", 0, 0, 0] == 0.0 and repaired["small", 1, 1, 1] == 3.0 and repaired["small", 3, 3, 3] == 0.0
    assert repaired["large", 0, 0, 0] == -1.0


@pytest.mark.parametrize("name,change", [("size", [4, 5, 7]), ("spacing", [1.0, 1.0, 2.0]), ("origin", [0.0, 1.0, 0.0]),
                                         ("direction", [[1.0, 0.0, 0.0], [0.0, -1.0, 0.0], [0.0, 0.0, 1.0]])])
def test_geometry_check_names_the_property(spark, name, change):
    base = {"size": [4, 5, 6], "spacing": [1.0, 1.0, 1.0], "origin": [0.0, 0.0, 0.0],
            "direction": [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]}
    schema = "size array<int>, spacing array<double>, origin array<double>, direction array<array<double>>"
    df = spark.createDataFrame([(base, base | {name: change}), (base, base)], f"a struct<{schema}>, b struct<{schema}>".replace("struct<", "struct<").replace(" array", ": array"))
    first, second = quality.geometry_check(df).collect()
    assert (first["mismatch"], first["same_space"]) == (name, False)
    assert (second["mismatch"], second["same_space"]) == ("", True)


@pytest.mark.parametrize("radius", [1, 3])
def test_neighbourhoods_across_tiles(spark, radius):
    """Boxes that reach over the borders of tiles, in a sparse image with negative places."""
    rng = np.random.default_rng(radius)
    volume = np.where(rng.random((40, 19, 18)) < 0.5, rng.integers(1, 90, (40, 19, 18)), 0).astype(float)
    at = np.argwhere(volume > 0)
    rows = [("a", *(int(v) - 17 for v in p), float(volume[tuple(p)])) for p in at]
    image = spark.createDataFrame(rows, "image_id string, x int, y bigint, z bigint, value double").repartition(5)
    padded = np.pad(volume, radius)
    box = {tuple(p): padded[tuple(slice(v, v + 2 * radius + 1) for v in p)] for p in at}
    sums = tiles.box_sums(image, radius, {"n": F.lit(1), "total": F.col("value")}, ["image_id"])
    got = {(r.x + 17, r.y + 17, r.z + 17): (r.n, r.total) for r in sums.collect()}
    assert got == {p: ((b > 0).sum(), b.sum()) for p, b in box.items()} and sums.schema["x"].dataType == image.schema["x"].dataType
    pairs = joins.neighbours(image, radius, "box").groupBy("c_x", "c_y", "c_z").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("centre").alias("centre"))
    assert {(r.c_x + 17, r.c_y + 17, r.c_z + 17): (r.n, r.total) for r in pairs.collect()} == got
    # shuffled rows: fewer than two a voxel
    assert (1 + 2 * radius / tiles.tile_size(radius)) ** 3 < 2
    # nearest difference to another image that lies in the box
    other = spark.createDataFrame([r for r in rows if r[4] > 60], image.schema)
    far = np.pad(np.where(volume > 60, volume, np.inf), radius, constant_values=np.inf)
    diff = {(r.x + 17, r.y + 17, r.z + 17): r.difference for r in histograms.voxel_differences(image, other, radius).collect()}
    for p in map(tuple, at):
        near = far[tuple(slice(v, v + 2 * radius + 1) for v in p)]
        assert diff[p] == (np.abs(near - volume[p]).min() if np.isfinite(near).any() else volume[p])


@pytest.mark.parametrize("full", [False, True])
@pytest.mark.parametrize("tile", [(32, 256), (4, 8)])
def test_components_over_tiles(spark, monkeypatch, tile, full):
    monkeypatch.setattr(regions, "TILE_LINES", tile[0])
    monkeypatch.setattr(regions, "TILE_WIDTH", tile[1])
    mask = np.random.default_rng(3).random((20, 9, 10)) < 0.3
    rows = [("a", *(int(v) - 3 for v in p)) for p in np.argwhere(mask)] * 2  # negative places, and every voxel twice
    found = regions.component_voxels(regions.connected_components(spark.createDataFrame(rows, "image_id string, x long, y long, z long"), full=full)).collect()
    sets = {}
    for r in found:
        sets.setdefault(tuple(r["component"]), []).append((r["x"] + 3, r["y"] + 3, r["z"] + 3))
    assert sum(map(len, sets.values())) == mask.sum() and {frozenset(v) for v in sets.values()} == components(mask, full)
    assert all(k == min((z - 3, y - 3, x - 3) for x, y, z in v) for k, v in sets.items())


def test_images_of_one_tile_need_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(regions, "_follow_smallest", None)
    line = spark.createDataFrame([("a", i // 2, (i + 1) // 2, 0) for i in range(40)], "image_id string, x long, y long, z long")
    assert [r["voxels"] for r in regions.component_sizes(regions.connected_components(line.where("y < 32"))).collect()] == [40]
