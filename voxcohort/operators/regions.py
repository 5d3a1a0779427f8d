"""Morphology and connectivity of masks.

For morphology 64 voxels of one (y, z) line are packed into the bits of one bigint, so that shifts and
bit aggregates replace neighbour joins on voxels. For connectivity a line becomes its runs of voxels, and runs meet in tiles
of bounded size. Both cut the rows by one to two orders of magnitude, and no step gathers a whole image in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from voxcohort.operators.joins import offsets
from voxcohort.session import fits_broadcast, join_summary, settle

IMAGE = ["image_id"]
XYZ = ["x", "y", "z"]

#: Lines along y and along z, and voxels along x, of a tile whose components are found at once; powers of two.
TILE_LINES = 32
TILE_WIDTH = 256


def _line_steps(radius: int, shape: str) -> dict[tuple[int, int], int]:
    """Reach along x of a structuring element for each (dy, dz)."""
    reach: dict[tuple[int, int], int] = {}
    for dx, dy, dz in offsets(radius, shape):
        reach[(dy, dz)] = max(reach.get((dy, dz), 0), dx)
    return reach


def pack_lines(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Words of 64 voxels: columns y, z, w, bits, where bit b of word w is the voxel x = 64 w + b."""
    return mask.groupBy(*keys, "y", "z", F.shiftright("x", 6).alias("w")).agg(
        F.bit_or(_bit(F.col("x").bitwiseAND(F.lit(63)))).alias("bits"))


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def _left(bits: Column, by: int) -> Column:
    return F.shiftleft(bits, by)


def _right(bits: Column, by: int) -> Column:
    return F.shiftrightunsigned(bits, by)


def unpack_lines(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    places = F.array(*[F.lit(b) for b in range(64)])
    single = F.call_function("shiftright", F.col("bits"), F.col("_b")).bitwiseAND(F.lit(1).cast("long")) == 1
    return words.where("bits <> 0").withColumn("_b", F.explode(places)).where(single).select(
        *keys, (F.col("w") * 64 + F.col("_b")).cast("long").alias("x"), "y", "z")


def _to_lines(words: DataFrame, steps: dict[tuple[int, int], int], keys: Sequence[str]) -> DataFrame:
    """Send every word to the lines it influences; ``r`` is the reach along x."""
    table = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dz).alias("dz"), F.lit(r).alias("r")) for (dy, dz), r in steps.items()])
    moved = words.withColumn("s", F.explode(table))
    kept = [c for c in words.columns if c not in (*keys, "y", "z")]
    return moved.select(*keys, (F.col("y") + F.col("s.dy")).alias("y"), (F.col("z") + F.col("s.dz")).alias("z"),
                        F.col("s.r").alias("r"), ((F.col("s.dy") == 0) & (F.col("s.dz") == 0)).alias("own"), *kept)


def surface(mask: DataFrame, keys: Sequence[str] = IMAGE, shape: str = "ball") -> DataFrame:
    """Mask voxels with a radius-1 neighbour outside the mask ("ball", or the face neighbours "cross")."""
    return surface_of_words(pack_lines(mask, keys), keys, shape)


def surface_of_words(words: DataFrame, keys: Sequence[str] = IMAGE, shape: str = "ball") -> DataFrame:
    """``surface`` of a mask as ``pack_lines`` gives it.

    A voxel is interior if all shifted copies of the neighbouring lines have its bit.
    """
    steps = _line_steps(1, shape)
    line = Window.partitionBy(*keys, "y", "z").orderBy("w")
    beside = lambda fn, step: F.when(fn("w").over(line) == F.col("w") + step, fn("bits").over(line)).otherwise(F.lit(0).cast("long"))
    words = words.withColumns({"_before": beside(F.lag, -1), "_after": beside(F.lead, 1)})
    bits = F.col("bits")
    core = bits.bitwiseAND(_left(bits, 1).bitwiseOR(_right(F.col("_before"), 63))).bitwiseAND(
        _right(bits, 1).bitwiseOR(_left(F.col("_after"), 63)))
    sent = _to_lines(words.withColumn("core", core).drop("_before", "_after"), steps, keys)
    met = sent.groupBy(*keys, "y", "z", "w").agg(
        F.max(F.when(F.col("own"), bits)).alias("bits"), F.count(F.lit(1)).alias("n"),
        F.bit_and(F.when(F.col("r") == 0, bits).otherwise(F.col("core"))).alias("interior"))
    interior = F.when(F.col("n") == len(steps), F.col("interior")).otherwise(F.lit(0).cast("long"))
    border = met.where(F.col("bits").isNotNull()).select(*keys, "y", "z", "w", F.col("bits").bitwiseAND(F.bitwise_not(interior)).alias("bits"))
    return unpack_lines(border, keys)


def dilate(mask: DataFrame, radius: int, keys: Sequence[str] = IMAGE, size: Sequence[int] | None = None) -> DataFrame:
    """Voxels within a ball around the mask, cut to the image ``size`` if given. The radius is below 64."""
    if not 0 <= radius < 64:
        raise ValueError("radius must be between 0 and 63")
    bits = F.col("bits")

    def grown(reach: int) -> dict[int, Column]:
        """Bits that a word gives to itself and to the words before and after it."""
        zero = F.lit(0).cast("long")
        parts = {-1: zero, 0: bits, 1: zero}
        for k in range(1, reach + 1):
            parts[0] = parts[0].bitwiseOR(_left(bits, k)).bitwiseOR(_right(bits, k))
            parts[-1] = parts[-1].bitwiseOR(_left(bits, 64 - k))
            parts[1] = parts[1].bitwiseOR(_right(bits, 64 - k))
        return parts

    steps = _line_steps(radius, "ball")
    by_reach = {r: grown(r) for r in sorted(set(steps.values()))}
    words = pack_lines(mask, keys)
    for r, parts in by_reach.items():
        words = words.withColumn(f"_r{r}", F.array(*[F.struct(F.lit(dw).alias("dw"), part.alias("bits")) for dw, part in parts.items()]))
    sent = _to_lines(words, steps, keys)
    if size is not None:
        sent = sent.where(F.col("y").between(0, size[1] - 1) & F.col("z").between(0, size[2] - 1))
    chosen = F.lit(None)
    for r in by_reach:
        chosen = F.when(F.col("r") == r, F.col(f"_r{r}")).otherwise(chosen)
    given = sent.select(*keys, "y", "z", "w", F.explode(chosen).alias("g")).where("g.bits <> 0")
    merged = given.groupBy(*keys, "y", "z", (F.col("w") + F.col("g.dw")).alias("w")).agg(F.bit_or("g.bits").alias("bits"))
    voxels = unpack_lines(merged, keys)
    return voxels if size is None else voxels.where(F.col("x").between(0, size[0] - 1))


# --- connected components ---------------------------------------------------------------------

def mask_runs(mask: DataFrame, keys: Sequence[str], same: Sequence[str]) -> DataFrame:
    """Maximal runs x0..x1 of consecutive voxels of a line that agree in the ``same`` columns.

    Voxels that are listed twice do no harm, so the mask needs no ``distinct`` before.
    """
    line = Window.partitionBy(*keys, *same, "y", "z").orderBy("x")
    island = mask.withColumn("_island", F.col("x") - F.dense_rank().over(line))
    return island.groupBy(*keys, *same, "y", "z", "_island").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_island")


def connected_components(mask: DataFrame, keys: Sequence[str] = IMAGE, same: Sequence[str] = (), full: bool = False) -> DataFrame:
    """Runs with the component they belong to: columns y, z, x0, x1, ``component`` (struct of z, y, x0).

    Voxels connect by faces, or with ``full`` also by edges and corners, and only where the ``same`` columns agree. A run
    ends at the tile of ``TILE_WIDTH`` voxels it lies in.
    """
    keys, same = list(keys), list(same)
    return components_of_runs(mask.select(*keys, *same, "y", "z", F.col("x").alias("x0"), F.col("x").alias("x1")), keys, same, full)


def components_of_runs(runs: DataFrame, keys: Sequence[str] = IMAGE, same: Sequence[str] = (), full: bool = False) -> DataFrame:
    """``connected_components`` of a mask that is given as runs (y, z, x0, x1).

    Components are found within tiles of bounded size first; a tile is one row and a run in it one number. Only in images of several
    tiles the runs at the faces of tiles form a graph of these components. Each round lets every node follow its smallest neighbours
    a few steps and contracts the graph to the nodes reached, so the rounds shrink quickly; the answers are looked up backwards
    through the rounds. Everything a round leaves behind is checkpointed, so a lost executor never replays earlier rounds.
    """
    keys, same = list(keys), list(same)
    group, tile = [*keys, *same], ["_tx", "_ty", "_tz"]
    kinds = {c: runs.schema[c].dataType for c in ("y", "z", "x0", "x1")}
    lines, width = int(math.log2(TILE_LINES)), int(math.log2(TILE_WIDTH))
    long = lambda c: F.col(c).cast("long")
    cut = runs.select(*group, long("y").alias("y"), long("z").alias("z"), long("x0").alias("x0"), long("x1").alias("x1")).withColumn(
        "_tx", F.explode(F.sequence(F.shiftright("x0", width), F.shiftright("x1", width))))
    low = F.greatest(F.col("x0") - F.col("_tx") * TILE_WIDTH, F.lit(0))
    high = F.least(F.col("x1") - F.col("_tx") * TILE_WIDTH, F.lit(TILE_WIDTH - 1))
    place = F.pmod("z", F.lit(TILE_LINES)) * TILE_LINES + F.pmod("y", F.lit(TILE_LINES))
    packed = cut.select(*group, "_tx", F.shiftright("y", lines).alias("_ty"), F.shiftright("z", lines).alias("_tz"),
                        ((place * TILE_WIDTH + low) * TILE_WIDTH + high).cast("int").alias("run"))
    tiles = packed.groupBy(*group, *tile).agg(F.collect_list("run").alias("runs"))
    out = StructType([*[tiles.schema[c] for c in (*group, *tile)], StructField("runs", ArrayType(IntegerType())), StructField("firsts", ArrayType(IntegerType()))])
    shape = (TILE_LINES, TILE_WIDTH)
    tiles = settle(tiles.mapInArrow(lambda b: _tile_components(b, [*group, *tile], full, *shape), out))

    def rows(of: DataFrame) -> DataFrame:
        """Runs with the first run of their component within the tile (``node``)."""
        line = lambda v: F.floor(v / (TILE_WIDTH * TILE_WIDTH))
        y = lambda v: F.col("_ty") * TILE_LINES + F.pmod(line(v), F.lit(TILE_LINES))
        z = lambda v: F.col("_tz") * TILE_LINES + F.floor(line(v) / TILE_LINES)
        x0 = lambda v: F.col("_tx") * TILE_WIDTH + F.pmod(F.floor(v / TILE_WIDTH), F.lit(TILE_WIDTH))
        x1 = lambda v: F.col("_tx") * TILE_WIDTH + F.pmod(v, F.lit(TILE_WIDTH))
        named = lambda c, name: c.cast(kinds[name]).alias(name)
        single = of.select(*group, *tile, F.explode(F.arrays_zip("runs", "firsts")).alias("_r")).select(*group, *tile, "_r.runs", "_r.firsts")
        v, first = F.col("runs"), F.col("firsts")
        return single.select(*group, named(y(v), "y"), named(z(v), "z"), named(x0(v), "x0"), named(x1(v), "x1"),
                             F.struct(named(z(first), "z"), named(y(first), "y"), named(x0(first), "x0")).alias("node"))

    several = settle(tiles.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*group))
    if several.isEmpty():
        return rows(tiles).withColumnRenamed("node", "component")
    at_face = lambda c, size: F.pmod(F.col(c), F.lit(size)).isin(0, size - 1)
    border = rows(join_summary(tiles, several, group, "left_semi", fits_broadcast(several))).where(
        at_face("y", TILE_LINES) | at_face("z", TILE_LINES) | (F.pmod("x0", F.lit(TILE_WIDTH)) == 0) | (F.pmod("x1", F.lit(TILE_WIDTH)) == TILE_WIDTH - 1))
    slack = 1 if full else 0
    steps = [(0, 0, 1), *((dy, dz, slack) for dy, dz in ([(1, 0), (0, 1), (1, 1), (-1, 1)] if full else [(1, 0), (0, 1)]))]
    table = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dz).alias("dz"), F.lit(gap).alias("gap")) for dy, dz, gap in steps])
    moved = border.withColumn("s", F.explode(table)).select(
        *group, (F.col("y") + F.col("s.dy")).cast(kinds["y"]).alias("y"), (F.col("z") + F.col("s.dz")).cast(kinds["z"]).alias("z"), "s.gap",
        F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("node").alias("a"))
    touching = (F.col("a0") <= F.col("x1") + F.col("gap")) & (F.col("x0") <= F.col("a1") + F.col("gap"))
    links = moved.join(border, [*group, "y", "z"]).where(touching & (F.col("a") != F.col("node"))).select(*group, "a", F.col("node").alias("b"))
    edges = settle(links.unionByName(links.select(*group, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    rounds = []
    while not edges.isEmpty():
        step, small = _follow_smallest(edges, group)
        rounds.append((step, small))
        ends = {side: step.select(*group, F.col("node").alias(side), F.col("to").alias(f"to_{side}")) for side in ("a", "b")}
        contracted = join_summary(join_summary(edges, ends["a"], [*group, "a"], "inner", small), ends["b"], [*group, "b"], "inner", small)
        edges = settle(contracted.where("to_a <> to_b").select(*group, F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct())
    if not rounds:
        return rows(tiles).withColumnRenamed("node", "component")
    answer, small = rounds.pop()
    while rounds:
        earlier, earlier_small = rounds.pop()
        later = answer.select(*group, F.col("node").alias("to"), F.col("to").alias("root"))
        followed = join_summary(earlier, later, [*group, "to"], "left", small)
        answer, small = followed.select(*group, "node", F.coalesce("root", "to").alias("to")), earlier_small
    return rows(tiles).join(answer, [*group, "node"], "left").withColumn("component", F.coalesce("to", "node")).drop("node", "to")


def _tile_components(batches: Iterator[pa.RecordBatch], kept: list[str], full: bool, tall: int, wide: int) -> Iterator[pa.RecordBatch]:
    """Rows (kept columns, runs) become (kept columns, runs, firsts): runs that meet are joined, and each gets the first run of its component.

    A run is the number (line * wide + x0) * wide + x1 with line = z * tall + y; all tiles of a batch are done at once.
    """
    slack = 1 if full else 0
    steps = [(1, 0), (0, 1), (1, 1), (-1, 1)] if full else [(1, 0), (0, 1)]
    stride, room = tall + 2, 2 * wide  # room beside a tile, so that no line or place is taken for one of another
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("runs"))
        tile = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        run = np.unique(tile.astype(np.int64) << 32 | np.asarray(lists.flatten(), np.int64))
        tile, run = run >> 32, run & 0xFFFFFFFF
        line, x0, x1 = run // wide ** 2, run // wide % wide, run % wide
        row = tile * stride * stride + (line // tall + 1) * stride + line % tall + 1
        fresh = np.ones(len(run), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (x0[1:] > x1[:-1] + 1)
        start = np.flatnonzero(fresh)
        tile, line, row, x0 = tile[start], line[start], row[start], x0[start]
        x1 = np.maximum.reduceat(x1, start) if len(start) else x1
        first, last = row * room + x0 + 1, row * room + x1 + 1
        a, b = [], []
        for dy, dz in steps:
            other = (row + dz * stride + dy) * room + 1
            begin, end = np.searchsorted(last, other + x0 - slack, "left"), np.searchsorted(first, other + x1 + slack, "right")
            n = np.maximum(end - begin, 0)
            a.append(np.repeat(np.arange(len(row)), n))
            b.append(np.arange(n.sum()) + np.repeat(begin - np.cumsum(n) + n, n))
        a, b = np.concatenate(a), np.concatenate(b)
        label = np.arange(len(row))
        while True:
            low = np.minimum(label[a], label[b])
            if (label[a] == label[b]).all():
                break
            before = label.copy()
            np.minimum.at(label, before[a], low)
            np.minimum.at(label, before[b], low)
            while (label != label[label]).any():
                label = label[label]
        merged = ((line * wide + x0) * wide + x1).astype(np.int32)
        ends = pa.array(np.append(0, np.cumsum(np.bincount(tile, minlength=batch.num_rows))).astype(np.int32))
        yield pa.record_batch([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.ListArray.from_arrays(ends, pa.array(merged)),
                               pa.ListArray.from_arrays(ends, pa.array(merged[label]))], [*kept, "runs", "firsts"])


def _follow_smallest(edges: DataFrame, group: list[str]) -> tuple[DataFrame, bool]:
    """Where each node gets by going to its smallest neighbour, if that is smaller, up to eight times.

    Also tells whether the table is small enough to broadcast.
    """
    step = settle(edges.groupBy(*group, F.col("a").alias("node")).agg(F.min("b").alias("to")).withColumn("to", F.least("node", "to")))
    small = fits_broadcast(step)
    for _ in range(3):
        onward = step.select(*group, F.col("node").alias("to"), F.col("to").alias("next"))
        step = join_summary(step, onward, [*group, "to"], "inner", small).select(*group, "node", F.col("next").alias("to"))
    return settle(step), small


def component_sizes(components: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Voxels per component, with the component id as text z_y_x of its first voxel."""
    return components.groupBy(*keys, component_id(F.col("component")).alias("component")).agg(
        F.sum(F.col("x1") - F.col("x0") + 1).alias("voxels"))


def component_id(component: Column) -> Column:
    return F.concat_ws("_", component["z"].cast("string"), component["y"].cast("string"), component["x0"].cast("string"))


def component_voxels(components: DataFrame) -> DataFrame:
    """Voxel rows of run rows."""
    kept = [c for c in components.columns if c not in ("x0", "x1")]
    return components.select(*kept, F.explode(F.sequence("x0", "x1")).alias("x"))


def _components_of(components: DataFrame, seeds: DataFrame, keys: Sequence[str], same: Sequence[str]) -> DataFrame:
    """Runs of the components that hold a seed voxel."""
    group = [*keys, *same]
    line = seeds.select(*keys, F.col("x").alias("seed_x"), "y", "z")
    hit = components.join(line, [*keys, "y", "z"]).where(F.col("seed_x").between(F.col("x0"), F.col("x1")))
    chosen = settle(hit.select(*group, "component").distinct())
    return join_summary(components, chosen, [*group, "component"], "left_semi", fits_broadcast(chosen))


def grow_region(image: DataFrame, seeds: DataFrame, low: float | None = 300.0, high: float | None = 500.0,
                keys: Sequence[str] = IMAGE, value: str = "value") -> DataFrame:
    """Voxels in a value band that are face-connected to a seed inside the band.

    Without fixed bounds the band is mean ± sample deviation of the seed values of each image. Instead
    of a frontier that advances voxel by voxel, the components of the band that hold a seed are kept.
    """
    keys = list(keys)
    if low is None or high is None:
        at_seeds = seeds.select(*keys, *XYZ).join(image, [*keys, *XYZ])
        band = settle(at_seeds.groupBy(*keys).agg(F.avg(value).alias("_m"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("_s")))
        inside = join_summary(image, band, keys, "inner", fits_broadcast(band)).where(
            F.col(value).between(F.col("_m") - F.col("_s"), F.col("_m") + F.col("_s")))
    else:
        inside = image.where(F.col(value).between(low, high))
    grown = _components_of(connected_components(inside, keys), seeds, keys, [])
    return component_voxels(grown.drop("component")).select(*keys, *XYZ)


def farthest_in_component(labelmap: DataFrame, seeds: DataFrame, keys: Sequence[str] = IMAGE, label: str = "label",
                          meta: DataFrame | None = None) -> DataFrame:
    """Farthest voxel from each image's seed within the seed's equal-valued component.

    Distances are in index units; with ``meta`` the coordinate is also given in world units
    (index * spacing + origin). Equal distances go to the first voxel in z, y, x order.
    """
    keys = list(keys)
    # only voxels of the seeds' own values can be connected to them
    own = settle(labelmap.join(seeds.select(*keys, *XYZ), [*keys, *XYZ], "left_semi").select(*keys, label).distinct())
    same = join_summary(labelmap, own, [*keys, label], "left_semi", fits_broadcast(own))
    mine = _components_of(connected_components(same, keys, [label]), seeds, keys, [label])
    seed = settle(seeds.select(*keys, *[F.col(c).alias(f"s_{c}") for c in XYZ]))
    rows = join_summary(mine.drop("component", label), seed, keys, "inner", fits_broadcast(seed))
    # within a run the farthest voxel is one of its two ends
    ends = rows.withColumn("x", F.explode(F.array("x0", "x1")))
    d2 = sum(((F.col(c) - F.col(f"s_{c}")) * (F.col(c) - F.col(f"s_{c}")) for c in ("y", "z")),
             (F.col("x") - F.col("s_x")) * (F.col("x") - F.col("s_x")))
    best = ends.withColumn("d2", d2).groupBy(*keys).agg(
        F.max_by(F.struct(*XYZ), F.struct("d2", -F.col("z"), -F.col("y"), -F.col("x"))).alias("at"), F.max("d2").alias("d2"))
    found = best.select(*keys, F.sqrt("d2").alias("distance"), "at.*")
    if meta is None:
        return found
    placed = found.join(meta.select(*keys, "spacing", "origin"), keys)
    return placed.select(*keys, "distance", *XYZ, *[
        (F.col(c) * F.col("spacing")[i] + F.col("origin")[i]).alias(f"w{c}") for i, c in enumerate(XYZ)])


def fill_holes(mask: DataFrame, sizes: DataFrame, keys: Sequence[str] = IMAGE, full: bool = False) -> DataFrame:
    """Mask voxels plus the background regions that do not reach the border of the image.

    ``sizes`` has one ``size`` array per group. The background is what lies between the runs of the mask on each line: it exists as
    runs only, and voxels are written for the holes alone.
    """
    keys = list(keys)
    inside = mask.select(*keys, *XYZ).distinct()
    every = lambda axis: F.explode(F.sequence(F.lit(0).cast("long"), (F.col("size")[axis] - 1).cast("long")))
    grid = sizes.select(*keys, "size", every(1).alias("y")).withColumn("z", every(2))
    held = mask_runs(mask.select(*keys, *XYZ), keys, []).groupBy(*keys, "y", "z").agg(F.array_sort(F.collect_list(F.struct("x0", "x1"))).alias("_held"))
    lines = grid.join(held, [*keys, "y", "z"], "left").withColumn("_held", F.coalesce("_held", F.array().cast(held.schema["_held"].dataType)))
    zero, last = F.lit(0).cast("long"), (F.col("size")[0] - 1).cast("long")
    starts = F.concat(F.array(zero), F.transform("_held", lambda r: F.greatest(r["x1"] + 1, zero)))
    ends = F.concat(F.transform("_held", lambda r: F.least(r["x0"] - 1, last)), F.array(last))
    gaps = F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("x0"), b.alias("x1"))), lambda g: g["x0"] <= g["x1"])
    background = lines.select(*keys, "y", "z", F.explode(gaps).alias("_gap")).select(*keys, "y", "z", "_gap.x0", "_gap.x1")
    components = components_of_runs(background, keys, full=full)
    known = settle(sizes.select(*keys, "size"))
    sized = join_summary(components, known, keys, "inner", fits_broadcast(known))
    at_border = ((F.col("x0") == 0) | (F.col("x1") == F.col("size")[0] - 1) | (F.col("y") == 0)
                 | (F.col("y") == F.col("size")[1] - 1) | (F.col("z") == 0) | (F.col("z") == F.col("size")[2] - 1))
    outside = settle(sized.where(at_border).select(*keys, "component").distinct())
    holes = join_summary(components, outside, [*keys, "component"], "left_anti", fits_broadcast(outside))
    return inside.unionByName(component_voxels(holes.drop("component")).select(*keys, *XYZ))


def points_to_mask(grid: DataFrame, points: DataFrame, value: int = 1, keys: Sequence[str] = IMAGE,
                   by: Column | None = None) -> DataFrame:
    """Grid voxels with ``value`` (or the column ``by`` of the points) at the given points, else 0."""
    marks = points.groupBy(*keys, *XYZ).agg(F.min(F.lit(value) if by is None else by).alias("mask"))
    return grid.select(*keys, *XYZ).join(marks, [*keys, *XYZ], "left").fillna(0, subset=["mask"])
