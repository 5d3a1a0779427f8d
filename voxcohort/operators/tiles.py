"""Neighbourhoods of voxels, tile by tile.

An image is cut into cubic tiles. A voxel is sent to its own tile and to those whose voxels have it in reach, so with tiles of at
least eight times the radius fewer than two rows a voxel are shuffled. One row holds a tile with its halo; its size is bounded by the
radius, whatever the image. In a tile, neighbours are found in a dense cube of row numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

XYZ = ["x", "y", "z"]
SMALLEST = 16


def tile_size(radius: int) -> int:
    return max(SMALLEST, 8 * radius)


class Tile:
    """The voxels of a tile and its halo: numpy columns, and which rows are the tile's own (``core``)."""

    def __init__(self, cells: pa.StructArray, corner: np.ndarray, size: int, radius: int):
        self.cells, self.radius = cells, radius
        self.at = np.stack([np.asarray(cells.field(c)) for c in XYZ], axis=1) - (corner * size - radius)
        self.core = np.flatnonzero(((self.at >= radius) & (self.at < radius + size)).all(axis=1))
        self.shape = (size + 2 * radius,) * 3
        self._cube: np.ndarray | None = None

    def column(self, name: str) -> np.ndarray:
        return self.cells.field(name).to_numpy(zero_copy_only=False)

    def cube(self, values: np.ndarray, absent, rows: np.ndarray | None = None) -> np.ndarray:
        """Dense values of ``rows`` (by default all)."""
        out = np.full(self.shape, absent, np.asarray(values).dtype)
        at = self.at if rows is None else self.at[rows]
        out[at[:, 0], at[:, 1], at[:, 2]] = values
        return out

    def neighbour(self, step: tuple[int, int, int], rows: np.ndarray | None = None) -> np.ndarray:
        """Row number of the voxel one step from each core voxel (or from ``rows``), -1 where there is none."""
        if self._cube is None:
            self._cube = self.cube(np.arange(len(self.at)), -1)
        x, y, z = (self.at[self.core if rows is None else rows] + np.array(step)).T
        return self._cube[x, y, z]


def _each(batches: Iterator[pa.RecordBatch], keys: list[str], size: int, radius: int, compute, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            corner = np.array([row.column(row.schema.get_field_index(f"_t{c}"))[0].as_py() for c in XYZ])
            cells = row.column(row.schema.get_field_index("cells")).flatten()
            tile = Tile(cells, corner, size, radius)
            if not len(tile.core):
                continue
            made = compute(tile)
            n = len(next(iter(made.values())))
            if not n:
                continue
            first = pa.array(np.zeros(n, np.int64))
            columns = [row.column(row.schema.get_field_index(k)).take(first) if k in keys else made[k] for k in schema.names]
            columns = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns]
            yield pa.record_batch([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def _tiles(c: str, size: int, reach: int) -> Column:
    """Numbers of the tiles along an axis that need a voxel."""
    tile = lambda place: F.floor(place / size).cast("long")
    return F.explode(F.sequence(tile(F.col(c) - reach), tile(F.col(c) + reach))).alias(f"_t{c}")


def map_tiles(image: DataFrame, radius: int, columns: Sequence[str], keys: Sequence[str], compute: Callable[[Tile], dict],
              out: StructType, near: str | None = None) -> DataFrame:
    """Apply ``compute`` to every tile. It returns the columns of ``out``, which are added to the keys, as arrays of one length.

    Only the rows for which the boolean column ``near`` holds are sent to the halos of other tiles; by default all are.
    """
    keys, size = list(keys), tile_size(radius)
    moved = image.select(*keys, *[F.col(c).cast("long").alias(c) for c in XYZ], *columns)
    for c in XYZ:
        reach = F.lit(radius) if near is None else F.when(F.col(near), radius).otherwise(0)
        moved = moved.select("*", _tiles(c, size, reach))
    tiles = moved.groupBy(*keys, *[f"_t{c}" for c in XYZ]).agg(F.collect_list(F.struct(*XYZ, *columns)).alias("cells"))
    schema = StructType([image.schema[k] for k in keys] + out.fields)
    arrow = to_arrow_schema(schema)
    return tiles.mapInArrow(lambda b: _each(b, keys, size, radius, compute, arrow), schema)


def places(image: DataFrame) -> list[StructField]:
    return [StructField(c, image.schema[c].dataType) for c in XYZ]


def box_sums(image: DataFrame, radius: int, sums: dict[str, Column], keys: Sequence[str]) -> DataFrame:
    """Sums over the box around every voxel of ``image``, at its voxels."""
    named, names = image.select(*keys, *XYZ, *[c.cast("double").alias(n) for n, c in sums.items()]), list(sums)

    def compute(tile: Tile) -> dict:
        made = {c: tile.cells.field(c).take(pa.array(tile.core)) for c in XYZ}
        at = tile.at[tile.core]
        for n in names:
            cube = tile.cube(tile.column(n), 0.0)
            for axis in range(3):  # one axis after the other
                whole = cube.copy()
                for k in range(1, radius + 1):
                    ahead, behind = [slice(None)] * 3, [slice(None)] * 3
                    ahead[axis], behind[axis] = slice(k, None), slice(None, -k)
                    whole[tuple(behind)] += cube[tuple(ahead)]
                    whole[tuple(ahead)] += cube[tuple(behind)]
                cube = whole
            made[n] = cube[at[:, 0], at[:, 1], at[:, 2]]
        return made

    return map_tiles(named, radius, names, keys, compute, StructType([*places(image), *[StructField(n, DoubleType()) for n in names]]))


def pairs(image: DataFrame, radius: int, steps: Sequence[tuple[int, int, int]], keys: Sequence[str], value: str) -> DataFrame:
    """(keys, c_x, c_y, c_z, centre, x, y, z, value): every voxel with each existing voxel at one of the ``steps`` from it."""
    kind = image.schema[value].dataType

    def compute(tile: Tile) -> dict:
        found = [(tile.core, tile.neighbour(step)) for step in steps]
        centre, other = (np.concatenate(x) for x in zip(*[(c[o >= 0], o[o >= 0]) for c, o in found]))
        at = lambda name, rows: tile.cells.field(name).take(pa.array(rows))
        return {**{f"c_{c}": at(c, centre) for c in XYZ}, "centre": at(value, centre), **{c: at(c, other) for c in XYZ}, value: at(value, other)}

    places_ = [StructField(f"c_{c}", LongType()) for c in XYZ] + [StructField("centre", kind)] + [StructField(c, LongType()) for c in XYZ]
    return map_tiles(image.select(*keys, *XYZ, value), radius, [value], keys, compute, StructType([*places_, StructField(value, kind)]))
