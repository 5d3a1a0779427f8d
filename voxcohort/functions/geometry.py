"""Geometry expressions over image headers: size, spacing, origin and direction arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two directions of each anatomical axis, by the letter an orientation code uses.
AXIS_OF_LETTER = {"R": (0, 1), "L": (0, -1), "A": (1, 1), "P": (1, -1), "I": (2, 1), "S": (2, -1)}
NAMED_PLANES = {"AXIAL": "RAI", "CORONAL": "RSA", "SAGITTAL": "ASL"}


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    total = a[0] * b[0]
    for left, right in zip(a[1:], b[1:]):
        total = total + left * right
    return total


def items(array: Column, n: int = 3) -> list[Column]:
    return [array[i] for i in range(n)]


def matrix(array: Column, n: int = 3) -> list[list[Column]]:
    return [[array[i][j] for j in range(n)] for i in range(n)]


def index_to_world(index: Sequence[Column], spacing: Column, origin: Column, direction: Column) -> list[Column]:
    """origin + direction · (spacing * index), one column per axis."""
    step = [i * s for i, s in zip(index, items(spacing))]
    return [o + dot(row, step) for o, row in zip(items(origin), matrix(direction))]


def _cofactor(m, i: int, j: int) -> Column:
    r = [k for k in range(3) if k != i]
    c = [k for k in range(3) if k != j]
    minor = m[r[0]][c[0]] * m[r[1]][c[1]] - m[r[0]][c[1]] * m[r[1]][c[0]]
    return minor if (i + j) % 2 == 0 else -minor


def world_to_index(point: Sequence[Column], spacing: Column, origin: Column, direction: Column) -> list[Column]:
    """Nearest voxel index of a world point; the 3x3 direction is inverted by cofactors."""
    m = matrix(direction)
    determinant = dot(m[0], [_cofactor(m, 0, j) for j in range(3)])
    offset = [p - o for p, o in zip(point, items(origin))]
    return [
        F.round(dot([_cofactor(m, i, axis) for i in range(3)], offset) / determinant / step).cast("long")
        for axis, step in enumerate(items(spacing))
    ]


def affine_points(point: Sequence[Column], rows: Sequence[Sequence[float]], shift: Sequence[float]) -> list[Column]:
    """matrix · point + shift, cut to integer indices."""
    return [(dot(point, [F.lit(float(v)) for v in row]) + F.lit(float(s))).cast("long") for row, s in zip(rows, shift)]


def world_extent(size: Column, spacing: Column, origin: Column, direction: Column) -> list[Column]:
    """Absolute world distance between the first and the last index, per axis."""
    zero = [F.lit(0.0)] * 3
    last = [s - 1.0 for s in items(size)]
    first_point = index_to_world(zero, spacing, origin, direction)
    last_point = index_to_world(last, spacing, origin, direction)
    return [F.abs(b - a) for a, b in zip(first_point, last_point)]


def point_distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Euclidean distance of two points with the same number of axes."""
    difference = [p - q for p, q in zip(a, b)]
    return F.sqrt(dot(difference, difference))


def parse_orientation(code: str) -> list[tuple[int, int]]:
    """Anatomical axis and sign of each image axis; raises on anything but the 48 valid codes."""
    letters = NAMED_PLANES.get(code.upper(), code.upper())
    if len(letters) != 3 or any(c not in AXIS_OF_LETTER for c in letters):
        raise ValueError(f"invalid orientation code {code!r}")
    axes = [AXIS_OF_LETTER[c] for c in letters]
    if len({axis for axis, _ in axes}) != 3:
        raise ValueError(f"invalid orientation code {code!r}")
    return axes


def orientation_steps(source: str, target: str) -> list[tuple[int, int]]:
    """For each axis of the target: the source axis it comes from and whether it is flipped (-1)."""
    origin, wanted = parse_orientation(source), parse_orientation(target)
    steps = []
    for axis, sign in wanted:
        position = next(i for i, (a, _) in enumerate(origin) if a == axis)
        steps.append((position, sign * origin[position][1]))
    return steps


def reorient_index(index: Sequence[Column], size: Sequence[Column], source: str, target: str) -> list[Column]:
    return [index[axis] if sign > 0 else size[axis] - 1 - index[axis]
            for axis, sign in orientation_steps(source, target)]


def reorient_vector(vector: Sequence[Column], source: str, target: str) -> list[Column]:
    return [vector[axis] if sign > 0 else -vector[axis] for axis, sign in orientation_steps(source, target)]


def orientation_code(direction: Column) -> Column:
    """Orientation letters of an image from its direction cosines (the largest entry of each column)."""
    letters = []
    for axis in range(3):
        column = [direction[row][axis] for row in range(3)]
        sizes = [F.abs(v) for v in column]
        largest = F.greatest(*sizes)
        letters.append(
            F.when(sizes[0] == largest, F.when(column[0] > 0, "R").otherwise("L"))
            .when(sizes[1] == largest, F.when(column[1] > 0, "A").otherwise("P"))
            .otherwise(F.when(column[2] > 0, "I").otherwise("S")))
    return F.concat(*letters)


def mahalanobis(x: Sequence[Column], mean: Sequence[Column], packed: Sequence[Column]) -> Column:
    """(x-mean)' C (x-mean) with C given as its packed upper triangle, row by row."""
    n = len(x)
    if len(packed) != n * (n + 1) // 2:
        raise ValueError("packed triangle does not fit the number of components")
    d = [a - b for a, b in zip(x, mean)]
    entry = iter(packed)
    terms = [(d[i] * d[j] * next(entry)) * (1 if i == j else 2) for i in range(n) for j in range(i, n)]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def slice_direction(row: Column, column: Column) -> Column:
    """Unit normal of a slice from its row and column direction."""
    r, c = items(row), items(column)
    cross = [r[1] * c[2] - r[2] * c[1], r[2] * c[0] - r[0] * c[2], r[0] * c[1] - r[1] * c[0]]
    length = F.sqrt(dot(cross, cross))
    return F.array(*[v / length for v in cross])
