"""Per-voxel value expressions. All take and return Spark columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Component types of images; an unsigned type becomes the next wider signed one.
COMPONENT_TYPES = {
    "char": "tinyint", "uchar": "smallint", "short": "smallint", "ushort": "int", "int": "int", "uint": "bigint",
    "long": "bigint", "ulong": "decimal(20,0)", "longlong": "bigint", "ulonglong": "decimal(20,0)",
    "float": "float", "double": "double",
}

FLOAT_MAX = 3.4028234663852886e38


def threshold_above(value: Column, high: float, outside: float = 0.0) -> Column:
    return F.when(value > high, F.lit(outside)).otherwise(value)


def threshold_below(value: Column, low: float, outside: float = 0.0) -> Column:
    return F.when(value < low, F.lit(outside)).otherwise(value)


def threshold_outside(value: Column, low: float, high: float, outside: float = 0.0) -> Column:
    return F.when(value.between(low, high), value).otherwise(F.lit(outside))


def threshold_binary(value: Column, low: float, high: float, inside: float = 1.0, outside: float = 0.0) -> Column:
    return F.when(value.between(low, high), F.lit(inside)).otherwise(F.lit(outside))


def create_mask(value: Column, lower: float = 1.0, upper: float = FLOAT_MAX) -> Column:
    return F.coalesce(value.between(lower, upper), F.lit(False)).cast("int")


def change_values(value: Column, old: Sequence[float], new: Sequence[float]) -> Column:
    """Replace values pair by pair; a later pair sees the result of the earlier ones."""
    if len(old) != len(new):
        raise ValueError("old and new values must have the same length")
    for before, after in zip(old, new):
        value = F.when(value == F.lit(before), F.lit(after)).otherwise(value)
    return value


def cast_values(value: Column, component_type: str) -> Column:
    """Change the component type; a fraction is cut off when the target is an integer type."""
    return value.cast(COMPONENT_TYPES[component_type.lower()])


def round_values(value: Column) -> Column:
    return F.round(value)


def vote_key(score: Column, label: Column) -> Column:
    """Order by score; equal scores go to the lowest label."""
    return F.struct(score, -label)
