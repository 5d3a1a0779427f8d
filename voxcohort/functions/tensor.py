"""Scalar maps of a diffusion tensor from its ascending eigenvalues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _or_zero(denominator: Column, value: Column) -> Column:
    return F.when(denominator > 0, value).otherwise(F.lit(0.0))


def _signed_cube_root(value: Column) -> Column:
    return F.signum(value) * F.pow(F.abs(value), F.lit(1.0 / 3.0))


def tensor_scalars(l0: Column, l1: Column, l2: Column) -> dict[str, Column]:
    """Named scalars for l0 <= l1 <= l2; an undefined ratio is 0."""
    eigen = [l0, l1, l2]
    trace = l0 + l1 + l2
    total_square = l0 * l0 + l1 * l1 + l2 * l2
    mean = trace / 3
    variance = sum(((v - mean) * (v - mean) for v in eigen[1:]), (l0 - mean) * (l0 - mean)) / 3

    size = [F.abs(v) for v in eigen]
    mean_size = (size[0] + size[1] + size[2]) / 3

    def standardised_moment(power: int) -> Column:
        upper = sum((F.pow(v - mean_size, F.lit(power)) for v in size[1:]), F.pow(size[0] - mean_size, F.lit(power)))
        lower = sum((F.pow(v, F.lit(power)) for v in size[1:]), F.pow(size[0], F.lit(power)))
        return upper / F.when(mean_size > 0, lower)

    norm = F.sqrt(3 * variance)
    mode = _or_zero(norm, l0 * l1 * l2 / F.pow(F.when(norm > 0, norm), F.lit(3)))
    spread = mean * mean + variance
    longest = F.when(l2 > 0, l2)
    return {
        "trace": trace,
        "fa": _or_zero(total_square, F.sqrt(1.5 * 3 * variance / F.when(total_square > 0, total_square))),
        "rd": (l0 + l1) / 2,
        "ad": l2,
        "linear": _or_zero(l2, (l2 - l1) / longest),
        "planar": _or_zero(l2, (l1 - l0) / longest),
        "spherical": _or_zero(l2, l0 / longest),
        "skewness": _or_zero(mean_size, _signed_cube_root(standardised_moment(3))),
        "kurtosis": _or_zero(mean_size, F.pow(standardised_moment(4), F.lit(0.25))),
        "r1": F.sqrt(3 * spread),
        "r2": _or_zero(spread, F.sqrt(1.5 * variance / F.when(spread > 0, spread))),
        "r3": mode,
        "k1": 3 * mean,
        "k2": norm,
        "k3": mode,
    }
