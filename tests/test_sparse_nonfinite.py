"""Order statistics with infinities and NaN, and arithmetic and comparison of sparse images."""

import math

import numpy as np
import pytest

from voxcohort.operators import histograms, statistics, voxels

VOXEL = "image_id string, x bigint, y bigint, z bigint, value double"


@pytest.mark.parametrize("odd", [[], [math.inf], [-math.inf, math.inf], [math.nan], [math.nan, math.inf, -math.inf] * 4,
                                 [1e308, -1e308], [7.0] * 80])
def test_ranks_end_on_every_input(spark, odd):
    values = [*np.random.default_rng(4).normal(size=60).tolist(), *odd]
    rows = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0)] * 50 + [("c", math.nan)] * 50, "image_id string, value double")
    wanted = {"first": lambda n: n * 0, "middle": lambda n: n / 2, "last": lambda n: n - 1}
    found = {r.image_id: r for r in statistics.select_ranks(rows, wanted, ["image_id"], bins=4, walk_rows=5).collect()}
    ordered = sorted((v for v in values if not math.isnan(v))) + [v for v in values if math.isnan(v)]
    expected = [ordered[0], ordered[len(ordered) // 2], ordered[-1]]
    assert np.array_equal([found["a"].first, found["a"].middle, found["a"].last], expected, equal_nan=True)
    assert found["b"].middle == 1.0 and math.isnan(found["c"].middle)


def test_absent_voxels_are_zero(spark):
    a = spark.createDataFrame([("i", 0, 0, 0, 2.0), ("i", 1, 0, 0, 3.0)], VOXEL)
    b = spark.createDataFrame([("i", 1, 0, 0, 5.0), ("i", 2, 0, 0, 7.0)], VOXEL)
    values = lambda op: {r.x: r.value for r in voxels.image_arithmetic(a, b, op, 0.5).collect()}
    assert values("add") == {0: 2.0, 1: 8.0, 2: 7.0} and values("subtract") == {0: 2.0, 1: -2.0, 2: -7.0}
    assert values("add_scaled") == {0: 2.0, 1: 5.5, 2: 3.5} and values("multiply") == {1: 15.0}
    row = histograms.compare_images(a, b).first()
    assert (row.voxels, row.differing, row.total) == (3, 3, 11.0)
    assert histograms.compare_images(a, b.where("x > 5"), radius=1).first().differing == 2
