import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[4]").appName("voxcohort-tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def voxel_table(spark):
    """Rows (image_id, x, y, z, <name>) of numpy volumes, zeros left out if asked."""
    def make(volumes, name="value", sparse=False, kind="double"):
        rows = [(image, *map(int, at), v.item()) for image, volume in volumes.items()
                for at, v in zip([p for p in __import__("numpy").ndindex(volume.shape)], volume.ravel())
                if not sparse or v != 0]
        return spark.createDataFrame(rows, f"image_id string, x bigint, y bigint, z bigint, {name} {kind}")
    return make
