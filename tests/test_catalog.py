"""The registered queries against their SQL on the smallest tables."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as registry
from voxcohort import catalog
from tools.check import TABLES, difference

DIRECTORY = "/root/testdata/sf0.001"
SAMPLE = ["region_statistics", "label_statistics", "hausdorff95", "connected_components", "zscore_image", "resample_linear",
          "nth_percentile", "flatten_report", "json_diff", "merge_cached_metrics", "cohort_qc", "model_tables", "voxel_features"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="needs the given tables")


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    queries, sql = catalog.queries(), catalog.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 150
    assert set(queries) - set(sql) == {"fuse_staple", "fuse_simple", "pca_projection", "svm_scores"}


def test_entry(spark):
    assert registry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, name):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DIRECTORY}/{table}.parquet'")
    assert difference(registry.queries()[name](spark, DIRECTORY).toPandas(), connection.execute(registry.oracle_sql()[name]).df()) is None


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 150)"
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(__file__)))
    assert said.stdout.strip() == "True", said.stderr[-500:]
