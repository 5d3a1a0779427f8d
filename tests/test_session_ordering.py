import numpy as np
import pytest
from pyspark.sql import functions as F

from voxcohort.operators import ordering
from voxcohort.operators import statistics as st
from voxcohort.session import attach


def test_attach_salted_equals_broadcast(spark):
    big = spark.range(2000).select((F.col("id") % 3).alias("k"), "id")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k bigint, name string")
    for how in ("inner", "left"):
        rows = [sorted(map(tuple, attach(big, small, ["k"], how, max_rows=m).select("k", "id", "name").collect()), key=str) for m in (10, 0)]
        assert rows[0] == rows[1]
        assert len(rows[0]) == (2000 if how == "left" else 1334)


@pytest.mark.parametrize("walk_rows", [1_000_000, 40])
def test_select_ranks_is_exact_with_outliers_and_ties(spark, walk_rows):
    rng = np.random.default_rng(1)
    groups = {"a": np.append(rng.normal(size=3000), 1e12), "b": np.repeat([1.0, 2.0, 2.0, 5.0], 500), "c": np.array([7.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "image_id string, value double")
    ranks = {"low": lambda n: F.lit(0), "third": lambda n: F.floor(n / 3), "high": lambda n: n - 1}
    found = {r["image_id"]: r for r in st.select_ranks(df, ranks, walk_rows=walk_rows, bins=16).collect()}
    for name, values in groups.items():
        values = np.sort(values)
        assert (found[name]["low"], found[name]["third"], found[name]["high"]) == (values[0], values[len(values) // 3], values[-1])


def test_moments_and_order_statistics(spark):
    values = [1.0, 2.0, 2.0, 3.0, 10.0]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 4.0)], "image_id string, value double")
    row = {r["image_id"]: r for r in st.moments(df).collect()}
    x = np.array(values)
    z = (x - x.mean()) / x.std(ddof=1)
    assert row["a"]["skewness"] == pytest.approx((z ** 3).mean())
    assert row["a"]["kurtosis"] == pytest.approx((z ** 4).mean())
    assert row["a"]["studentized_range"] == pytest.approx(9 / x.var(ddof=1))
    assert row["b"]["studentized_range"] is None
    assert {r["image_id"]: r["median"] for r in st.median(df).collect()} == {"a": 2.0, "b": 4.0}
    even = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 4.0, 9.0)], "image_id string, value double")
    assert st.median(even).first()["median"] == 3.0
    assert st.mode(spark.createDataFrame([("a", v) for v in (3.0, 3.0, 1.0, 1.0)], "image_id string, value double")).first()["mode"] == 1.0
    legacy = st.mean_abs_deviation(df, legacy=True).where("image_id = 'a'").first()["mean_abs_deviation"]
    assert legacy == pytest.approx(0.0, abs=1e-12)
    constant = spark.createDataFrame([("a", 5.0)] * 4, "image_id string, value double")
    assert [r["zscore"] for r in st.zscores(constant).collect()] == [None] * 4


def test_running_position_and_group_rank(spark):
    orders = [0, 3, 70_000, 70_001, 2 ** 33, 2 ** 33 + 9, 2 ** 50, 2 ** 50 + 2 ** 33, 2 ** 62]
    df = spark.createDataFrame([(o, o % 5 + 1) for o in orders], "o bigint, w bigint")
    found = {r["o"]: r["position"] for r in ordering.running_position(df, "o", F.col("w")).collect()}
    before, expected = 0, {}
    for o in orders:
        expected[o] = before
        before += o % 5 + 1
    assert found == expected
    rng = np.random.default_rng(3)
    rows = [("g", float(v), i) for i, v in enumerate(rng.integers(0, 40, 200))]
    ranked = ordering.rank_in_group(spark.createDataFrame(rows, "k string, v double, i bigint"), ["k"], "v", "i", bins=8)
    assert [r["i"] for r in ranked.orderBy("rank").collect()] == [i for _, _, i in sorted(rows, key=lambda r: (r[1], r[2]))]
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(200))


def test_line_numbers_follow_files(spark, tmp_path):
    """Files of unequal length are numbered one after the other, however Spark packs their blocks."""
    sizes = {"a.txt": 10, "b.txt": 9000, "c.txt": 1, "d.txt": 700}
    for name, n in sizes.items():
        (tmp_path / name).write_text("".join(f"{name} {i}\n" for i in range(n)))
    expected = [f"{name} {i}" for name, n in sizes.items() for i in range(n)]
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for most in ("3000", "50m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            found = ordering.number_lines(spark.read.text(str(tmp_path))).collect()
            assert {r["line"]: r["value"] for r in found} == dict(enumerate(expected))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)


def test_number_lines(spark, tmp_path):
    (tmp_path / "m.txt").write_text("\n".join(f"line {i}" for i in range(5000)))
    lines = spark.read.option("maxPartitionBytes", 1000).text(str(tmp_path / "m.txt"))
    found = ordering.number_lines(lines).collect()
    assert {r["line"]: r["value"] for r in found} == {i: f"line {i}" for i in range(5000)}


def test_small_groups_are_ranked_without_bins(spark, monkeypatch):
    rows = [(k, float(i * 7 % 5), i) for k in ("g", "h") for i in range(30)] + [("hot", float(i * 31 % 100), i) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, v double, i bigint")
    rank = lambda most: {(r["k"], r["i"]): r["rank"] for r in ordering.rank_in_group(df, ["k"], "v", "i", bins=8, whole_rows=most).collect()}
    expected = {(k, i): n for g in ("g", "h", "hot") for n, (k, v, i) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:]))}
    assert rank(50) == rank(10) == expected
    monkeypatch.setattr(ordering, "attach", None)
    assert rank(1000) == expected


def test_cached_metrics_are_merged_without_a_stored_state(spark, monkeypatch):
    from voxcohort.sources import manifests
    schema = "subject string, arch string, region string, measure string, value double"
    full = [("s1", "a", r, m, 1.0) for r, m in manifests.REQUIRED]
    cache = spark.createDataFrame([*full, *[("s2", *f[1:]) for f in full[:5]], ("s3", *full[0][1:])], schema)
    new = spark.createDataFrame([(s, *f[1:4], 2.0) for s in ("s1", "s2") for f in full], schema)
    merged = manifests.merge_cached_metrics(new, cache)
    assert "Join" not in merged._jdf.queryExecution().optimizedPlan().toString()
    counts = {(r["subject"], r["origin"]): r["count"] for r in merged.groupBy("subject", "origin").count().collect()}
    assert counts == {("s1", "cache"): 12, ("s2", "new"): 12, ("s3", "cache"): 1}
