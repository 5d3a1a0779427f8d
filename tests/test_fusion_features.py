import numpy as np
import pytest
from pyspark.sql import functions as F

from voxcohort import catalog
from voxcohort.operators import features as fe
from voxcohort.operators import fusion as fu


def rater_table(spark, maps):
    rows = [("a", f"r{i}", *map(int, p), int(m[p])) for i, m in enumerate(maps) for p in np.ndindex(m.shape)]
    return spark.createDataFrame(rows, "image_id string, rater string, x bigint, y bigint, z bigint, label int")


@pytest.fixture(scope="module")
def truth():
    labels = np.zeros((6, 6, 6), dtype=int)
    labels[1:5, 1:5, 1:5] = 2
    labels[1:3, 1:5, 1:5] = 1
    labels[2:4, 2:4, 2:4] = 4
    return labels


def as_volume(df, shape):
    out = np.zeros(shape, dtype=int)
    for r in df.collect():
        out[r["x"], r["y"], r["z"]] = r["label"]
    return out


def test_staple_and_simple_recover_the_truth(spark, truth):
    rng = np.random.default_rng(4)
    maps = []
    for i in range(4):
        noisy = truth.copy()
        flip = rng.random(truth.shape) < 0.08
        noisy[flip] = rng.choice([0, 1, 2, 4], flip.sum())
        maps.append(noisy)
    bad = rng.choice([0, 1, 2, 4], truth.shape)
    table = rater_table(spark, [*maps, bad])
    staple = as_volume(fu.fuse_staple(table), truth.shape)
    simple = as_volume(fu.fuse_simple(table), truth.shape)
    wrong = lambda v: (v != truth).sum()
    # every class occurs in the truth; a class that only exists as noise is fitted to the noise by the model
    best_rater = min(wrong(m) for m in maps)
    assert wrong(staple) < best_rater and wrong(simple) < best_rater


def test_unanimous_maps_stay(spark, truth):
    table = rater_table(spark, [truth] * 3)
    for fuse in (fu.fuse_staple, fu.fuse_simple, fu.fuse_majority, fu.fuse_voting):
        assert (as_volume(fuse(table), truth.shape) == truth).all()


def test_staple_separates_good_from_bad_raters():
    rng = np.random.default_rng(6)
    real = rng.random(5000) < 0.3
    votes = np.stack([np.where(rng.random(5000) < a, real, ~real) for a in (0.95, 0.9, 0.9, 0.6)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    weight, p, q = fu.staple_posterior(patterns, counts, 200, 1e-8)
    assert p[0] == pytest.approx(0.95, abs=0.03) and q[0] == pytest.approx(0.95, abs=0.03) and p[3] < 0.7
    # the pattern table gives exactly what the single voxels would
    full, p_full, _ = fu.staple_posterior(votes, np.ones(5000), 200, 1e-8)
    assert p_full == pytest.approx(p, abs=1e-6)


def test_ties(spark):
    table = rater_table(spark, [np.full((1, 1, 1), v) for v in (1, 2)])
    assert fu.fuse_majority(table).first()["label"] == 1
    assert fu.fuse_voting(table).first()["label"] == 3
    assert fu.fuse_voting(table, undecided=9).first()["label"] == 9


def test_scaling_and_pca(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 4)) * [5, 2, 1, 0] + [1, 2, 3, 4]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id int, features array<double>")
    scaled = np.array([r["features"] for r in fe.scale_transform(df, fe.scale_fit(df)).orderBy("id").collect()])
    assert scaled[:, :3].std(axis=0, ddof=1) == pytest.approx([1, 1, 1]) and (scaled[:, 3] == 0).all()
    fitted = fe.pca_fit(df, 2)
    rows = np.array([r["projected"] for r in fe.pca_transform(df, fitted).orderBy("id").collect()])
    values, vectors = np.linalg.eigh(np.cov(x.T))
    loading = vectors[:, ::-1][:, :2]
    loading = loading * np.sign([c[abs(c).argmax()] for c in loading.T])
    assert rows == pytest.approx((x - x.mean(axis=0)) @ loading, abs=1e-6)
    assert rows.var(axis=0, ddof=1) == pytest.approx(values[::-1][:2])


def test_pca_projection_has_full_rank(spark, tmp_path):
    x = np.random.default_rng(10).normal(size=(50, 6)).astype(np.float32)
    spark.createDataFrame([(i, row.tolist(), 0) for i, row in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = catalog.queries()["pca_projection"](spark, str(tmp_path)).collect()
    got = np.full(x.shape, np.nan)
    for r in rows:
        got[r["vec_id"], r["component"]] = r["value"]
    vectors = np.linalg.eigh(np.cov(x.T.astype(float)))[1][:, ::-1]
    vectors = vectors * np.sign([c[abs(c).argmax()] for c in vectors.T])
    assert len(rows) == x.size and got == pytest.approx((x - x.mean(axis=0, dtype=float)) @ vectors, abs=1e-5)


def test_svm_separates(spark):
    rows = [(float(i % 2), [3.0 * (i % 2) + (i % 7) * 0.1, 1.0]) for i in range(100)]
    df = spark.createDataFrame(rows, "label double, features array<double>")
    scored = fe.svm_score(df, fe.svm_fit(df)).collect()
    assert all(r["predicted"] == r["label"] for r in scored)
    assert all((r["score"] > 0) == (r["label"] == 1.0) for r in scored)


def test_split_is_stable_and_balance_keeps_near(spark):
    subjects = spark.range(1000).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("subject_id"))
    one = {r["subject_id"]: r["split"] for r in fe.train_val_split(subjects).collect()}
    two = {r["subject_id"]: r["split"] for r in fe.train_val_split(subjects.repartition(7)).collect()}
    assert one == two and 740 < sum(v == "train" for v in one.values()) < 860
    train = fe.near_far_training(spark.range(10).select(F.col("id")), spark.range(100, 155).select(F.col("id")))
    kept = fe.balance_by_stride(train, "id")
    assert sorted(r["id"] for r in kept.collect()) == [*range(10), *range(100, 155, 5)]
