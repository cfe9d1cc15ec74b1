"""Boosters grown in one barrier stage: MLlib's trees, whatever the layout of the rows."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from panelrisk.operators import artifact, boosting, models

DEEP = {"maxIter": 8, "maxDepth": 4, "stepSize": 0.1}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=1500), rng.integers(0, 5, 1500), rng.integers(0, 40, 1500), np.zeros(1500)])
    y = (x[:, 0] + 0.3 * x[:, 1] * (x[:, 2] > 20) + rng.normal(size=1500) > 1).astype(float)
    made = [(i, Vectors.dense(v), float(t)) for i, (v, t) in enumerate(zip(x.tolist(), y))]
    return spark.createDataFrame(made, ["id", "features", "label"]).repartition(3, "id").cache()


def scores(model, rows):
    return np.array([r.score for r in models.score(model, rows).orderBy("id").select("score").collect()])


def test_same_scores_as_mllib(rows):
    weighted = models.with_class_weight(rows, "label")
    est = models.build("gbt_depth6", "weight", DEEP)
    ours, theirs = models.fit("gbt_depth6", rows, DEEP), est.fit(weighted)
    assert np.allclose(scores(ours, rows), scores(theirs, rows), atol=1e-9)
    assert np.allclose(ours.featureImportances.toArray(), theirs.featureImportances.toArray(), atol=1e-9)


def test_one_job_grows_all_trees(spark, rows):
    """MLlib starts a job for each level of each tree; the number of jobs must not grow with the trees."""
    def jobs(n):
        group = f"boost-{n}"
        spark.sparkContext.setJobGroup(group, group)
        models.fit("gbt_regularized", rows, {"maxIter": n})
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(6) == jobs(2)


def test_draws_rows_and_features_and_repeats(rows):
    a = models.fit("gbt", rows, {"maxIter": 5})
    b = models.fit("gbt", rows, {"maxIter": 5})
    assert np.array_equal(scores(a, rows), scores(b, rows))
    assert a.trees[1].toDebugString != models.fit("gbt", rows, {"maxIter": 5, "subsamplingRate": 1.0}).trees[1].toDebugString


def test_min_rows_and_depth(rows):
    m = models.fit("gbt_regularized", rows, {"maxIter": 3})
    assert all(t.depth <= 3 for t in m.trees) and m.getNumTrees == 3
    assert "feature 3 " not in m.toDebugString  # one value only


def test_model_is_stored_and_loaded(spark, rows, tmp_path):
    flat = rows.select("id", "label", *[vector_to_array("features")[i].alias(f"f{i}") for i in range(4)])
    m = artifact.refit(flat, [f"f{i}" for i in range(4)], [], "gbt_regularized", {"maxIter": 3})
    m.save(str(tmp_path), spark)
    one, two = (x.score(flat, ["id"]).orderBy("id").collect() for x in (m, artifact.load(spark, str(tmp_path))))
    assert one == two


def test_best_cut_by_brute_force():
    rng = np.random.default_rng(0)
    sums = np.stack([rng.integers(0, 9, (3, 2, 6)).astype(float)] * 3)
    sums[0, :, 1] *= sums[0, :, 0].sum(1, keepdims=True) / sums[0, :, 1].sum(1, keepdims=True)
    sums[1] = sums[0]
    sums[2] = sums[0] * rng.normal(size=sums[0].shape)
    sums[2, :, 1, -1] += sums[2, :, 0].sum(1) - sums[2, :, 1].sum(1)
    gain, feature, where = boosting.best_cuts(sums, 3)
    for k in range(3):
        best = 0.0
        for f in range(2):
            for c in range(5):
                nl, nr = sums[0, k, f, : c + 1].sum(), sums[0, k, f, c + 1 :].sum()
                sl, sr = sums[2, k, f, : c + 1].sum(), sums[2, k, f, c + 1 :].sum()
                if min(nl, nr) >= 3:
                    best = max(best, (sl**2 / nl + sr**2 / nr - (sl + sr) ** 2 / (nl + nr)) / (nl + nr))
        assert gain[k] == pytest.approx(best)


@pytest.mark.parametrize("label", [0.0, 1.0])
def test_one_class(rows, label):
    m = models.fit("gbt_regularized", rows.withColumn("label", F.lit(label)), {"maxIter": 2})
    assert len(set(scores(m, rows))) == 1


def test_other_labels_are_refused(rows):
    with pytest.raises(Exception):
        models.fit("gbt_regularized", rows.withColumn("label", F.lit(2.0)), {"maxIter": 2})


def test_matrices_hold_the_vector_only(spark):
    """The written matrices held every feature twice, in the vector and in a column of its own."""
    from panelrisk.plans.train import prepare_matrices
    from panelrisk.spec import FIXTURE_SPEC as S

    row = "SELECT id AS entity_id, date'2020-01-01' AS date, IF(id % 4 = 0, 'test', 'train') AS split, double(id % 2) AS label, double(id) AS a, id % 3 AS b FROM range(40)"
    p, train, test = prepare_matrices(spark.sql(row), S)
    assert train.columns == ["entity_id", "date", "split", "label", "features"] == test.columns
    assert (train.count(), test.count()) == (30, 10)
    assert [float(v) for v in test.orderBy("entity_id").first().features] == [0.0, 0.0]


def test_bundles_hold_every_feature_and_bin():
    """Features of few bins share a count; the sums of each come apart again."""
    rng = np.random.default_rng(1)
    bins = [32, 2, 7, 256, 32, 1, 2, 12]
    x = np.array([rng.integers(0, b, 500) for b in bins]).astype(np.uint8)
    u = boosting._Bundles(bins)
    assert sorted(j for own in u.features for j in own) == list(range(8)) and len(u.sizes) < 5 and max(u.sizes) <= boosting.MOST_CELLS
    codes = u.codes(x)
    sums = [np.stack([np.bincount(c, minlength=k)[None], np.bincount(c, np.arange(500.0), k)[None]]) for c, k in zip(codes, u.sizes)]
    got = u.apart(sums, max(bins))
    for j, b in enumerate(bins):
        assert np.array_equal(got[0, 0, j, :b], np.bincount(x[j], minlength=b)) and not got[:, :, j, b:].any()
        assert np.array_equal(got[1, 0, j, :b], np.bincount(x[j], np.arange(500.0), b))
        right = u.goes_right(np.array([j]), np.array([b // 2]))[0]
        assert np.array_equal(right[codes[u.of[j]]], x[j] > b // 2)


@pytest.mark.parametrize("weights", [(1.0, 3.7), None])
def test_sums_do_not_depend_on_blocks_or_bundles(weights, monkeypatch):
    """Exact sums: however rows and features are joined, the trees are the same to the last bit."""
    rng = np.random.default_rng(2)
    bins, batches = [32, 2, 7, 32, 32], []
    for _ in range(6):
        x = np.array([rng.integers(0, b, 300) for b in bins]).astype(np.uint8)
        x[4] = x[3]  # equal features: every cut ties
        y = ((x[0] > 16) ^ (x[3] > 20) ^ (rng.random(300) < 0.2)).astype(float)
        w = np.where(y > 0, 3.7, 1.0) * (1 if weights else rng.random(300))
        batches.append((x.tobytes(), y.tobytes(), w.tobytes()))
    s = boosting.Settings(4, 0.1, 4, 5, 0.8, 5, 42, boosting.exact_scale(1800, 3.7), weights)

    class own:
        total = staticmethod(np.copy)

    def trees(rows, cells):
        monkeypatch.setattr(boosting, "BLOCK_ROWS", rows)
        u = boosting._Bundles(bins, cells)
        blocks = [boosting._Block(b, u, s) for b in boosting._runs(list(batches))]
        return len(blocks), len(u.sizes), [boosting._one_tree(own, blocks, u, s, t) for t in range(1)]

    (n, k, a), (m, j, b) = trees(300, 1), trees(10_000, 1024)
    assert (n, m) == (6, 1) and j < k == 5
    for p, q in zip(a, b):
        assert all(np.array_equal(p[c], q[c]) for c in ("feature", "cut", "left", "gain")) and len(p["left"]) > 5
        assert 4 not in p["feature"]  # the first of equal features


def test_weights_that_differ_within_a_class(rows):
    """The general sums give MLlib's trees as well."""
    some = rows.withColumn("weight", 0.5 + F.col("id") % 7)
    est = models.build("gbt_depth6", "weight", DEEP)
    assert np.allclose(scores(boosting.fit(est, some), rows), scores(est.fit(some), rows), atol=1e-9)


def test_rows_that_do_not_fit_lie_in_a_scratch_file(rows, monkeypatch, tmp_path):
    """A task holds a bounded part of its rows in memory; the trees are the same."""
    rng = np.random.default_rng(4)
    bins, s = [32, 2, 7], boosting.Settings(6, 0.1, 4, 5, 0.8, 2, 42, boosting.exact_scale(40_000, 2.0), (1.0, 2.0))
    batches = []
    for _ in range(10):
        x = np.array([rng.integers(0, b, 4000) for b in bins]).astype(np.uint8)
        y = ((x[0] > 16) ^ (rng.random(4000) < 0.2)).astype(float)
        batches.append((x.tobytes(), y.tobytes(), np.where(y > 0, 2.0, 1.0).tobytes()))

    class own:
        total = staticmethod(np.copy)

    monkeypatch.setattr(boosting, "BLOCK_ROWS", 8000)
    u, grown = boosting._Bundles(bins), {}
    for most in (1 << 40, 100_000, 0):
        shelf = boosting._Shelf(most)
        blocks = [boosting._Block(b, u, s, shelf) for b in boosting._runs([boosting._coded(b, u, shelf) for b in batches])]
        grown[most] = [boosting._one_tree(own, blocks, u, s, t) for t in range(s.trees)]
        held = sum(k.values.nbytes for b in blocks for k in (*b.codes, b.y, b.w, b.margin, b.target, b.at, b.some) if k.values is not None)
        assert (shelf.file is None) == (most == 1 << 40) and held <= most
    for a in (grown[100_000], grown[0]):
        assert all(np.array_equal(p[c], q[c]) for p, q in zip(a, grown[1 << 40]) for c in p)
    want = scores(models.fit("gbt", rows, {"maxIter": 4}), rows)
    monkeypatch.setattr(boosting, "HELD_BYTES", 0)
    assert np.array_equal(scores(models.fit("gbt", rows, {"maxIter": 4}), rows), want)
