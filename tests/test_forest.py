"""Forests on packed bins: the same trees however rows lie and wherever they are grown,
splits against brute force, draws, saving."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvid.operators import forest as R
from corvid.operators import models as M
from corvid.operators import prep
from corvid.sources import views
from tests.conftest import SF_SMALL

FEATS = views.OBS_FEATURES


@pytest.fixture(scope="module")
def sig(spark):
    return prep.stratified_split(views.sig(spark, SF_SMALL), test_size=0.2, seed=42).cache()


def _scores(model, rows):
    return {r["id"]: r["p1"] for r in M.score(model, rows).collect()}


def test_deep_forest_is_no_pass_per_level_and_does_not_depend_on_layout(spark, sig, monkeypatch):
    train, test = sig.where("split = 'train'"), sig.where("split = 'test'")
    p = {"numTrees": 5, "maxDepth": 20}
    sig.count()
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("forest", "")
    m = M.fit(train, FEATS, "rf", p)
    deep = len(jobs.getJobIdsForGroup("forest"))
    spark.sparkContext.setJobGroup("shallow", "")
    M.fit(train, FEATS, "rf", {**p, "maxDepth": 7})
    assert deep == len(jobs.getJobIdsForGroup("shallow"))          # thirteen levels more, no job more
    spark.sparkContext.setJobGroup("rest", "")
    want = _scores(m, test)
    assert max(len(feature) for feature, *_ in R.stored(m.path)) > 2 ** 7     # grown to the end
    assert _scores(M.fit(train.repartition(5), FEATS, "rf", p), test) == want
    monkeypatch.setattr(R, "LOCAL", 40)        # upper levels by aggregates
    monkeypatch.setattr(R, "BLOCK", 64)
    other = M.fit(train, FEATS, "rf", p)
    assert _scores(other, test) == want
    assert np.allclose([g for _, g in M.importances(other)], [g for _, g in M.importances(m)])


def test_a_tree_is_the_greedy_tree():
    rng = np.random.default_rng(5)
    bins, y = rng.integers(1, 6, (300, 3)).astype(np.uint8), rng.integers(0, 2, 300).astype(np.uint8)
    w, weights, p = rng.integers(1, 4, 300).astype(np.uint8), (1.0, 1.7), R.Params(1, 4, min_rows=3, bootstrap=False)
    tree, _ = R.grown(bins, y, w, 0, 1, 4, 7, weights, p)
    leaf = R.walked(tree["feature"], tree["cut"], tree["down"], bins)

    def good(rows):
        c = np.array([w[rows][y[rows] == 0].sum() * weights[0], w[rows][y[rows] == 1].sum() * weights[1]])
        return (c ** 2).sum() / c.sum()

    def check(rows, node, depth):
        found = [(good(rows[go]) + good(rows[~go]) - good(rows), j, c) for j in range(3) for c in range(6)
                 for go in [bins[rows, j] <= c] if min(w[rows[go]].sum(), w[rows[~go]].sum()) >= 3] if depth < 4 else []
        top = max((g for g, *_ in found), default=0.0)
        if tree["feature"][node] < 0:
            assert top < 1e-6 and (leaf[rows] == node).all()
            ones = w[rows][y[rows] == 1].sum() * weights[1]
            assert abs(tree["value"][node] - ones / (ones + w[rows][y[rows] == 0].sum())) < 1e-12
            return 1
        go = bins[rows, tree["feature"][node]] <= tree["cut"][node]
        assert abs(good(rows[go]) + good(rows[~go]) - good(rows) - top) < 1e-9
        return check(rows[go], tree["down"][node], depth + 1) + check(rows[~go], tree["down"][node] + 1, depth + 1)

    assert check(np.arange(300), 0, 0) > 8


def test_draws_are_poisson_and_differ_by_tree():
    mark = np.arange(200_000, dtype=np.uint64)
    a, b = (R.draws(mark, t, R.Params()).astype(int) for t in (0, 1))
    assert abs(a.mean() - 1) < 0.01 and abs(a.var() - 1) < 0.02 and abs(np.corrcoef(a, b)[0, 1]) < 0.01
    assert (R.draws(mark, 3, R.Params(bootstrap=False)) == 1).all()
    may = R.allowed(2, np.arange(1, 5000), 7, R.Params(subset="0.5"))
    assert may.shape[1] == 4 and (np.diff(may, axis=1) > 0).all()
    assert np.allclose(np.bincount(may.ravel(), minlength=7) / len(may), 4 / 7, atol=0.03)


def test_odd_rows_and_saving(spark, tmp_path):
    df = spark.createDataFrame([(i if i % 5 else None, float("nan") if i % 7 == 0 else None if i % 11 == 0 else float(i % 13), None,
                                 None if i == 3 else int(i % 13 > 6)) for i in range(400)], "id long, a double, b double, label int")
    m = M.fit(df, ["a", "b"], "rf", {"numTrees": 4, "maxDepth": 3})
    assert M.feature_names(m) == ["a"]
    rows = M.score(m, df.withColumn("label", F.coalesce("label", F.lit(0)))).collect()
    assert len(rows) == 400 and np.mean([r["prediction"] == r["label"] for r in rows]) > 0.85
    M.save(m, f"file://{tmp_path}/m")
    back = M.load(f"file://{tmp_path}/m")
    assert sorted(r["p1"] for r in M.score(back, df).collect()) == sorted(r["p1"] for r in rows)
    one = M.fit(df.where("label = 1"), ["a"], "subspace", {"numTrees": 2, "maxDepth": 8})
    assert {r["p1"] for r in M.score(one, df).collect()} == {1.0}
