"""Histogram boosting: blocks against one block, brute-force trees, losses
recomputed from saved trees, folds, early stop, stumps."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvid.operators import boosting as B
from corvid.operators import models as M
from corvid.operators import prep
from corvid.plans import train as T
from corvid.sources import io, views
from tests.conftest import SF_SMALL

FEATS = views.OBS_FEATURES


@pytest.fixture(scope="module")
def sig(spark):
    return prep.stratified_split(views.sig(spark, SF_SMALL), test_size=0.2, seed=42).cache()


def _local(df, features, label="label"):
    d = df.select(*features, label).toPandas()
    return [d[c].to_numpy(float) for c in features], d[label].to_numpy(float)


def test_many_blocks_give_the_trees_of_one(spark, sig, monkeypatch):
    monkeypatch.setattr(B, "RENEW", 2)
    train = prep.kfold(sig.where("split = 'train'"), 3)
    for p in (B.Params(5, 3, 0.3, bins=32), B.Params(4, 1, kind="samme", bins=32)):
        one = B.fit(train, FEATS, "x", p, folds=("fold", 3))
        many = B.fit(train.repartition(7), FEATS, "x", p, folds=("fold", 3), block=200)
        assert [m.as_dict() for m in one] == [m.as_dict() for m in many] and all(len(m.trees) == p.rounds for m in one)


def _plain_tree(bins, g, h, p, n_bins):
    """Greedy tree by trying every split of every node; scores per row."""
    out = np.zeros(bins.shape[1])

    def grow(rows, depth):
        G, H = g[rows].sum(), h[rows].sum()
        best = None
        for j in range(len(bins)) if depth < p.depth else ():
            for c in range(n_bins - 1):
                go = bins[j, rows] <= c
                if not p.min_rows <= go.sum() <= len(rows) - p.min_rows:
                    continue
                a, b = (g[rows[go]].sum(), h[rows[go]].sum()), (g[rows[~go]].sum(), h[rows[~go]].sum())
                gain = (a[0] ** 2 / (a[1] + p.l2) + b[0] ** 2 / (b[1] + p.l2) - G ** 2 / (H + p.l2))
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                    best = gain, rows[go], rows[~go]
        if best:
            grow(best[1], depth + 1)
            grow(best[2], depth + 1)
        else:
            out[rows] = -G / (H + p.l2) * p.step if depth else 0.0

    grow(np.arange(bins.shape[1]), 0)
    return out


def test_equals_brute_force(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, float(a), None if i % 11 == 0 else float(b), float("nan") if i % 13 == 0 else float(a + b), int(a * b > 0.1))
            for i, (a, b) in enumerate(rnd.normal(size=(160, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, label int")
    p = B.Params(6, 3, 0.3, bins=12, l2=0.5, min_rows=3)
    m = B.fit(df, ["a", "b", "c"], "x", p)[0]
    x, y = _local(df, m.features)
    bins = B.binned(x, [np.array(m.edges[c]) for c in m.features])
    assert (bins[1] == 0).sum() == 15 and bins.max() <= 12
    score = np.full(len(y), math.log(y.sum() / (len(y) - y.sum())))
    for _ in range(p.rounds):
        prob = 1 / (1 + np.exp(-score))
        score += _plain_tree(bins, np.rint((prob - y) * B.UNIT) / B.UNIT, np.rint(prob * (1 - prob) * B.UNIT) / B.UNIT, p, 14)
    assert np.allclose(m.margin(x), score, atol=1e-6)


def test_best_round_and_loss_log(spark, sig):
    train = sig.where("split = 'train'")
    m = M.fit(train, FEATS, "gbt_cat", {"maxIter": 60, "patience": 4, "stepSize": 0.5})
    losses = m.held_loss
    assert len(m.trees) == int(np.argmin(losses)) and len(losses) - 1 <= len(m.trees) + 4 < 60
    held = train.where(prep.seeded_md5("42val", "id").substr(1, 8) < format(int(0.2 * 16 ** 8), "08x"))
    x, y = _local(held, FEATS)
    back = B.BoostedTrees.from_dict(m.as_dict())
    for r in (0, len(m.trees) // 2, len(m.trees)):
        back.trees = m.trees[:r]
        z = back.margin(x)
        assert abs(np.mean(np.logaddexp(0, z) - y * z) - losses[r]) < 1e-6


def test_folds_equal_single_fits_and_have_train_scores(spark, sig):
    folded = prep.kfold(sig.where("split = 'train'"), 3).cache()
    models = M.fit_boosted(folded, FEATS, "gbt", {"maxIter": 4}, folds=("fold", 3))
    own = B.Params(4, 3, 0.1, l2=0.0)
    for f, m in enumerate(models):
        x, y = _local(folded.where(f"fold <> {f}"), FEATS)
        bins = B.binned(x, [np.array(m.edges[c]) for c in m.features])
        row = dict(n=len(y), bins=bins.tobytes(), y=y.astype(np.uint8).tobytes(), fold=b"\xff" * len(y), held=b"\0" * len(y), score=b"")
        block, fit = B.Block([row], len(FEATS), 1), B.Fit(None, m.base, (1.0, 1.0))
        B._rounds([fit], own, lambda t: {0: block.sums(0, fit, t[0], own, 257)}, lambda at: {i: block.losses(i, fit) for i in at},
                  lambda i, t: block.add(i, fit, t, own))
        assert [t.feature for t in fit.trees] == [t.feature for t in m.trees] and [t.value for t in fit.trees] == [t.value for t in m.trees]
    got = T.cross_validate(sig.where("split = 'train'"), FEATS, "gbt", 3, params={"maxIter": 4}).toPandas()
    assert len(got) == 3 and (got.train_roc_auc >= got.roc_auc - 0.02).all() and (got.accuracy > 0.8).all()
    assert set(T.METRICS + T.TRAIN_METRICS) < set(got.columns)


def test_stumps_equal_plain_samme(spark, sig):
    train = sig.where("split = 'train'")
    m = M.fit(train, FEATS, "adaboost", {"rounds": 8, "maxBins": 16})
    x, y = _local(train, FEATS)
    bins, w = B.binned(x, [np.array(m.edges[c]) for c in m.features]), np.ones(len(y))
    for t in m.trees:
        w = w * len(y) / w.sum()
        best = None
        for j in range(len(bins)):
            for c in range(17):
                sides = [(w[k & (y == 1)].sum(), w[k].sum()) for k in (bins[j] <= c, bins[j] > c)]
                if min(s for _, s in sides) <= 0:
                    continue
                pure = sum((a ** 2 + (s - a) ** 2) / s for a, s in sides)
                if best is None or pure > best[0] + 1e-6:
                    best = pure, j, c, [1.0 if 2 * a > s else -1.0 for a, s in sides]
        _, j, c, votes = best
        miss = (np.where(bins[j] <= c, *votes) > 0) != (y > 0)
        err = w[miss].sum() / w.sum()
        alpha = math.log((1 - err) / err)
        assert (t.feature[0], t.bin[0]) == (j, c) and abs(t.value[0] - alpha) < 1e-4
        w = w * np.exp(t.value[0] * miss)


def test_degenerate_inputs(spark):
    df = spark.createDataFrame([(i, None, float(i % 3), 1) for i in range(9)], "id long, empty double, a double, label int")
    m = M.fit(df, ["empty", "a"], "gbt")
    assert m.features == ["a"] and m.trees == [] and M.score(m, df).where("prediction = 1").count() == 9
    m = M.fit(df.withColumn("label", F.when(F.col("id") > 3, 1).when(F.col("id") > 0, 0)), ["empty", "a"], "adaboost", {"rounds": 3})
    assert M.score(m, df.drop("empty")).count() == 9
    nothing = M.fit(df.limit(0), ["empty", "a"], "gbt")
    assert nothing.trees == [] and M.score(nothing, df).where("p1 = 0.5").count() == 9


def test_train_job_takes_manual_labels_and_catboost(spark, tmp_path):
    rows = [(i, float(i % 40), float(i % 7), "CONFIRMED" if i % 40 > 20 else "FALSE POSITIVE", None) for i in range(200)]
    rows += [(None, float(30 + i), 1.0, None, "PLANET" if i % 2 else "NOT_PLANET") for i in range(8)]
    up = spark.createDataFrame(rows, "id long, a double, b double, koi_disposition string, label string")
    res = T.train_job(spark, up, str(tmp_path), "koi_disposition", families=("gbt_cat", "nb"), balance="undersample",
                      params={"gbt_cat": {"maxIter": 5}}, features=["a", "b"])
    assert set(res["metrics"]) == {"gbt_cat", "nb"} and res["metrics"]["gbt_cat"]["roc_auc"] > 0.8
    assert spark.read.parquet(f"{tmp_path}/split").count() == 208
    assert io.last_runs(spark.read.parquet(f"{tmp_path}/history")).count() == 1 if hasattr(io, "last_runs") else True
