"""Split / fold / balancing properties and evaluation against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvid.operators import evaluate as E
from corvid.operators import prep
from corvid.sources import views
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def sig(spark):
    return views.sig(spark, SF_SMALL).cache()


def test_split_is_disjoint_complete_and_hits_quotas(spark, sig):
    sp = prep.stratified_split(sig, test_size=0.2, seed=42)
    n = sig.count()
    assert sp.count() == n and sp.select("id").distinct().count() == n
    counts = prep.class_counts_local(sig)
    quotas = prep.test_quotas(counts, 0.2)
    got = {r["label"]: r["count"] for r in sp.where("split = 'test'").groupBy("label").count().collect()}
    assert got == quotas and sum(quotas.values()) == int(np.ceil(0.2 * n))
    # deterministic
    again = prep.stratified_split(sig, test_size=0.2, seed=42)
    assert sp.join(again.withColumnRenamed("split", "s2"), "id").where("split != s2").count() == 0


def test_three_way_and_folds(spark, sig):
    tw = prep.split_three_way(sig)
    assert tw.count() == sig.count()
    assert {r[0] for r in tw.select("split").distinct().collect()} == {"train", "val", "test"}
    f = prep.kfold(sig, 5)
    sizes = sorted(r["count"] for r in f.groupBy("fold").count().collect())
    assert sizes[-1] - sizes[0] <= 2


def test_under_over_sample(spark):
    imb = views.imb(spark, SF_SMALL)
    counts = prep.class_counts_local(imb)
    u = prep.class_counts_local(prep.undersample(imb))
    assert set(u.values()) == {min(counts.values())}
    o = prep.oversample(imb)
    oc = {r["label"]: r["count"] for r in o.groupBy("label").count().collect()}
    assert set(oc.values()) == {max(counts.values())}
    assert o.select("draw", "label").distinct().count() == o.count()


def test_smote_points_between_parents_and_classes_equal(spark):
    from corvid.operators.neighbors import smote
    imb = views.imb(spark, SF_SMALL)
    feats = views.IMB_FEATURES
    syn = smote(imb, feats, return_synthetic_only=True)
    j = (syn.join(imb.select(F.col("id").alias("base_id"), *[F.col(c).alias(f"b_{c}") for c in feats]), "base_id")
         .join(imb.select(F.col("id").alias("nbr_id"), *[F.col(c).alias(f"n_{c}") for c in feats]), "nbr_id"))
    for c in feats:
        lo = F.least(f"b_{c}", f"n_{c}") - 1e-9
        hi = F.greatest(f"b_{c}", f"n_{c}") + 1e-9
        assert j.where((F.col(c) < lo) | (F.col(c) > hi)).count() == 0
    full = smote(imb, feats)
    cc = {r["label"]: r["count"] for r in full.groupBy("label").count().collect()}
    assert len(set(cc.values())) == 1


def _auc_brute(y, s):
    pos = [a for a, b in zip(s, y) if b == 1]
    neg = [a for a, b in zip(s, y) if b == 0]
    tot = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_and_roc_against_brute_force(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 600).tolist()
    s = (rng.integers(0, 40, 600) / 40.0).tolist()          # many ties
    df = spark.createDataFrame(list(zip(range(600), y, s)), "id long, label int, score double")
    auc = E.roc_auc(df).first()["auc"]
    assert auc == pytest.approx(round(_auc_brute(y, s), 4), abs=1e-4)
    rev = E.roc_auc(df.withColumn("score", 1 - F.col("score"))).first()["auc"]
    assert auc + rev == pytest.approx(1.0, abs=2e-4)
    # ROC: compare with a direct NumPy construction of the same curve
    order = np.argsort(-np.array(s), kind="mergesort")
    ys, ss = np.array(y)[order], np.array(s)[order]
    idx = np.where(np.diff(ss))[0]
    idx = np.r_[idx, len(ys) - 1]
    tps = np.cumsum(ys)[idx]
    fps = 1 + idx - tps
    keep = np.where(np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True])[0]
    want = sorted(zip(np.round(fps[keep] / fps[-1], 4), np.round(tps[keep] / tps[-1], 4)))
    got = sorted((r["fpr"], r["tpr"]) for r in E.roc_points(df).collect() if r["threshold"] is not None)
    assert got == [(float(a), float(b)) for a, b in want]
    # one class only: no curve, null AUC
    one = df.withColumn("label", F.lit(1))
    assert E.roc_points(one).count() == 0 and E.roc_auc(one).first()["auc"] is None


def test_running_sums_small_buckets(spark):
    df = spark.createDataFrame([(float(i % 97), 1) for i in range(2000)], "s double, one int").groupBy("s").count()
    r = E.running_sums(df, "s", ["count"], n_buckets=8).orderBy("s").collect()
    cum = np.cumsum([x["count"] for x in r])
    assert [x["count_cum"] for x in r] == cum.tolist()
    assert [x["_idx"] for x in r] == list(range(1, len(r) + 1))


def test_metrics_zero_division(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (0, 0, 0.2)], "label int, pred int, score double")
    m = E.binary_metrics(df).first()
    assert m["precision"] == 0.0 and m["recall"] == 0.0 and m["f1"] == 0.0 and m["roc_auc"] is None


def test_smote_lsh_keeps_all_draws(spark):
    from corvid.operators.neighbors import smote
    imb = views.imb(spark, SF_SMALL)
    a = smote(imb, views.IMB_FEATURES, return_synthetic_only=True)
    b = smote(imb, views.IMB_FEATURES, return_synthetic_only=True, neighbours="lsh")
    assert a.count() == b.count() > 0
