"""Which families and rounds the training keys fit, and k-NN as a family of the plans."""

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as E
from corvid.keys import k_models
from corvid.operators import models as M
from corvid.operators import prep
from corvid.plans import train as T
from corvid.sources import views
from tests.conftest import SF_SMALL

REFERENCE = {"logreg", "rf", "gbt_xgb", "gbt_cat", "gbt_hist", "gbt", "svc", "knn", "dt", "adaboost", "nb"}


def test_keys_fit_all_families_of_the_reference(spark, monkeypatch):
    asked = []

    class Stop(Exception):
        pass

    def fit(train, features, family, params=None, *rest):
        asked.append((family, {**M.PRESETS[family], **(params or {})}))
        raise Stop

    def boosted(df, features, family, p, *rest, **kw):
        asked.append((family, {"maxIter": p.rounds}))
        raise Stop

    assert set(k_models.COMPARE_FAMILIES) == REFERENCE
    keys = E.queries()
    assert {f"cross_validate_{f}" for f in REFERENCE - {"logreg"}} | {"cross_validate"} <= set(keys)
    monkeypatch.setattr(M, "fit", fit)
    monkeypatch.setattr(M.boosting, "fit", boosted)
    for name in ("boosting_log", *(f"cross_validate_{f}" for f in ("rf", "gbt_cat"))):
        try:
            keys[name](spark, SF_SMALL)
        except Stop:
            pass
    assert [a[0] for a in asked] == ["gbt", "rf", "gbt_cat"]
    assert asked[0][1]["maxIter"] == 200 and asked[2][1]["maxIter"] == 100

    monkeypatch.setattr(T, "train_per_source", lambda *a, **kw: (a, kw))
    args, kw = keys["train_per_source"](spark, SF_SMALL)
    assert set(args[3]) == {"rf", "gbt_xgb"}
    assert kw["params"]["rf"]["numTrees"] == 200 and kw["params"]["gbt_xgb"]["maxIter"] == 200


def test_comparison_and_sources_with_several_families(spark):
    sp = prep.stratified_split(views.sig(spark, SF_SMALL), test_size=0.2, seed=42).cache()
    train, test = sp.where(F.col("split") == "train"), sp.where(F.col("split") == "test")
    got = T.compare_models(train, test, k_models.FEATS, ["knn", "nb", "gbt_hist"], {"gbt_hist": {"maxIter": 2}}).toPandas()
    assert list(got.Model) == ["K-Nearest Neighbors", "Naive Bayes", "HistGradientBoosting"]
    assert (got.Approx_FLOPS > 0).all() and (got.n_test == test.count()).all()

    x = {s: (d.select("label", *k_models.FEATS).toPandas()) for s, d in (("train", train), ("test", test))}
    med = x["train"][k_models.FEATS].astype(float).median()
    a, b = (x[s][k_models.FEATS].astype(float).fillna(med) for s in ("train", "test"))
    mu, sd = a.mean(), a.std(ddof=0).replace(0, 1)
    a, b = ((a - mu) / sd).to_numpy(), ((b - mu) / sd).to_numpy()
    near = np.argsort(((b[:, None] - a[None]) ** 2).sum(axis=2), axis=1, kind="stable")[:, :5]
    predicted = x["train"].label.to_numpy()[near].mean(axis=1) > 0.5
    assert abs((predicted == x["test"].label.to_numpy()).mean() - got.Test_accuracy[0]) < 0.01

    both = sp.drop("split").withColumn("source", F.when(F.col("id") % 3 == 0, "a").otherwise("b"))
    per = T.train_per_source(both, "source", k_models.FEATS, ["dt", "nb"]).toPandas()
    assert sorted(zip(per.source, per.model)) == [(s, m) for s in ("ALL", "a", "b") for m in ("Decision Tree", "Naive Bayes")]
    assert per.accuracy.notna().all()
