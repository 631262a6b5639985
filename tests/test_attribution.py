"""Closed-form attribution against the enumeration of coalitions, and its sum."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvid.operators import attribution as A
from corvid.operators import explain as X
from corvid.operators import models as M
from corvid.operators import prep
from corvid.sources import views
from tests.conftest import SF_SMALL

FEATS = views.OBS_FEATURES


@pytest.fixture(scope="module")
def sig(spark):
    return views.sig(spark, SF_SMALL).cache()


@pytest.mark.parametrize("family,params", [("gbt", {"maxIter": 8}), ("adaboost", {"rounds": 6}), ("dt", {"maxDepth": 5}),
                                           ("rf", {"numTrees": 3, "maxDepth": 4}), ("logreg", {"maxIter": 20})])
def test_equals_enumeration(spark, sig, family, params):
    m = M.fit(sig, FEATS, family, params)
    med = prep.fit_median(sig, FEATS)
    few = prep.apply_fill(sig.orderBy("id").limit(25), med)

    def score(frame):
        if hasattr(m, "margin_column"):
            return frame.withColumn("_v", m.margin_column())
        out = M.score(m, frame, ["id", "_m"])
        return out.withColumn("_v", F.log(F.col("p1") / (1 - F.col("p1"))) if family == "logreg" else F.col("p1"))
    want = {(r["id"], r["feature"]): r["value"] for r in X.shapley(few, FEATS, med, score).collect()}
    got = {(r["id"], r["feature"]): r["value"] for r in A.attributions(m, few, med).collect()}
    assert want.keys() == got.keys() and len(got) == 25 * len(FEATS)
    assert max(abs(want[k] - got[k]) for k in want) < 1e-6 and any(abs(v) > 1e-3 for v in got.values())


def test_sum_with_twenty_features_and_missing_values(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(300, 20))
    y = (x[:, 0] * x[:, 1] + x[:, 7] > 0).astype(int)
    names = [f"f{i}" for i in range(20)]
    rows = [(str(i), *[None if (i + j) % 17 == 0 else float(v) for j, v in enumerate(r)], int(c)) for i, (r, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id string, " + ", ".join(f"{n} double" for n in names) + ", label int")
    m = M.fit(df, names, "gbt_xgb", {"maxIter": 12})
    base = {n: (None if n == "f3" else 0.1) for n in names}
    at = float(m.margin([np.array([np.nan if base[n] is None else base[n]]) for n in m.features])[0])
    total = A.attributions(m, df, base).groupBy("id").agg(F.sum("value").alias("t"), F.count("value").alias("n"))
    r = df.select("id", m.margin_column().alias("v")).join(total, "id").collect()
    assert len(r) == 300 and all(x["n"] == 20 and abs(x["v"] - at - x["t"]) < 1e-9 for x in r)
    assert A.attributions(m, df.limit(0), base).count() == 0


def test_models_without_a_closed_form(spark, sig):
    nb = M.fit(sig, FEATS, "nb")
    assert not A.supported(nb)
    with pytest.raises(ValueError):
        A.attributions(nb, sig, {})
