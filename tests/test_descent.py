"""SVC and MLP in one barrier stage: the results of ``pyspark.ml``, without a job for
each iteration, with waves kept or made anew."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvid.operators import boosting, descent
from corvid.operators import models as M


def _rows(spark, n=2600):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] * x[:, 2] + 0.4 * rng.normal(size=n) > 0.3).astype(int)
    rows = [(i, float(a), None if i % 53 == 0 else float(b), float(c), int(k)) for i, ((a, b, c), k) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, label int")


def _p1(model, df):
    return np.array([r.p1 for r in M.score(model, df, ["id"]).orderBy("id").collect()])


CASES = {"line": ("svc", {"fourier": None}), "waves": ("svc", {"fourier": 16, "maxIter": 40}),
         "unweighted": ("svc", {"fourier": None, "balanced": False, "scale": False}), "network": ("mlp", {"hidden": [6, 4], "maxIter": 30})}


@pytest.mark.parametrize("case", CASES)
def test_same_result_as_the_estimator_in_few_jobs(spark, monkeypatch, case):
    family, params = CASES[case]
    df = _rows(spark).coalesce(1).cache()
    spark.sparkContext.setJobGroup(f"descent-{case}", "")
    model = M.fit(df, ["a", "b", "c"], family, params)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"descent-{case}"))
    spark.sparkContext.setJobGroup("rest", "")
    assert jobs < 25                                       # one or more for each iteration before
    monkeypatch.setattr(boosting, "_slots", lambda s: 0)
    plain = M.fit(df, ["a", "b", "c"], family, params)
    assert np.abs(_p1(model, df) - _p1(plain, df)).max() < 1e-6


@pytest.mark.parametrize("family,params", [("svc", {"fourier": 16, "maxIter": 20}), ("mlp", {"hidden": [4], "maxIter": 20})])
def test_many_tasks_and_no_room_for_waves(spark, monkeypatch, tmp_path, family, params):
    df = _rows(spark).repartition(3).cache()
    monkeypatch.setattr(M, "MIN_ROWS_PER_TASK", 500)
    monkeypatch.setattr(descent, "KEEP", 0)
    many = M.fit(df, ["a", "b", "c"], family, params)
    monkeypatch.setattr(boosting, "_slots", lambda s: 0)
    assert np.abs(_p1(M.fit(df, ["a", "b", "c"], family, params), df) - _p1(many, df)).max() < 1e-6
    M.save(many, str(tmp_path / family))
    assert (_p1(M.load(str(tmp_path / family)), df) == _p1(many, df)).all()


def test_one_class_and_wrong_labels(spark):
    df = _rows(spark, 300)
    one = M.fit(df.where(F.col("label") == 1), ["a", "b", "c"], "svc", {"fourier": None})
    assert {r.prediction for r in M.score(one, df, ["id"]).collect()} == {1}
    with pytest.raises(Exception):  # noqa: B017 - the estimator's own error
        M.fit(df.withColumn("label", F.col("label") * 3), ["a", "b", "c"], "svc", {"fourier": None})
