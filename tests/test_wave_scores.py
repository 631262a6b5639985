"""Scores on random Fourier features: the stages' own numbers, without their expression."""

import math

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from corvid.operators import descent
from corvid.operators import models as M


def test_cosines():
    x = np.random.default_rng(1).normal(size=(300, 100)) * 7
    assert np.abs(descent.cosines(x / (2 * math.pi), 0.25) - 0.25 * np.cos(x)).max() < 1e-14


def test_scores_are_those_of_the_stages(spark, tmp_path):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, float(a) if i % 9 else None, float(b), int(a * b > 0.1)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))],
                               "id long, a double, b double, label int")
    m = M.fit(df, ["a", "b"], "svc", {"fourier": 20, "gamma": 0.7, "maxIter": 15})
    M.save(m, str(tmp_path / "m"))
    for model in (m, M.load(str(tmp_path / "m"))):
        scored = M.score(model, df)
        assert "__wave" not in scored._jdf.queryExecution().toString()      # 128 numbers a row, interpreted, before
        raw = model.transform(df).select("id", F.col("prediction").cast("int").alias("c"), vector_to_array("rawPrediction")[1].alias("m"))
        rows = scored.join(raw, "id").collect()
        assert len(rows) == 400 and all(abs(r.p1 - 1 / (1 + math.exp(-r.m))) < 1e-12 and r.prediction == r.c for r in rows)
