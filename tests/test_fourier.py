"""Random Fourier features before the margin classifier."""

import numpy as np
from pyspark.sql import functions as F

from corvid.operators import attribution
from corvid.operators import models as M


def _ring(spark, n=3000):
    """Label 1 inside a circle: no line separates it."""
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, (n, 2))
    rows = [(i, float(a), None if i % 97 == 0 else float(b), int(a * a + b * b < 0.6)) for i, (a, b) in enumerate(x)]
    return spark.createDataFrame(rows, "id long, a double, b double, label int")


def _auc(model, df):
    got = M.score(model, df, ["id", "label"]).toPandas()
    one, zero = got.p1[got.label == 1].to_numpy(), got.p1[got.label == 0].to_numpy()
    return (one[:, None] > zero[None, :]).mean() + (one[:, None] == zero[None, :]).mean() / 2


def test_kernel_margin_on_a_ring(spark, tmp_path):
    df = _ring(spark).cache()
    train, test = df.where(F.col("id") % 4 != 0), df.where(F.col("id") % 4 == 0)
    line = M.fit(train, ["a", "b"], "svc", {"fourier": None})
    curve = M.fit(train, ["a", "b"], "svc")
    assert _auc(line, test) < 0.65 and _auc(curve, test) > 0.95
    assert M.feature_names(curve) == ["a", "b"]
    assert M.importances(curve) == [("a", 0.0), ("b", 0.0)] and all(v > 0 for _, v in M.importances(line))
    assert attribution.supported(line) and not attribution.supported(curve)
    M.save(curve, str(tmp_path / "svc"))
    assert _auc(M.load(str(tmp_path / "svc")), test) == _auc(curve, test)


def test_waves_approach_the_kernel(spark):
    x = np.array([[0.0, 0.0], [0.3, -0.2], [1.0, 1.5], [-2.0, 0.5]])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id int, a double, b double")
    maps = []
    for _ in range(2):
        mapped = df
        for stage in M.fourier_stages(["a", "b"], 512, gamma=0.5):
            mapped = stage.transform(mapped)
        maps.append(np.array([r.features.toArray() for r in mapped.orderBy("id").collect()]))
    assert (maps[0] == maps[1]).all()
    kernel = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(maps[0] @ maps[0].T - kernel).max() < 0.15
