"""SMOTE where fewer points are wanted than the smaller class has rows."""

import numpy as np
from pyspark.sql import functions as F

from corvid.operators import neighbors as N


def test_fewer_points_than_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 2))
    df = spark.createDataFrame([(i, float(a), float(b), int(i >= 40)) for i, (a, b) in enumerate(x)], "id long, a double, b double, label int")
    out = N.smote(df, ["a", "b"]).cache()            # ten points for forty rows: sequences ran backwards
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == {0: 50, 1: 50}
    new = N.smote(df, ["a", "b"], return_synthetic_only=True).orderBy("draw").collect()
    assert [r["draw"] for r in new] == list(range(1, 11))
    near = {(r["qid"], r["nid"]) for r in N.knn_exact(df.where("label = 0"), df.where("label = 0"), ["a", "b"], 5).collect()}
    for r in new:
        p, q, got = x[r["base_id"]], x[r["nbr_id"]], np.array([r["a"], r["b"]])
        assert (r["base_id"], r["nbr_id"]) in near
        u = (got - p) @ (q - p) / ((q - p) @ (q - p))
        assert -1e-9 <= u <= 1 + 1e-9 and np.allclose(p + u * (q - p), got)


def test_neighbours_are_found_for_drawn_rows_only(spark, monkeypatch):
    df = spark.range(400).select("id", F.rand(1).alias("a"), F.rand(2).alias("b"), (F.col("id") >= 195).cast("int").alias("label")).cache()
    asked = []
    search = N.knn_exact
    monkeypatch.setattr(N, "knn_exact", lambda q, *a: asked.append(q.count()) or search(q, *a))
    assert N.smote(df, ["a", "b"], return_synthetic_only=True).count() == 10
    assert asked and asked[0] <= 10
