"""Exact k-NN against brute force (several blocks), LSH recall, Shapley
sum property."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvid.operators import neighbors as N
from corvid.operators import explain as X
from corvid.operators import models as M
from corvid.operators import prep
from corvid.sources import views
from tests.conftest import SF_SMALL


def test_knn_exact_blocks_match_brute_force(spark):
    rng = np.random.default_rng(5)
    X_ = rng.normal(size=(300, 3)).round(1)                  # ties in distance
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(X_)], "id long, a double, b double, c double")
    got = N.knn_exact(df, df, ["a", "b", "c"], 4, block_rows=64).collect()
    got = sorted((r["qid"], r["rank"], r["nid"]) for r in got)
    want = []
    for i in range(300):
        d = np.sqrt(((X_ - X_[i]) ** 2).sum(1))
        d[i] = np.inf
        order = np.lexsort((np.arange(300), d))[:4]
        want += [(i, r + 1, int(j)) for r, j in enumerate(order)]
    assert got == sorted(want)


def test_knn_lsh_recall(spark):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    exact = {(r["qid"], r["nid"]) for r in N.knn_exact(e, e, "embedding", 5).collect()}
    approx = {(r["qid"], r["nid"]) for r in N.knn_lsh(e, "embedding", 5, n_tables=8, n_bits=3).collect()}
    recall = len(exact & approx) / len(exact)
    assert recall > 0.3, recall        # random 64-d unit vectors: the hard case for LSH


def test_knn_lsh_does_not_depend_on_block_size(spark):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    got = [sorted((r["qid"], r["rank"], r["nid"]) for r in N.knn_lsh(e, "embedding", 5, n_tables=2, n_bits=2, block_rows=b).collect())
           for b in (2048, 100, 20)]
    assert got[0] == got[1] == got[2] and got[0]


def test_smote_needs_two_classes(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (2, 1, 2.0), (3, 2, 3.0)], "id long, label int, x double")
    with pytest.raises(ValueError):
        N.smote(df, ["x"])


def test_shapley_sums_to_score_difference(spark):
    sig = views.sig(spark, SF_SMALL)
    feats = ["period", "depth", "snr", "st_teff"]
    m = M.fit(sig, feats, "dt", {"maxDepth": 4})
    med = prep.fit_median(sig, feats)

    def score(frame):
        return M.score(m, frame, ["id", "_m"]).withColumnRenamed("p1", "_v")
    rows = prep.apply_fill(sig, med).orderBy("id").limit(20)
    phi = X.shapley(rows, feats, med, score).groupBy("id").agg(F.sum("value").alias("s"))
    fx = M.score(m, rows, ["id"]).select("id", F.col("p1").alias("fx"))
    base = spark.createDataFrame([(0, *[float(med[c]) for c in feats])], ", ".join(["id long"] + [f"{c} double" for c in feats]))
    fb = M.score(m, base, ["id"]).first()["p1"]
    bad = phi.join(fx, "id").where(F.abs(F.col("s") - (F.col("fx") - fb)) > 1e-9).count()
    assert bad == 0


def test_text_ids_in_neighbours_smote_and_votes(spark):
    rows = [(f"K{i:05d}.01", float(i), float(i % 3), int(i >= 30)) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, a double, b double, label int")
    num = df.withColumn("id", F.regexp_extract("id", r"K(\d+)", 1).cast("long"))
    for search in (lambda d: N.knn_exact(d, d, ["a", "b"], 3, block_rows=8),
                   lambda d: N.knn_lsh(d, ["a", "b"], 3, n_bits=2, block_rows=8)):
        want = {(f"K{r.qid:05d}.01", r["rank"], f"K{r.nid:05d}.01") for r in search(num).collect()}
        assert {(r.qid, r["rank"], r.nid) for r in search(df).collect()} == want
    out = N.smote(df, ["a", "b"])
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == {0: 30, 1: 30}
    assert N.knn_classify(df, df, ["a", "b"], 3).count() == 40
