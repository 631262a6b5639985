"""Exact search by cells: the rows of the search by blocks, with copies, ties, text ids and few
candidates per cell; rows are not copied to all blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvid.operators import neighbors as N


def _rows(spark, x, text=False):
    ids = (lambda i: f"r{i % 7}{i}") if text else (lambda i: (i * 7919) % 100003)
    return spark.createDataFrame([(ids(i), *map(float, r)) for i, r in enumerate(x)],
                                 ("id string, " if text else "id long, ") + ", ".join(f"f{j} double" for j in range(x.shape[1])))


def _found(df):
    return sorted((r.qid, r["rank"], r.nid, r.dist) for r in df.collect())


@pytest.mark.parametrize("kind", ["plain", "copies", "grid", "text"])
@pytest.mark.parametrize("own", [True, False])
def test_same_rows_as_by_blocks(spark, monkeypatch, kind, own):
    rng = np.random.default_rng(len(kind))
    x = rng.normal(size=(700, 3))
    x = {"copies": np.repeat(x[:3], [500, 199, 1], axis=0), "grid": np.rint(x)}.get(kind, x)
    c, q = _rows(spark, x, kind == "text"), _rows(spark, x[::2] + (0.0 if own else 0.3), kind == "text")
    feats = ["f0", "f1", "f2"]
    want = _found(N.knn_exact(q, c, feats, 4, exclude_self=own))
    for name, value in (("CELL_ROWS", 40), ("CELL_SAMPLE", 300), ("CELL_QUERIES", 150)):
        monkeypatch.setattr(N, name, value)
    used = []
    by_cells = N._by_cells
    monkeypatch.setattr(N, "_by_cells", lambda *a: used.append(1) or by_cells(*a))
    assert _found(N.knn_exact(q, c, feats, 4, exclude_self=own)) == want and used
    assert len(want) == 350 * 4


def test_rows_go_to_few_cells(spark, monkeypatch):
    df = spark.range(20000).select("id", *[F.rand(i).alias(f"f{i}") for i in range(3)]).cache()
    monkeypatch.setattr(N, "CELL_ROWS", 1 << 9)
    reached, go = spark.sparkContext.accumulator(0), N._reached

    def counted(*a):
        out = go(*a)
        reached.add(len(out[0]))
        return out
    monkeypatch.setattr(N, "_reached", counted)
    assert N.knn_exact(df, df, ["f0", "f1", "f2"], 3).count() == 60000
    assert 20000 <= reached.value < 3 * 20000            # of 64 cells each


def test_odd_numbers_and_wide_rows_are_searched_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL_ROWS", 10)
    monkeypatch.setattr(N, "_by_cells", lambda *a: 1 / 0)
    x = np.random.default_rng(0).normal(size=(60, 2))
    df = _rows(spark, x).withColumn("f1", F.when(F.col("id") != 0, F.col("f1")))
    assert N.knn_exact(df, df, ["f0", "f1"], 2).count() == 59 * 2
    wide = _rows(spark, np.random.default_rng(0).normal(size=(60, 13)))
    assert N.knn_exact(wide, wide, [f"f{j}" for j in range(13)], 2).count() == 120
