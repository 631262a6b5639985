"""Exact search in tiles: the pairs and distances of brute force, with ties, copies,
large offsets; tiles that lie too far are left out; a block holds many rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvid.operators import neighbors as N


def _brute(Q, qid, C, cid, k, own):
    d = np.sqrt(((Q[:, None, :] - C[None, :, :]) ** 2).sum(axis=2))
    if own:
        d[qid[:, None] == cid[None, :]] = np.inf
    return [(i, j, d[i, j]) for i in range(len(Q)) for j in np.lexsort((cid, d[i]))[:k].tolist() if np.isfinite(d[i, j])]


@pytest.mark.parametrize("kind", ["plain", "grid", "offset", "copies", "far"])
@pytest.mark.parametrize("k", [1, 5])
def test_equals_brute_force(monkeypatch, kind, k):
    monkeypatch.setattr(N, "_Q_TILE", 16)
    monkeypatch.setattr(N, "_C_TILE", 32)
    rnd = np.random.default_rng(len(kind) + k)
    x = rnd.normal(size=(500, 7))
    x = {"plain": x, "grid": np.rint(x), "offset": x * 1e-3 + 1e6, "copies": np.repeat(x[:4], 125, axis=0), "far": x ** 9}[kind]
    ids = rnd.permutation(500)
    for own in (True, False):
        i, j, d = N._tiled_topk(x[:200], ids[:200], x, ids, k, own)
        assert sorted(zip(i.tolist(), j.tolist(), d.tolist())) == sorted(_brute(x[:200], ids[:200], x, ids, k, own))


def test_far_tiles_are_left_out(monkeypatch):
    seen = []
    cut = N._tiles
    monkeypatch.setattr(N, "_tiles", lambda x, size: [seen.append(len(t)) or t for t in cut(x, size)])
    monkeypatch.setattr(N.np, "flatnonzero", lambda x, f=np.flatnonzero: seen.append("searched") or f(x))
    x = np.repeat(np.arange(16.0) * 1e3, 256)[:, None] + np.random.default_rng(1).normal(size=(4096, 3))
    N._tiled_topk(x, np.arange(4096), x, np.arange(4096), 3, True)
    assert sum(isinstance(s, int) for s in seen) > 30 and seen.count("searched") == 64      # of 64 x 16 pairs of tiles


def test_rows_are_copied_once_per_large_block(spark):
    df = spark.range(30000).select("id", *[F.rand(i).alias(f"f{i}") for i in range(3)]).cache()
    plan = N.knn_exact(df, df, ["f0", "f1", "f2"], 3)
    counts = {(r["qid"]) for r in plan.select("qid").distinct().collect()}
    assert len(counts) == 30000
    # blocks of 2,048 rows were 15 x 15 groups and 900,000 rows to exchange
    d = df.limit(40)
    got = sorted(map(tuple, N.knn_exact(d, df, ["f0", "f1", "f2"], 3).select("qid", "nid", "dist", "rank").collect()))
    small = sorted(map(tuple, N.knn_exact(d, df, ["f0", "f1", "f2"], 3, block_rows=2048).select("qid", "nid", "dist", "rank").collect()))
    assert got == small and len(got) == 120
