"""Rule ensemble on held-out labels; hash-prefix forest against brute force."""

import re
import zlib

import numpy as np
import pytest

from corvid.llm import hash_forest, queries, rule_ensemble

MID = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    out = queries.QUERIES["op4_rule_ensemble"](spark, MID)
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().toString())
    got = out.join(spark.read.parquet(f"{MID}/labels.parquet"), "doc_id", "left").toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    held = got[got.held_out & got.quality.notna()]
    assert len(held) > 50
    assert held[held.quality == 1].predicted.mean() > 0.97
    assert held[held.quality == 0].predicted.mean() < 0.15


def _docs(spark):
    rows = [(i, ("clean words of a text " if i % 2 else "$$$ ### *** ") * (3 + i % 5), "s", 1) for i in range(60)]
    rows += [(100, None, "s", 1), (101, "", "s", 1), (None, "x", "s", 1), (7, "clean words", "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, predicted int")


def test_quality_edges(spark):
    docs = _docs(spark)
    labels = spark.createDataFrame([(i, i % 2, "t") for i in range(60)] + [(3, 1, "t"), (None, 1, "t"), (5, None, "t"), (999, 0, "t")],
                                   "doc_id long, quality int, text string")
    model = rule_ensemble.fit(docs, labels)
    assert model.rules and len(model.rules) < 40
    got = rule_ensemble.score(docs, model)
    assert got.count() == 64 and set(got.columns) == set(docs.columns)
    r = {x.doc_id: x for x in got.collect()}
    assert r[2].predicted == 0 and r[9].predicted == 1 and r[100].score == r[101].score
    assert rule_ensemble.held_out_scores(docs, labels).filter("doc_id IS NULL AND NOT held_out").count() == 1
    assert rule_ensemble.score(docs.limit(0), model).count() == 0
    for few in (labels.limit(0), labels.filter("quality = 1")):
        flat = rule_ensemble.score(docs, rule_ensemble.fit(docs, few))
        assert flat.select("score").distinct().count() == 1


def test_query_recall(spark):
    got = queries.QUERIES["op5_hash_forest"](spark, MID).toPandas()
    assert _recall(got, spark.read.parquet(f"{MID}/embeddings.parquet").toPandas()) >= 0.95


def _recall(got, table, k=20):
    ids, v = table.vec_id.to_numpy(), np.stack(table.embedding.to_numpy()).astype(float)
    hits = total = 0
    for q, mine in got.groupby("query_id"):
        s = v @ v[ids == q][0]
        s[ids == q] = -np.inf
        best = np.lexsort((ids, -s))[:k]
        mine = mine.sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, min(k, len(ids) - 1) + 1))
        assert np.allclose(mine.score, s[[int(np.nonzero(ids == x)[0][0]) for x in mine.vec_id]], atol=1e-12)
        assert (np.diff(mine.score) <= 1e-15).all()
        hits += len(set(mine.vec_id) & set(ids[best]))
        total += len(best)
    assert set(got.query_id) == {i for i in ids if i % 20 == 0}
    return hits / total


def test_recall_over_isotropic_vectors(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((12_000, 32)).astype("float32") * rng.uniform(0.5, 1.5, (12_000, 1)).astype("float32")
    import pandas as pd
    pdf = pd.DataFrame({"vec_id": np.arange(12_000), "embedding": list(v)})
    df = spark.createDataFrame(pd.DataFrame({"vec_id": pdf.vec_id, "embedding": [x.tolist() for x in v]}),
                               "vec_id long, embedding array<float>")
    got = hash_forest.neighbours(df, every=200).toPandas()
    pdf = pdf.copy()
    ids = pdf.vec_id.to_numpy()
    hits = 0
    for q, mine in got.groupby("query_id"):
        s = v.astype(float) @ v[q].astype(float)
        s[q] = -np.inf
        hits += len(set(mine.vec_id) & set(ids[np.lexsort((ids, -s))[:20]]))
    assert hits / len(got) >= 0.9 and len(got) == 60 * 20


def test_forest_edges(spark):
    rows = [(0, [1.0, 0.0], "a"), (20, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (2, [0.0, 0.0], "a"), (3, None, "a"),
            (40, [float("nan"), 1.0], "a"), (5, [None, 1.0], "a"), (6, [0.5, 0.5], "a"), (7, [float("inf"), 1.0], "a"),
            (8, [1.0], "a"), (None, [1.0, 1.0], "a"), (6, [0.5, 0.5], "a"), (60, [-1.0, 0.0], "a"), (9, [-0.0, 2.0], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string")
    got = {}
    for r in hash_forest.neighbours(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {0: [(1, 1.0), (20, 1.0), (6, 0.5), (9, 0.0), (60, -1.0)],
                   20: [(0, 1.0), (1, 1.0), (6, 0.5), (9, 0.0), (60, -1.0)],
                   60: [(9, 0.0), (6, -0.5), (0, -1.0), (1, -1.0), (20, -1.0)]}
    assert hash_forest.neighbours(df.limit(0)).count() == 0
    assert hash_forest.neighbours(df.filter("vec_id = 0")).count() == 0


def test_forest_lengths_and_repeated_ids(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [1.0, 0.0]), (1, [2.0, 3.0]), (40, [1.0, 1.0, 1.0]), (2, [0.0, 0.0, 2.0]),
            (20, [0.0, 0.0, 5.0]), (60, [7.0])]
    got = hash_forest.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [
        (20, 1, 1, 2.0), (20, 1, 1, 3.0), (20, 1, 2, 10.0), (20, 2, 20, 0.0), (20, 2, 20, 0.0), (20, 2, 40, 5.0),
        (40, 1, 20, 5.0), (40, 2, 2, 2.0)]


def test_work_on_clustered_vectors(spark):
    """The share of rows compared falls as rows grow: the cost is a number of rows."""
    rng = np.random.default_rng(3)
    compared = {}
    for n in (4_000, 16_000, 64_000):
        # 80 rows a cluster
        v = rng.standard_normal((n // 80, 48))[np.arange(n) % (n // 80)] + 0.1 * rng.standard_normal((n, 48))
        df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
        report = []
        rows = hash_forest.clean(df)
        got = hash_forest.search(rows, rows.filter(f"vec_id % {n // 100} = 0"), report=report).toPandas()
        hits = sum(len(set(mine.vec_id) & set(np.argsort(-np.where(np.arange(n) == q, -np.inf, v @ v[q]))[:20]))
                   for q, mine in got.groupby("query_id"))
        print(n, hits / len(got), report)
        assert len(got) == 100 * 20 and hits / len(got) >= 0.93 and report[0]["root"] == 0
        compared[n] = report[0]["compared"]
    assert compared[64_000] < 0.1 * 64_000 and compared[64_000] < 4 * compared[4_000]


@pytest.mark.parametrize("block", [50, 8192])
def test_copies_blocks_and_root_visits(spark, block):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((300, 8))
    rows = [(i, base[i % 300 if i < 600 else 0].tolist()) for i in range(1500)]      # one vector holds most rows
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = hash_forest.neighbours(df, block=block, least=4, most=32).toPandas()
    v = np.array([r[1] for r in rows])
    hits = 0
    for q, mine in got.groupby("query_id"):
        s = v @ v[q]
        s[q] = -np.inf
        hits += len(set(mine.vec_id) & set(np.lexsort((np.arange(1500), -np.round(s, 9)))[:20]))
    assert len(got) == 75 * 20 and hits / len(got) > 0.9


def _hard_vectors(kind, dim, n=8_000):
    rng = np.random.default_rng(dim)
    v = rng.standard_normal((n, dim))
    if kind == "mean":
        v += 2 * rng.standard_normal(dim)
    if kind == "clusters":
        v = 2 * rng.standard_normal((40, dim))[rng.integers(0, 40, n)] + 0.5 * v
    v /= np.linalg.norm(v, axis=1)[:, None]
    if kind == "skewed":
        v *= rng.lognormal(0, 1.5, (n, 1))
    if kind == "outliers":
        v[rng.permutation(n)[:n // 100]] *= 5
        v[7] *= 1000
    return v


@pytest.mark.parametrize("kind,dim", [("unit", 384), ("skewed", 64), ("skewed", 384), ("outliers", 64), ("mean", 64),
                                      ("mean", 384), ("clusters", 64)])
def test_recall_whatever_the_dimension_and_norms(spark, kind, dim):
    v = _hard_vectors(kind, dim)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    got = hash_forest.neighbours(df, every=50).toPandas()
    each = []
    for q, mine in got.groupby("query_id"):
        s = v @ v[q]
        s[q] = -np.inf
        each.append(len(set(mine.vec_id) & set(np.argsort(-s)[:20])) / 20)
    print("recall", kind, dim, np.mean(each), np.min(each))
    assert len(each) == 160 and np.mean(each) >= 0.92 and np.quantile(each, 0.05) >= 0.6
