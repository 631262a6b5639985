"""Correlations from per-task co-moments against NumPy on pairwise complete rows."""

import math

import numpy as np

from corvid.operators import profile as P


def _plain(x, y):
    ok = [(a, b) for a, b in zip(x, y) if a is not None and b is not None and math.isfinite(a) and math.isfinite(b)]
    if len({a for a, _ in ok}) < 2 or len({b for _, b in ok}) < 2:
        return None
    return float(np.corrcoef(np.array(ok).T)[0, 1])


def test_pairs_equal_numpy(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(1e6, 1.0, 500)                     # far from zero: sums of squares alone would lose it
    cols = {"a": a.tolist(), "b": (a * 2 + rng.normal(size=500)).tolist(), "const": [0.1] * 500,
            "x y": [None if i % 3 else float(i) for i in range(500)], "none": [None] * 500,
            "odd": [float("nan") if i % 5 == 0 else float("inf") if i % 7 == 0 else float(i * i) for i in range(500)]}
    names = list(cols)
    df = spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"`{c}` double" for c in names)).repartition(7)
    got = {(r.feature_a, r.feature_b): r["corr"] for r in P.corr_matrix(df, names).collect()}
    assert len(got) == 15
    for (x, y), r in got.items():
        want = _plain(cols[x], cols[y])
        assert (r is None) == (want is None) and (r is None or abs(r - want) < 6e-5), (x, y, r, want)


def test_empty_table_and_many_columns(spark):
    df = spark.range(300).selectExpr(*[f"sin(id * {i + 1}) AS c{i}" for i in range(200)])
    assert {r["corr"] for r in P.corr_matrix(df.limit(0), ["c0", "c1", "c2"]).collect()} == {None}
    rows = P.corr_matrix(df, df.columns).collect()
    assert len(rows) == 19_900 and all(-1 <= r["corr"] <= 1 for r in rows)
