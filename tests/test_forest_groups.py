"""Subtrees grown in groups of nodes: the same trees whatever the groups, from sorted rows
or from counts in all bins; rows are scored once for all metrics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvid.operators import forest as R
from corvid.plans import train as T


def _nodes(tree, at=0):
    """Pre-order."""
    out = [(int(tree["feature"][at]), int(tree["cut"][at]), float(tree["value"][at]))]
    if tree["feature"][at] < 0:
        return out
    return out + _nodes(tree, tree["down"][at]) + _nodes(tree, tree["down"][at] + 1)


@pytest.mark.parametrize("subset", ["auto", "all"])
def test_sorted_rows_and_counts_give_the_same_tree(monkeypatch, subset):
    rng = np.random.default_rng(8)
    bins, y = rng.integers(0, 12, (3000, 5)).astype(np.uint8), rng.integers(0, 2, 3000).astype(np.uint8)
    w, p = rng.integers(1, 5, 3000).astype(np.uint8), R.Params(9, 12, min_rows=2, subset=subset)
    found = []
    for few, group in ((0, 1 << 16), (1 << 20, 1 << 16), (32, 1 << 16), (32, 100), (0, 1)):
        monkeypatch.setattr(R, "FEW_ROWS", few)
        monkeypatch.setattr(R, "GROUP", group)
        monkeypatch.setattr(R, "CHUNK", 1 << 14 if group > 100 else 64)
        tree, gains = R.grown(bins, y, w, 4, 1, 12, 13, (1.0, 1.3), p)
        found.append((_nodes(tree), gains))
        leaf = R.walked(tree["feature"], tree["cut"], tree["down"], bins)
        assert (tree["feature"][leaf] < 0).all()
        share = np.bincount(leaf, w * y * 1.3) / np.maximum(np.bincount(leaf, w * np.where(y, 1.3, 1.0)), 1e-300)
        assert np.allclose(share[leaf], tree["value"][leaf])
    assert len(found[0][0]) > 300
    for nodes, gains in found[1:]:
        assert nodes == found[0][0] and np.allclose(gains, found[0][1])


def test_rows_are_scored_once_for_all_metrics(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def noted(x):
        seen.add(1)
        return x

    rows = spark.range(500).select((F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 3 > 0).cast("int").alias("prediction"),
                                   noted.asNondeterministic()(F.col("id") / 500).alias("p1"))
    met = T._metrics(rows)
    assert seen.value == 500 and met["accuracy"] == round(sum(i % 2 == (i % 3 > 0) for i in range(500)) / 500, 4)


def test_small_tables_are_scored_by_all_tasks(spark):
    df = spark.range(900).select("id", F.rand(1).alias("a"), (F.col("id") % 3 > 0).cast("int").alias("label")).coalesce(1)
    assert T._spread(df, 900).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert T._spread(df, 9_000_000).rdd.getNumPartitions() == 18
