"""Exact attribution in polynomial time (K5): Shapley values against a baseline
row for boosted trees, trees, forests and linear models of any number of features.

A coalition takes some features from the row x and the others from the baseline z.
A leaf of a tree is reached by a coalition exactly when each feature on its path
lies in the leaf's interval.  Let A be the path features that only x's value brings
there (a of them) and B those that only z's value does (b).  Features that both
bring there do not matter, and where neither does, no coalition comes to the leaf.
A coalition reaches it if it holds all of A and none of B, so a leaf of value v gives

    + v (a-1)! b! / (a+b)!   to each feature of A,
    - v a! (b-1)! / (a+b)!   to each feature of B.

Summed over all leaves this is the Shapley value; the work per row is leaves times
path length, with no coalitions.  A linear score gives coefficient times (x - z).
Rows are explained in Arrow batches beside their data, without a shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (DecisionTreeClassificationModel, LinearSVCModel, LogisticRegressionModel,
                                       RandomForestClassificationModel)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.operators.boosting import BoostedTrees, binned
from corvid.operators.forest import Forest, stored
from corvid.session import scratch_dir

#: A leaf: (value, path) with a path of {feature: (low, high)}: low < x <= high leads on.
Leaf = tuple[float, dict[int, tuple[float, float]]]


def leaves(feature: list[int], cut: list[float], left: list[int], right: list[int], value: list[float]) -> list[Leaf]:
    out, todo = [], [(0, {})]
    while todo:
        node, path = todo.pop()
        f = feature[node]
        if f < 0:
            out.append((value[node], path))
            continue
        low, high = path.get(f, (-np.inf, np.inf))
        todo.append((left[node], {**path, f: (low, min(high, cut[node]))}))
        todo.append((right[node], {**path, f: (max(low, cut[node]), high)}))
    return out


def weights(depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(a-1)! b! / (a+b)! and a! (b-1)! / (a+b)! for all a, b up to ``depth``."""
    gain, loss = np.zeros((depth + 1, depth + 1)), np.zeros((depth + 1, depth + 1))
    for a in range(depth + 1):
        for b in range(depth + 1):
            if a:
                gain[a, b] = factorial(a - 1) * factorial(b) / factorial(a + b)
            if b:
                loss[a, b] = factorial(a) * factorial(b - 1) / factorial(a + b)
    return gain, loss


def attribute(found: list[Leaf], x: np.ndarray, z: np.ndarray, phi: np.ndarray) -> None:
    """Adds to ``phi`` (features, rows) what the leaves give rows ``x`` against ``z``."""
    gain, loss = weights(max((len(p) for _, p in found), default=0))
    for value, path in found:
        if not value or not path:
            continue
        names = list(path)
        low, high = np.array([path[f] for f in names]).T
        from_z = (z[names] > low) & (z[names] <= high)
        rows = np.arange(x.shape[1])
        for f, lo, hi, both in zip(names, low, high, from_z):
            if not both:                       # only x's own value can lead on here
                rows = rows[(x[f, rows] > lo) & (x[f, rows] <= hi)]
        if not len(rows):
            continue
        some = x[np.ix_(names, rows)]
        from_x = (some > low[:, None]) & (some <= high[:, None])
        a = int((~from_z).sum())               # all of these hold for the rows that are left
        b = (~from_x[from_z]).sum(axis=0)
        plus, minus = value * gain[a, b], value * loss[a, b]
        for f, both, mine in zip(names, from_z, from_x):
            if not both:
                phi[f, rows] += plus
            else:
                phi[f, rows[~mine]] -= minus[~mine]


def _stored_trees(model) -> list[list[Leaf]]:
    """The trees of a fitted tree or forest, read back from its own stored form;
    leaf values are shares of class 1, in a forest divided by its trees."""
    spark = SparkSession.active()
    path = scratch_dir(spark, f"trees-{uuid.uuid4().hex}")
    model.write().overwrite().save(path)
    rows = spark.read.parquet(f"{path}/data")
    if "nodeData" in rows.columns:
        rows = rows.select("treeID", "nodeData.*")
    else:
        rows = rows.withColumn("treeID", F.lit(0))
    trees: dict[int, dict[int, tuple]] = {}
    for r in rows.select("treeID", "id", "impurityStats", "leftChild", "rightChild", "split").collect():   # the model's nodes
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    out = []
    for nodes in trees.values():
        order = [nodes[i] for i in range(len(nodes))]
        out.append(leaves(
            [r["split"]["featureIndex"] if r["leftChild"] >= 0 else -1 for r in order],
            [r["split"]["leftCategoriesOrThreshold"][0] if r["leftChild"] >= 0 else 0.0 for r in order],
            [r["leftChild"] for r in order], [r["rightChild"] for r in order],
            [r["impurityStats"][1] / (sum(r["impurityStats"]) or 1.0) / len(trees) for r in order]))
    return out


def supported(model) -> bool:
    last = model.stages[-1] if isinstance(model, PipelineModel) else model
    if isinstance(model, PipelineModel) and len(model.stages) > 3:      # a kernel map stands before the margin
        return False
    return isinstance(last, (BoostedTrees, Forest, DecisionTreeClassificationModel, RandomForestClassificationModel,
                             LogisticRegressionModel, LinearSVCModel))


def attributions(model, df: DataFrame, baseline: dict, id_col: str = "id") -> DataFrame:
    """(id, feature, value) of a fitted model's score against the baseline row:
    the margin of boosted and linear models (AdaBoost: the vote), the probability
    of trees and forests.  Values of a row sum to score(x) - score(baseline)."""
    if isinstance(model, BoostedTrees):
        names, columns = model.features, list(model.features)
        edges = [np.array(model.edges[c], float) for c in names]
        norm = 2.0 / (sum(abs(t.value[0]) for t in model.trees) or 1.0) if model.kind == "samme" else 1.0
        found = [leaves(t.feature, t.bin, t.left, [i + 1 for i in t.left], [v * norm for v in t.value]) for t in model.trees]
        rows = df.select(id_col, *[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(c) for c in columns])

        def ready(x: np.ndarray) -> np.ndarray:
            return binned(list(x), edges).astype(float)
    elif isinstance(model, Forest):
        names, columns = model.features, list(model.features)
        found = [leaves(f.tolist(), cut.tolist(), down.tolist(), (down + 1).tolist(), (value / model.trees).tolist())
                 for f, cut, down, value in stored(model.path)]
        rows = df.select(id_col, *[x.alias(c) for x, c in zip(model.filled(), columns)])
        baseline = {c: model.medians[c] if baseline.get(c) is None or baseline[c] != baseline[c] else baseline[c] for c in columns}

        def ready(x: np.ndarray) -> np.ndarray:
            return model.binned(list(x)).astype(float)
    elif supported(model):
        last = model.stages[-1]
        names = [c[:-3] for c in model.stages[1].getInputCols()]
        columns = [f"{c}__x" for c in names]
        rows = model.stages[0].transform(df.select(id_col, *names)).select(id_col, *columns)
        baseline = {c: v for c, v in zip(columns, model.stages[0].transform(
            df.sparkSession.createDataFrame([tuple(float(baseline[c]) for c in names)], ", ".join(f"`{c}` double" for c in names)))
            .select(*columns).first())}

        def ready(x: np.ndarray) -> np.ndarray:
            return x
        if hasattr(last, "coefficients"):
            linear = last.coefficients.toArray()
            packed = F.array(*[F.struct(F.lit(n).alias("feature"), (F.lit(float(w)) * (F.col(c) - F.lit(baseline[c]))).alias("value"))
                               for n, c, w in zip(names, columns, linear)])
            return rows.select(id_col, F.explode(packed).alias("s")).select(id_col, "s.feature", "s.value")
        found = _stored_trees(last)
    else:
        raise ValueError("no closed form for this model: use explain.shapley")
    z = ready(np.array([[float("nan") if baseline.get(c) is None else float(baseline[c])] for c in columns]).reshape(len(columns), 1))[:, 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = ready(np.array([b.column(1 + j).to_numpy(zero_copy_only=False).astype(float) for j in range(len(columns))])
                      .reshape(len(columns), len(b)))
            phi = np.zeros(x.shape)
            for tree in found:
                attribute(tree, x, z, phi)
            offsets = pa.array(np.arange(len(b) + 1, dtype=np.int32) * len(columns))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(phi.T.ravel()))], [id_col, "phi"])

    kind = rows.schema[id_col].dataType.simpleString()
    pairs = F.arrays_zip(F.array(*[F.lit(c) for c in names]).alias("feature"), F.col("phi").alias("value"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, phi array<double>").select(id_col, F.explode(pairs).alias("s")) \
        .select(id_col, F.col("s")["feature"].alias("feature"), F.col("s")["value"].alias("value"))
