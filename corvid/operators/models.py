"""Model families on distributed ``pyspark.ml`` (J1-J14); forests, boosted trees, SVC and
MLP are fitted by ``operators/forest.py``, ``boosting.py`` and ``descent.py``.

A fitted model is a ``PipelineModel`` whose first stage is a
``SQLTransformer`` carrying the fitted preprocessing as literals (median
fill, optional scaling, and alignment of absent features to 0.0), so one
``save`` / ``load`` round-trips everything and scoring is one narrow
projection plus the model's own transform (no shuffle).

Presets (fixed values of the original comparison scripts; an unlimited
tree depth becomes 20):

* rf        100 trees, depth 20, balanced weights (``operators/forest.py``, as subspace and the bases of stacking)
* gbt_hist  100 rounds, step 0.1, depth 10, 256 bins, 20 rows in a leaf, no L2
* gbt_xgb   100 rounds, step 0.1, depth 6, 256 bins, L2 1, second order of 1 in a leaf
* gbt_cat   500 rounds, step 0.05, depth 8, 128 bins, L2 3, balanced weights; best round on a
            20 % validation slice, early stop after 50 rounds without gain
* gbt       100 rounds, step 0.1, depth 3
* logreg    1,000 iterations, balanced weights
* dt        depth 20, balanced weights
* nb        Gaussian
* svc       linear margin over 128 random Fourier features of an RBF kernel, balanced weights
* mlp       hidden layers 128-64-32-16
* adaboost  100 stumps (SAMME)
* subspace  200 trees, half the features per split, no bootstrap
* stacking  forest + one-third-features forest, logistic meta-model on out-of-fold scores
"""

from __future__ import annotations

import hashlib
import json
import math
import re

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, LinearSVC, LinearSVCModel, LogisticRegression,
                                       MultilayerPerceptronClassifier, NaiveBayes)
from pyspark.ml.common import _py2java
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.wrapper import JavaWrapper
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.operators import boosting, descent, forest, prep
from corvid.operators.boosting import BoostedTrees
from corvid.operators.forest import Forest
from corvid.session import ensure_checkpoint_dir, reliable_checkpoint
from corvid.sources.io import path_exists

SEED = 42
# iterative learners run one Spark job per tree level / iteration; tiny
# partitions make that per-task overhead dominate.  Inputs are coalesced (no
# shuffle) so that a task holds at least this many rows; large inputs keep
# their partitioning.
ROWS_PER_TASK = 50_000
MIN_ROWS_PER_TASK = 5_000


def right_size(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Partitions for an iterative learner: about max(cores, rows / ROWS_PER_TASK)
    (fewer only when there are under MIN_ROWS_PER_TASK rows per core).
    Too many: coalesce (no shuffle).  Fewer than the cores (e.g. AQE merged
    a small shuffle output into one partition): one repartition up to the
    core count, since the learner then makes one pass per tree level or
    iteration.  Large inputs are never repartitioned upward."""
    rows = df.count() if rows is None else rows
    current = df.rdd.getNumPartitions()
    cores = df.sparkSession.sparkContext.defaultParallelism
    by_rows = -(-rows // ROWS_PER_TASK)
    floor_ = min(cores, max(1, rows // MIN_ROWS_PER_TASK))
    target = max(floor_, by_rows)
    if target < current:
        return df.coalesce(target)
    if current < floor_:           # only ever up to the core count: bounded shuffle
        return df.repartition(floor_)
    return df

PRESETS = {
    "rf": dict(numTrees=100, maxDepth=20, minInstancesPerNode=1, balanced=True),
    "gbt_hist": dict(maxIter=100, stepSize=0.1, maxDepth=10, l2=0.0, minRows=20),
    "gbt_xgb": dict(maxIter=100, stepSize=0.1, maxDepth=6, l2=1.0, minHessian=1.0),
    "gbt_cat": dict(maxIter=500, stepSize=0.05, maxDepth=8, maxBins=128, l2=3.0, validation=0.2, patience=50, balanced=True),
    "gbt": dict(maxIter=100, stepSize=0.1, maxDepth=3, l2=0.0),
    "logreg": dict(maxIter=1000, balanced=True, scale=True),
    "dt": dict(maxDepth=20, balanced=True),
    "nb": dict(),
    "svc": dict(maxIter=100, balanced=True, scale=True, fourier=128),
    "mlp": dict(hidden=[128, 64, 32, 16], maxIter=100, scale=True),
    "adaboost": dict(rounds=100, maxDepth=1),
    "subspace": dict(numTrees=200, featureSubsetStrategy="0.5", bootstrap=False, maxDepth=20),
    "stacking": dict(numTrees=200, folds=5),
}

DISPLAY = {"rf": "Random Forest", "gbt_hist": "HistGradientBoosting", "gbt_xgb": "XGBoost",
           "gbt_cat": "CatBoost", "gbt": "Gradient Boosting", "logreg": "Logistic Regression",
           "dt": "Decision Tree", "nb": "Naive Bayes", "svc": "Support Vector Machine",
           "mlp": "Neural Network", "knn": "K-Nearest Neighbors", "adaboost": "AdaBoost", "subspace": "RandomSubspace",
           "stacking": "Stacking"}


# binary nominal label metadata: classifiers then skip the job that scans the
# label column to count classes (once per fit, once per boosting round)
_BINARY_LABEL = {"ml_attr": {"type": "nominal", "num_vals": 2, "name": "label"}}


def binary_label(c) -> "F.Column":
    return (F.col(c) if isinstance(c, str) else c).cast("double").alias("label", metadata=_BINARY_LABEL)


def _lit(v: float) -> str:
    return f"CAST('{float(v)!r}' AS DOUBLE)"


def prep_transformer(features: list[str], medians: dict, scales: dict | None = None,
                     suffix: str = "__x") -> SQLTransformer:
    """Fitted preprocessing as SQL: fill (NULL and NaN) by train medians,
    optional standard scaling; features absent at scoring time are aligned by
    ``align_for`` before this stage."""
    exprs = []
    for c in features:
        e = f"coalesce(nanvl(CAST(`{c}` AS DOUBLE), CAST(NULL AS DOUBLE)), {_lit(medians.get(c, 0.0))})"
        if scales and c in scales:
            mu, sd = scales[c]
            e = f"(({e}) - {_lit(mu)}) / {_lit(sd)}"
        exprs.append(f"{e} AS `{c}{suffix}`")
    return SQLTransformer(statement=f"SELECT *, {', '.join(exprs)} FROM __THIS__")


def _unit(*parts) -> float:
    """A number in (0, 1) that follows from the md5 of the parts."""
    head = hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13]
    return (int(head, 16) + 0.5) / 16 ** 13


def fourier_waves(n_columns: int, size: int, gamma: float | None = None) -> list[list[float]]:
    """Per wave its phase and its direction (see ``fourier_stages``)."""
    spread = math.sqrt(2.0 * (gamma or 1.0 / n_columns))
    waves = []
    for j in range(size):
        normal = [math.sqrt(-2.0 * math.log(_unit(SEED, "radius", i, j))) * math.cos(2.0 * math.pi * _unit(SEED, "angle", i, j))
                  for i in range(n_columns)]
        waves.append([2.0 * math.pi * _unit(SEED, "phase", j), *(spread * x for x in normal)])
    return waves


def fourier_stages(columns: list[str], size: int, gamma: float | None = None) -> list:
    """Random Fourier features of the kernel exp(-gamma |x - y|^2), whose inner
    products approach it as ``size`` grows: sqrt(2 / size) cos(w x + b) with normal w
    and uniform b, both from md5, so a fit maps the same way everywhere.  The default
    ``gamma``, for scaled columns, is one over their number."""
    waves = [f"array({', '.join(map(_lit, w))})" for w in fourier_waves(len(columns), size, gamma)]
    turn = " + ".join(["w[0]", *(f"w[{i + 1}] * `{c}`" for i, c in enumerate(columns))])
    # one literal table and one expression over it: spelled out, 128 waves outgrow a method
    return [SQLTransformer(statement=f"SELECT *, transform(array({', '.join(waves)}), w -> {_lit(math.sqrt(2.0 / size))} * cos({turn})) "
                                     "AS __waves FROM __THIS__"),
            SQLTransformer(statement=f"SELECT *, {', '.join(f'__waves[{j}] AS __wave{j}' for j in range(size))} FROM __THIS__"),
            VectorAssembler(inputCols=[f"__wave{j}" for j in range(size)], outputCol="features", handleInvalid="error")]


def _estimator(family: str, p: dict, n_features: int, weight: str | None):
    common = dict(featuresCol="features", labelCol="label")
    # deep trees: node ids cached per row (checkpointed to the shared
    # checkpoint folder every 10 iterations); the per-task node-statistics
    # budget stays at Spark's default so 8+ concurrent tasks fit any heap
    tree_io = dict(cacheNodeIds=True, checkpointInterval=10, maxMemoryInMB=256)
    if family == "logreg":
        kw = dict(maxIter=p.get("maxIter", 100))
        if weight:
            kw["weightCol"] = weight
        return LogisticRegression(**common, **kw)
    if family == "dt":
        kw = dict(maxDepth=p.get("maxDepth", 5), seed=SEED, **tree_io)
        if weight:
            kw["weightCol"] = weight
        return DecisionTreeClassifier(**common, **kw)
    if family == "nb":
        return NaiveBayes(**common, modelType="gaussian")
    if family == "svc":
        kw = dict(maxIter=p.get("maxIter", 100))
        if weight:
            kw["weightCol"] = weight
        return LinearSVC(**common, **kw)
    if family == "mlp":
        layers = [n_features] + list(p.get("hidden", [16])) + [2]
        return MultilayerPerceptronClassifier(**common, layers=layers, maxIter=p.get("maxIter", 100), seed=SEED)
    raise ValueError(f"unknown family {family!r}")


def is_boosted(family: str) -> bool:
    return family.startswith("gbt") or family == "adaboost"


def boosting_params(p: dict, family: str) -> boosting.Params:
    if family == "adaboost":
        if p.get("maxDepth", 1) != 1:
            raise ValueError("AdaBoost boosts stumps (maxDepth = 1)")
        return boosting.Params(rounds=p.get("rounds", 100), depth=1, bins=p.get("maxBins", 256), kind="samme")
    return boosting.Params(rounds=p.get("maxIter", 20), depth=p.get("maxDepth", 5), step=p.get("stepSize", 0.1),
                           bins=p.get("maxBins", 256), l2=p.get("l2", 1.0), min_rows=p.get("minRows", 1),
                           min_hessian=p.get("minHessian", 0.0), patience=p.get("patience"))


def forest_params(p: dict) -> forest.Params:
    return forest.Params(trees=p.get("numTrees", 100), depth=p.get("maxDepth", 5), min_rows=p.get("minInstancesPerNode", 1),
                         subset=p.get("featureSubsetStrategy", "auto"), bootstrap=p.get("bootstrap", True), bins=p.get("maxBins", 32),
                         seed=SEED)


def fit_boosted(train: DataFrame, features: list[str], family: str, params: dict | None = None, label: str = "label",
                id_col: str = "id", folds: tuple[str, int] | None = None) -> list[BoostedTrees]:
    """One boosted model, or one per fold (column, k) left out, all in the same passes."""
    p = {**PRESETS.get(family, {}), **(params or {})}
    held = None
    if p.get("validation"):
        held = prep.seeded_md5(f"{SEED}val", id_col).substr(1, 8) < F.lit(format(int(p["validation"] * 16 ** 8), "08x"))
    return boosting.fit(train, features, family, boosting_params(p, family), label, bool(p.get("balanced")), folds, held)


def prepared(train: DataFrame, features: list[str], label: str = "label") -> dict:
    """What every family's preparation needs of a train table, computed once:
    medians, class counts, and means and deviations of the filled features."""
    medians = prep.fit_median(train, features)
    feats = [c for c in features if c in medians]
    return {"medians": medians, "counts": prep.class_counts_local(train, label),
            "scales": prep.fit_standard(prep.apply_fill(train, medians), feats)}


def fit(train: DataFrame, features: list[str], family: str, params: dict | None = None,
        label: str = "label", id_col: str = "id", stats: dict | None = None):
    """Fit one family; preprocessing is fitted on ``train`` only (``stats``: what
    ``prepared`` gave for it)."""
    p = {**PRESETS.get(family, {}), **(params or {})}
    ensure_checkpoint_dir(train.sparkSession)      # tree node-id cache checkpoints go there
    if is_boosted(family):
        return _described(fit_boosted(train, features, family, params, label, id_col)[0], family,
                          stats["counts"] if stats else prep.class_counts_local(train, label))
    if family == "stacking":
        return _described(fit_stacking(train, features, p, label, id_col),
                          family, prep.class_counts_local(train, label))
    medians = stats["medians"] if stats else prep.fit_median(train, features)
    feats = [c for c in features if c in medians]           # all-null features leave by name
    if family in ("rf", "subspace"):
        counts = stats["counts"] if stats else prep.class_counts_local(train, label)
        w = (prep.balanced_weights(counts) if p.get("balanced") else None) or {}
        return _described(forest.fit(train, feats, family, forest_params(p), {c: medians[c] for c in feats}, (w.get(0, 1.0), w.get(1, 1.0)),
                                     label, id_col, sum(counts.values())), family, counts)
    scales = None
    if p.get("scale"):
        scales = stats["scales"] if stats else prep.fit_standard(prep.apply_fill(train, medians), feats)
    stages = [prep_transformer(feats, medians, scales),
              VectorAssembler(inputCols=[f"{c}__x" for c in feats], outputCol="plain" if p.get("fourier") else "features",
                              handleInvalid="error")]
    if p.get("fourier"):
        stages += fourier_stages([f"{c}__x" for c in feats], p["fourier"], p.get("gamma"))
    data = train.withColumn("label", binary_label(label))
    weight = None
    # one row per class; also sizes partitions
    counts = stats["counts"] if stats else prep.class_counts_local(data, "label")
    if p.get("balanced"):
        w = prep.balanced_weights(counts)
        if w is not None:
            expr = F.lit(None).cast("double")
            for c, v in w.items():
                expr = F.when(F.col("label") == c, F.lit(v)).otherwise(expr)
            data, weight = data.withColumn("_w", expr), "_w"
    estimator, rows = _estimator(family, p, len(feats), weight), sum(counts.values())
    slots = boosting._slots(train.sparkSession) if family in ("svc", "mlp") else 0  # noqa: SLF001
    if slots and rows and feats and set(counts) <= {0, 1}:       # else the estimator itself, or its own error
        # the network's loss depends on blocks of rows: those that the estimator would make
        ready = stages[0].transform(right_size(data, rows) if family == "mlp" else data) \
            .select(*[f"{c}__x" for c in feats], "label", F.col(weight) if weight else F.lit(1.0).alias("_w"))
        if family == "mlp":
            ready = descent.stacked(ready.drop("_w"))
        last = _descended(ready, estimator, p, len(feats), min(slots, max(1, rows // MIN_ROWS_PER_TASK)))
        return _described(PipelineModel([*stages, last]), family, counts)
    return _described(Pipeline(stages=[*stages, estimator]).fit(right_size(data, rows)), family, counts)


def _descended(ready: DataFrame, estimator, p: dict, n_features: int, tasks: int):
    """The model of ``estimator`` (SVC or MLP), its numbers found in one barrier stage."""
    rounds, tol = estimator.getMaxIter(), estimator.getTol()
    if isinstance(estimator, LinearSVC):
        waves = np.array(fourier_waves(n_features, p["fourier"], p.get("gamma"))) if p.get("fourier") else None
        *found, shift = descent.fitted(ready, n_features, tasks, lambda share, total: descent.margin_fit(share, waves, rounds, tol, total))
        made = JavaWrapper._new_java_obj("org.apache.spark.ml.classification.LinearSVCModel", estimator.uid,  # noqa: SLF001
                                         _py2java(ready.sparkSession.sparkContext, Vectors.dense(found)), float(shift))
        return LinearSVCModel(made)
    # an estimator without iterations gives the weights it would start with, or takes given ones
    two = ready.sparkSession.createDataFrame([(float(c), Vectors.dense([0.0] * n_features)) for c in (0, 1)], ["label", "features"])
    layers = estimator.getLayers()
    start = estimator.copy({estimator.maxIter: 0}).fit(two).weights.toArray()
    found = descent.fitted(ready, n_features, tasks, lambda share, total: descent.network_fit(share, layers, start, rounds, tol, total))
    return estimator.copy({estimator.maxIter: 0, estimator.initialWeights: Vectors.dense(found)}).fit(two)


def _described(model, family: str, counts: dict):
    """What ``save`` records of a fit: family and training rows per class."""
    model._corvid = {"family": family,  # noqa: SLF001
                     "classes": {str(int(c)): n for c, n in counts.items() if c is not None}}
    return model


def feature_names(model) -> list[str]:
    """Trained feature names, in order, of any fitted family."""
    if isinstance(model, (BoostedTrees, Forest, StackedModel)):
        return list(model.features)
    va = [s for s in model.stages if isinstance(s, VectorAssembler)][0]
    return [c[:-3] for c in va.getInputCols()]


def align_for(model, df: DataFrame, keep: list[str] = ("id",)) -> DataFrame:
    """B16 before scoring: trained names in order, absent ones 0.0, extras
    ignored."""
    names = feature_names(model)
    have = set(df.columns)
    return df.select(*[F.col(k) for k in keep if k in have and k not in names],
                     *[F.col(k) for k in ("label",) if k in have and k not in keep],
                     *[(F.col(n).cast("double") if n in have else F.lit(0.0)).alias(n) for n in names])


def score(model, df: DataFrame, keep: list[str] = ("id", "label")) -> DataFrame:
    """Narrow scoring: (keep..., prediction int, p1 double, confidence)."""
    if isinstance(model, (BoostedTrees, Forest, StackedModel)):
        return model.score(df, keep)
    found = _wave_margin(model)
    if found is not None:
        ready, margin = model.stages[0].transform(df), F.col("_m")
        cols = [c for c in keep if c in ready.columns]
        p1 = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
        return ready.select(*cols, found.alias("_m")).select(
            *cols, ((margin > model.stages[-1].getThreshold()) & ~F.isnan(margin)).cast("int").alias("prediction"), p1.alias("p1"),
            F.greatest(p1, F.lit(1.0) - p1).alias("confidence"))
    out = model.transform(df)
    if "probability" in out.columns:
        p1 = vector_to_array("probability")[1]
    else:   # margin models: logistic of the raw margin as a score
        p1 = F.lit(1.0) / (F.lit(1.0) + F.exp(-vector_to_array("rawPrediction")[1]))
    cols = [c for c in keep if c in out.columns]
    return out.select(*cols, F.col("prediction").cast("int").alias("prediction"), p1.alias("p1"),
                      F.greatest(p1, F.lit(1.0) - p1).alias("confidence"))


def _wave_margin(model):
    """The margin of a row as a column (Arrow batches, no shuffle) where the last stage
    stands on random Fourier features; the stages' own expression over all waves takes
    many times longer."""
    if not isinstance(model, PipelineModel) or not isinstance(model.stages[-1], LinearSVCModel):
        return None
    spelled = [s.getStatement() for s in model.stages if isinstance(s, SQLTransformer) and " AS __waves " in s.getStatement()]
    if not spelled:
        return None
    names = feature_names(model)
    *numbers, size = [float(x) for x in re.findall(r"CAST\('([^']+)' AS DOUBLE\)", spelled[0])]
    waves = np.array(numbers).reshape(-1, len(names) + 1) / (2.0 * math.pi)        # in whole turns
    found, shift = model.stages[-1].coefficients.toArray(), float(model.stages[-1].intercept)

    @F.pandas_udf("double")
    def margin(x: pd.DataFrame) -> pd.Series:
        rows, out = x.to_numpy(float), np.empty(len(x))
        for at in range(0, len(rows), descent.CHUNK):
            z = rows[at:at + descent.CHUNK] @ waves[:, 1:].T
            z += waves[:, 0]
            out[at:at + descent.CHUNK] = descent.cosines(z, size) @ found + shift
        return pd.Series(out)

    return margin(F.struct(*[F.col(f"{c}__x").alias(f"x{i}") for i, c in enumerate(names)]))


def importances(model) -> list[tuple[str, float]]:
    """(feature, importance) with names carried alongside.  Boosted trees:
    shares of gain, AdaBoost: of vote weight; stacking: mean of the bases."""
    if isinstance(model, StackedModel):
        per_base = [dict(importances(b)) for b in model.bases]
        return [(f, sum(b.get(f, 0.0) for b in per_base) / len(per_base)) for f in model.features]
    if isinstance(model, (BoostedTrees, Forest)):
        return model.importances()
    est = model.stages[-1]
    names = feature_names(model)
    if hasattr(est, "featureImportances"):
        vals = est.featureImportances.toArray()
    elif hasattr(est, "coefficients") and len(est.coefficients) == len(names):
        vals = [abs(v) for v in est.coefficients.toArray()]
    else:
        vals = [0.0] * len(names)
    return list(zip(names, [float(v) for v in vals]))


# --- J13 stacking ----------------------------------------------------------------------------------
class StackedModel:
    def __init__(self, bases, meta, features):
        self.bases, self.meta, self.features = bases, meta, features

    def score(self, df: DataFrame, keep=("id", "label")) -> DataFrame:
        cur = df
        for i, b in enumerate(self.bases):
            s = score(b, cur, list(cur.columns)).withColumnRenamed("p1", f"_b{i}").drop("prediction", "confidence")
            cur = s
        out = self.meta.transform(cur)
        p1 = vector_to_array("probability")[1]
        cols = [c for c in keep if c in out.columns]
        return out.select(*cols, F.col("prediction").cast("int").alias("prediction"), p1.alias("p1"),
                          F.greatest(p1, F.lit(1.0) - p1).alias("confidence"))


def fit_stacking(train: DataFrame, features: list[str], p: dict, label: str = "label",
                 id_col: str = "id") -> StackedModel:
    """Out-of-fold base scores (stratified folds), joined back by id (an
    equi-join on the unique id), then a logistic meta-model."""
    k = p.get("folds", 5)
    trees = p.get("numTrees", 200)
    base_params = [dict(numTrees=trees, maxDepth=p.get("maxDepth", 5), balanced=True),
                   dict(numTrees=trees, maxDepth=p.get("maxDepth", 5), balanced=True,
                        featureSubsetStrategy="onethird")]
    folded = reliable_checkpoint(prep.kfold(train, k, label, id_col))
    oof = None
    for i, bp in enumerate(base_params):
        parts = []
        for f in range(k):
            m = fit(folded.where(F.col("fold") != f), features, "rf", bp, label, id_col)
            parts.append(score(m, folded.where(F.col("fold") == f), [id_col]).select(id_col, F.col("p1").alias(f"_b{i}")))
        col = parts[0]
        for x in parts[1:]:
            col = col.unionByName(x)
        oof = col if oof is None else oof.join(col, id_col)
    meta_in = train.select(id_col, F.col(label).cast("double").alias("label")).join(oof, id_col)
    meta = Pipeline(stages=[VectorAssembler(inputCols=[f"_b{i}" for i in range(len(base_params))],
                                            outputCol="_mf"),
                            LogisticRegression(featuresCol="_mf", labelCol="label", maxIter=1000)]).fit(meta_in)
    bases = [fit(train, features, "rf", bp, label, id_col) for bp in base_params]
    return StackedModel(bases, meta, features)


# --- A12 save / load ----------------------------------------------------------------------------------
def _write_json(spark, path: str, value: dict) -> None:
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1) \
        .write.mode("overwrite").text(path)


def metadata(spark, path: str) -> dict:
    """What ``save`` wrote beside the stages of a model."""
    return json.loads(spark.read.text(f"{path}/about").first()[0])


def save(model, path: str, about: dict | None = None) -> None:
    """Any fitted family: its Spark stages below ``path``, and a JSON record
    (kind, feature names, and the caller's ``about``) that is
    written last, so a model without it is incomplete."""
    spark = SparkSession.active()
    record = {**getattr(model, "_corvid", {}), **(about or {}), "features": feature_names(model)}
    if isinstance(model, BoostedTrees):
        _write_json(spark, f"{path}/trees", model.as_dict())
        record["kind"] = "boosted"
    elif isinstance(model, Forest):
        forest.saved(model, f"{path}/trees")
        _write_json(spark, f"{path}/forest", model.as_dict())
        record["kind"] = "forest"
    elif isinstance(model, StackedModel):
        for i, b in enumerate(model.bases):
            save(b, f"{path}/base-{i}")
        model.meta.write().overwrite().save(f"{path}/meta")
        record |= {"kind": "stacked", "bases": len(model.bases)}
    else:
        model.write().overwrite().save(f"{path}/model")
        record["kind"] = "pipeline"
    _write_json(spark, f"{path}/about", record)


def load(path: str):
    record = metadata(SparkSession.active(), path)
    if record["kind"] == "boosted":
        return BoostedTrees.from_dict(json.loads(SparkSession.active().read.text(f"{path}/trees").first()[0]))
    if record["kind"] == "forest":
        return forest.restored(json.loads(SparkSession.active().read.text(f"{path}/forest").first()[0]), f"{path}/trees")
    if record["kind"] == "stacked":
        return StackedModel([load(f"{path}/base-{i}") for i in range(record["bases"])],
                            PipelineModel.load(f"{path}/meta"), record["features"])
    return PipelineModel.load(f"{path}/model")


def status(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """One row per expected model (name -> folder), read from the records
    on disk; a model without its record is not trained."""
    rows = []
    for name, path in sorted(paths.items()):
        about = metadata(spark, path) if path_exists(spark, f"{path}/about/_SUCCESS") else None
        classes = (about or {}).get("classes") or {}
        feats = about["features"] if about else []
        rows.append((name, about is not None, sum(classes.values()) if classes else None, classes.get("1"),
                     len(feats), ",".join(feats)))
    return spark.createDataFrame(rows, "model string, trained boolean, n_train long, n_positive long, "
                                       "n_features int, features string")
