"""Multi-step jobs (J15-J19): cross-validation, model comparison, per-source
training, retraining one model on a persisted split, and the full training
job from raw table to saved models and a history row.

Loops run on the driver over a bounded list (folds, model families,
sources); each step is a distributed Spark job.  Result tables are one row
per fold / model, built from small per-step aggregates."""

from __future__ import annotations

import gc
import time
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.functions import labels as L
from corvid.operators import evaluate as E
from corvid.operators import models as M
from corvid.operators import neighbors as N
from corvid.operators import prep
from corvid.session import reliable_checkpoint
from corvid.sources import io

METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc"]
TRAIN_METRICS = [f"train_{m}" for m in METRICS]
SCORED_ROWS = 500_000      # rows of a partition that is scored


def _metrics(scored: DataFrame) -> dict:
    """Metrics of scored rows, which are scored once: the metrics read them four times."""
    scored = scored.select("label", "prediction", "p1").persist()
    met = E.binary_metrics(scored, "label", "prediction", "p1").first().asDict()
    scored.unpersist()
    return met


def _fit(train: DataFrame, features: list[str], family: str, params: dict | None = None,
         label: str = "label", id_col: str = "id", stats: dict | None = None):
    """A fitted family as a function that scores rows (all columns named in
    ``keep`` stay).  k nearest neighbours ("knn", 5 unless ``params`` has ``k``)
    have no model: they keep the train rows, filled and scaled by the train
    side's own statistics (``stats``, if it has been prepared)."""
    if family != "knn":
        m = M.fit(train, features, family, params, label, id_col, stats)
        return lambda rows, keep=("id", "label"): M.score(m, rows, list(keep))
    stats = stats or M.prepared(train, features, label)
    medians, scales = stats["medians"], stats["scales"]
    feats = [c for c in features if c in medians]

    def ready(rows: DataFrame) -> DataFrame:
        rows = rows.select(id_col, label, *[F.col(c).cast("double").alias(c) for c in feats])
        return prep.apply_scale(prep.apply_fill(rows, medians), scales)

    def score(rows: DataFrame, keep=("id", "label")) -> DataFrame:
        votes = N.knn_classify(ready(train), ready(rows), feats, (params or {}).get("k", 5), id_col, label)
        p1 = F.when(F.col("prediction") == 1, F.col("share")).otherwise(1.0 - F.col("share"))
        return rows.select(*keep).join(votes.withColumn("prediction", F.col("prediction").cast("int")), id_col) \
            .select(*keep, "prediction", p1.alias("p1"))
    return score


def _spread(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in as many partitions as tasks run at once, or more: small tables lie in
    few partitions after a shuffle, which then would score one after another."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // SCORED_ROWS)))


def grouped_metrics(scored: DataFrame, by: list[str]) -> DataFrame:
    """E1 for every group of a long table of scores, in one aggregate and one AUC."""
    y, p = F.col("label"), F.col("prediction")
    cells = [F.count_if((y == a) & (p == b)).cast("double").alias(n) for n, a, b in
             (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))]
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def share(a, b):
        return F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    counts = scored.groupBy(*by).agg(*cells).select(
        *by, share(tp + tn, tp + tn + fp + fn).alias("accuracy"), share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))
    auc = E.roc_auc(scored, "p1", "label", by).withColumnRenamed("auc", "roc_auc")
    return counts.join(auc, by, "left")


def cross_validate(df: DataFrame, features: list[str], family: str, k: int = 5, balance: str = "none",
                   params: dict | None = None, id_col: str = "id") -> DataFrame:
    """Stratified k folds; balancing is applied inside the training
    folds only (no leakage); per fold its metrics on the rows left out and, as
    ``train_...``, on the rows that it was fitted on.

    Boosted families fit all folds in the same passes; every family is scored
    on the whole table, and the metrics of all folds are one aggregate."""
    folded = reliable_checkpoint(prep.kfold(df, k, "label", id_col))
    # fits read the rows as they lie: approximate bin edges may depend on that
    wide = folded if folded.rdd.getNumPartitions() >= df.sparkSession.sparkContext.defaultParallelism else _spread(folded, folded.count())
    if M.is_boosted(family) and balance == "none":
        models = M.fit_boosted(folded, features, family, params, "label", id_col, folds=("fold", k))
        scorers = [lambda rows, keep, m=m: M.score(m, rows, keep) for m in models]
    else:
        scorers = [_fit(prep.balance(folded.where(F.col("fold") != f), balance, features, "label", id_col), features, family, params,
                        "label", id_col) for f in range(k)]
    parts = []
    for f, scorer in enumerate(scorers):
        part = scorer(wide, [id_col, "label", "fold"]).select("label", "prediction", "p1", F.lit(f).alias("of"),
                                                                (F.col("fold") == f).alias("left_out"))
        if family == "knn":            # what a fold's search has shuffled need not stay for the next one's
            part = reliable_checkpoint(part)
            gc.collect()
            df.sparkSession.sparkContext._jvm.System.gc()  # noqa: SLF001 - Spark deletes shuffles of collected frames
        parts.append(part)
    scored = reduce(DataFrame.unionByName, parts).persist()
    found = {(r["of"], r["left_out"]): r for r in grouped_metrics(scored, ["of", "left_out"]).collect()}     # 2 k rows
    scored.unpersist()
    rows = [(f, *[found[f, side][x] if (f, side) in found else None for side in (True, False) for x in METRICS]) for f in range(k)]
    return df.sparkSession.createDataFrame(rows, "fold int, " + ", ".join(f"{m} double" for m in METRICS + TRAIN_METRICS))


def compare_models(train: DataFrame, test: DataFrame, features: list[str], families: list[str],
                   params: dict | None = None) -> DataFrame:
    """Per family fit, time, score, metrics, work estimate -> one row."""
    from corvid.functions.scalar import flops_estimate
    train = train.cache()
    test = test.cache()
    n_train, n_test = train.count(), test.count()
    stats = M.prepared(train, features)         # shared by all families, outside their times
    rows = []
    for fam in families:
        t0 = time.time()
        scorer = _fit(train, features, fam, (params or {}).get(fam), stats=stats)
        t1 = time.time()
        met = _metrics(scorer(test))
        t2 = time.time()
        rows.append((M.DISPLAY.get(fam, fam), *[met[x] for x in METRICS], t1 - t0, t2 - t1,
                     (t2 - t1) / max(n_test, 1) * 1000.0, n_train, n_test, len(features)))
    spark = train.sparkSession
    out = spark.createDataFrame(rows, "Model string, " + ", ".join(f"Test_{m} double" for m in METRICS)
                                + ", Train_Time_s double, Test_Time_s double, Inference_ms_per_sample double, "
                                  "n_train long, n_test long, n_features long")
    out = out.withColumn("Approx_FLOPS", flops_estimate("Model", "n_train", "n_test", "n_features"))
    train.unpersist()
    test.unpersist()
    return out


def train_per_source(df: DataFrame, source_col: str, features: list[str], families: list[str],
                     test_size: float = 0.2, min_rows: int = 30, params: dict | None = None) -> DataFrame:
    """Per family one model for each source and one on the union, all on
    the same split; a source under ``min_rows`` keeps its rows, with its count
    and null metrics."""
    df = df.persist()          # read for the sources, their counts, and their splits
    sources = [r[0] for r in df.select(source_col).distinct().collect()]   # bounded: source list
    rows = []
    for name in sorted(sources) + [None]:
        part = df if name is None else df.where(F.col(source_col) == name)
        n = part.count()
        if n < min_rows:
            rows += [(name or "ALL", M.DISPLAY.get(fam, fam), n, *[None] * len(METRICS)) for fam in families]
            continue
        sp = prep.stratified_split(part, test_size=test_size).cache()
        train, test = sp.where(F.col("split") == "train"), sp.where(F.col("split") == "test")
        stats = M.prepared(train, features)
        for fam in families:
            met = _metrics(_fit(train, features, fam, (params or {}).get(fam), stats=stats)(_spread(test, n)))
            rows.append((name or "ALL", M.DISPLAY.get(fam, fam), n, *[met[x] for x in METRICS]))
        sp.unpersist()
    df.unpersist()
    return df.sparkSession.createDataFrame(rows, "source string, model string, n_rows long, " + ", ".join(f"{m} double" for m in METRICS))


def persist_split(split_df: DataFrame, path: str, id_col: str = "id") -> None:
    """The split is written by id, so a retrain after a restart reuses it."""
    split_df.select(id_col, "split").write.mode("overwrite").parquet(path)


def retrain_one(df: DataFrame, split_path: str, features: list[str], family: str, params: dict | None = None,
                id_col: str = "id"):
    """New parameters, same persisted split; returns (model, metrics)."""
    spark = df.sparkSession
    split = spark.read.parquet(split_path)
    joined = df.join(split, id_col, "inner").persist()      # a fit runs several passes
    m = M.fit(joined.where(F.col("split") == "train"), features, family, params)
    met = _metrics(M.score(m, joined.where(F.col("split") == "test")))
    joined.unpersist()
    return m, met


def train_job(spark, upload: DataFrame, out_dir: str, label_col: str | None = None, policy: str = "general",
              families: tuple = ("rf", "gbt_hist", "gbt_xgb", "gbt_cat"), params: dict | None = None,
              features: list[str] | None = None, id_col: str = "id", balance: str = "smote",
              test_size: float = 0.2, manual_col: str = "label") -> dict:
    """Master append -> label -> split (persisted) -> balance on train
    -> fit each family -> metrics -> save models -> history row.

    Rows typed in by hand carry their text in ``manual_col`` and no disposition:
    it counts where the label column is null."""
    from corvid.operators.select import API_EXCLUDE, numeric_cols
    master_root = f"{out_dir}/master"
    master = io.read_versioned(spark, master_root)
    combined = io.append_master(upload, master)
    io.write_versioned(combined, master_root)
    combined = io.read_versioned(spark, master_root)
    lc = label_col or L.find_label_column(combined)
    if manual_col in combined.columns and manual_col != lc:
        typed = F.col(lc).isNull()
        # such rows have no id either: a hash far below all synthetic ids
        own_id = -F.abs(F.xxhash64(F.to_json(F.struct("*"))).bitwiseOR(F.lit(1 << 62)))
        combined = combined.withColumn(id_col, F.coalesce(F.col(id_col), F.when(typed, own_id))) \
            .withColumn(lc, F.coalesce(F.col(lc), io.manual_disposition(manual_col))).drop(manual_col)
    lab = L.binary_filter(L.map_label(combined, lc, policy, "label"))
    feats = features or numeric_cols(lab, exclude=set(API_EXCLUDE) | {lc, id_col})
    split = prep.stratified_split(lab, test_size=test_size)
    persist_split(split, f"{out_dir}/split", id_col)
    split = lab.join(spark.read.parquet(f"{out_dir}/split"), id_col)
    # every family runs several passes (medians, weights, training): the
    # balanced train side (SMOTE includes a neighbour search) and the test
    # side are computed once and kept (memory and disk)
    train = prep.balance(split.where(F.col("split") == "train"), balance, feats, "label", id_col).persist()
    test = split.where(F.col("split") == "test").persist()
    stats = M.prepared(train, feats)
    metrics = {}
    for fam in families:
        m = M.fit(train, feats, fam, (params or {}).get(fam), "label", id_col, stats)
        metrics[fam] = _metrics(M.score(m, test))
        M.save(m, f"{out_dir}/models/{fam}", {"family": fam, "policy": policy, "label_col": lc})
    io.append_history(spark, f"{out_dir}/history", lab.count(), len(feats), metrics, params or {}, True)
    train.unpersist()
    test.unpersist()
    return {"features": feats, "metrics": metrics, "families": list(families)}
