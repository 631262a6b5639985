"""Scoring (K1-K4).  Every model of an ensemble is applied to the same rows
in one narrow pass; the vote is column arithmetic, so no join is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.functions.scalar import planet_text
from corvid.operators import models as M


def ensemble_vote(df: DataFrame, pred_cols: list[str], prob_cols: list[str]) -> DataFrame:
    """K3: class = round-half-even of the mean class; probability = mean of
    the positive probabilities (every model, not only the first)."""
    n = float(len(pred_cols))
    mean_cls = sum(F.col(c).cast("double") for c in pred_cols) / n
    mean_p = sum(F.col(c) for c in prob_cols) / float(len(prob_cols))
    return df.withColumn("vote", F.rint(mean_cls).cast("int")).withColumn("p1_mean", mean_p)


def batch_score(models: dict, df: DataFrame, id_col: str = "id") -> DataFrame:
    """K2: (id, per-model classes, class text, confidence, positive
    probability).  Unlabelled rows are scored, never dropped."""
    cur = df
    preds, probs = [], []
    for name, m in models.items():
        aligned = M.align_for(m, cur, keep=list(cur.columns))
        s = M.score(m, aligned, keep=list(cur.columns))
        cur = (s.withColumnRenamed("prediction", f"pred_{name}").withColumnRenamed("p1", f"p1_{name}")
               .drop("confidence"))
        preds.append(f"pred_{name}")
        probs.append(f"p1_{name}")
    v = ensemble_vote(cur, preds, probs)
    return v.select(id_col, *preds, planet_text(F.col("vote")).alias("prediction"),
                    F.greatest(F.col("p1_mean"), 1 - F.col("p1_mean")).alias("confidence"),
                    F.col("p1_mean").alias("probability_planet"))


def score_record(spark: SparkSession, models: dict, record: dict) -> DataFrame:
    """K1: one feature map -> the same path as K2 on a one-row table."""
    names = sorted(record)
    df = spark.createDataFrame([(0, *[float(record[k]) if record[k] is not None else None for k in names])],
                               ", ".join(["id long"] + [f"`{k}` double" for k in names]))
    return batch_score(models, df)


def single_score(model, df: DataFrame, keep=("id", "label")) -> DataFrame:
    """K4: features aligned by name, then the model's own preprocessing."""
    return M.score(model, M.align_for(model, df, keep=list(keep)), list(keep))
