"""Sorting, top-k and choosing models (G1-G7) and the guaranteed-key list
(C3).  All inputs here are per-model or per-feature tables (bounded by the
model / feature list); top-k over data rows uses ``orderBy().limit()``,
which plans as a per-partition top-k followed by a merge (TakeOrdered)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_models(results: DataFrame, by: str = "accuracy", name: str = "model") -> DataFrame:
    """G1: descending rank (ties by name)."""
    w = Window.orderBy(F.desc_nulls_last(by), name)
    return results.withColumn("rank", F.row_number().over(w).cast("long"))


def top_k(results: DataFrame, by: str, k: int = 5, name: str = "model") -> DataFrame:
    """K best by ``by``."""
    return results.orderBy(F.desc_nulls_last(by), name).limit(k)


def _arg(by: str, how: str, name: str) -> Column:
    """The ``name`` at the largest or smallest ``by`` (nulls last, ties by name)."""
    value = -F.col(by) if how == "max" else F.col(by)
    return F.min_by(name, F.struct(F.col(by).isNull(), value, F.col(name)))


def best_by(results: DataFrame, criteria: dict, name: str = "model") -> DataFrame:
    """Arg-max / arg-min per criterion (ties by name), one row, one pass."""
    return results.agg(*[_arg(by, how, name).alias(alias) for alias, (by, how) in criteria.items()])


def auc_summary(results: DataFrame, col: str = "roc_auc") -> DataFrame:
    """Average and best AUC."""
    return results.agg(F.round(F.avg(col), 4).alias("mean_auc"), F.max(col).alias("best_auc"))


def recommend(results: DataFrame, quality: str, seconds: str, name: str = "model") -> DataFrame:
    """One model when the best is also the fastest (fewest ``seconds``), else both."""
    picked = results.agg(_arg(quality, "max", name).alias("best"), _arg(seconds, "min", name).alias("fastest"))
    return picked.select(F.stack(F.lit(2), F.lit("best"), "best", F.lit("fastest"), "fastest").alias("role", "model"),
                         "best").where((F.col("role") == "best") | ~F.col("model").eqNullSafe(F.col("best"))).drop("best")


def importance_table(spark, names: list[str], values, model: str | None = None) -> DataFrame:
    """Names + importances -> DataFrame (names travel with values)."""
    rows = [(n, float(v)) for n, v in zip(names, values)]
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.withColumn("model", F.lit(model)) if model else df


def importance_topk(imp: DataFrame, k: int = 20) -> DataFrame:
    return imp.orderBy(F.desc("importance"), "feature").limit(k)


def topk_abs(contrib: DataFrame, k: int = 5, id_col: str = "id", value: str = "value",
             feature: str = "feature") -> DataFrame:
    """Per id the k contributions of largest magnitude.  The window is
    partitioned by id (a bounded group: one row per feature)."""
    w = Window.partitionBy(id_col).orderBy(F.desc(F.abs(F.col(value))), feature)
    return contrib.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def guaranteed_list(imp: DataFrame, chosen: list[str], limit: int = 50,
                    feature: str = "feature", value: str = "importance") -> DataFrame:
    """The chosen features first (0 when absent), then the others by
    importance, at most ``limit`` rows."""
    spark = imp.sparkSession
    ch = spark.createDataFrame([(c, i) for i, c in enumerate(chosen)], f"{feature} string, pos int")
    first = (ch.join(F.broadcast(imp), feature, "left")
             .select(feature, F.coalesce(F.col(value), F.lit(0.0)).alias(value), F.lit(0).alias("grp"), "pos"))
    rest = (imp.join(F.broadcast(ch), feature, "left_anti")
            .select(feature, value, F.lit(1).alias("grp"), F.lit(0).alias("pos")))
    w = Window.orderBy("grp", "pos", F.desc(value), feature)
    out = first.unionByName(rest).withColumn("rank", F.row_number().over(w).cast("long"))
    return out.where(F.col("rank") <= limit).select(feature, value, "rank")
