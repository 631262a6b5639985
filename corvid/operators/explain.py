"""Local attribution (K5), top-k by magnitude (G7), sentences (I13) and
"explain the first row" (K6).

For a score that is only known as a function (``attribution`` has closed forms
for fitted trees, forests, boosted and linear models), exact Shapley values against a baseline row (for example the training
medians): every row is expanded to its 2^n coalitions (``explode`` of a
bounded ``sequence``; n <= 10), features outside the coalition take the
baseline value, the model scores all coalitions in one pass, and

    phi_i = sum over coalitions T of v(T) * c_i(T),
    c_i(T) = |T-1|! (n-|T|)! / n!   if i in T,   -|T|! (n-|T|-1)! / n!  otherwise

so the attribution is one ``groupBy(id)`` aggregation (2^n rows per id,
bounded) with no self-join.  The values sum to f(x) - f(baseline).
"""

from __future__ import annotations

from collections.abc import Callable
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.operators.rank import topk_abs

MAX_FEATURES = 10


def shapley(df: DataFrame, features: list[str], baseline: dict,
            score: Callable[[DataFrame], DataFrame], id_col: str = "id", score_col: str = "_v") -> DataFrame:
    """Long output (id, feature, value).  ``score`` maps a frame with the
    feature columns to the same frame plus ``score_col``."""
    n = len(features)
    if n > MAX_FEATURES:
        raise ValueError(f"coalitions of {n} features are too many (at most {MAX_FEATURES}); "
                         "attribution.attributions has closed forms for trees, forests, boosted and linear models")
    masks = df.select(F.col(id_col), *features, F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))).alias("_m"))
    coal = masks.select(id_col, "_m", *[
        F.when((F.col("_m").bitwiseAND(F.lit(1 << i))) != 0, F.col(c)).otherwise(F.lit(float(baseline[c]))).alias(c)
        for i, c in enumerate(features)])
    scored = score(coal)
    size = F.bit_count(F.col("_m"))
    nf = float(factorial(n))

    # |S|! (n - |S| - 1)! / n! for |S| in 0..n-1, looked up in a literal array
    weights = F.array(*[F.lit(factorial(k) * factorial(n - k - 1) / nf) for k in range(n)])

    def weight(sz: Column) -> Column:
        return F.try_element_at(weights, sz + 1)
    aggs = []
    for i, c in enumerate(features):
        has = (F.col("_m").bitwiseAND(F.lit(1 << i))) != 0
        coef = F.when(has, weight(size - 1)).otherwise(-weight(size))
        aggs.append(F.sum(F.col(score_col) * coef).alias(c))
    wide = scored.groupBy(id_col).agg(*aggs)
    packed = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in features])
    return wide.select(id_col, F.explode(packed).alias("s")).select(id_col, "s.feature", "s.value")


def shapley_topk(df: DataFrame, features: list[str], baseline: dict, score: Callable, k: int = 5,
                 id_col: str = "id", digits: int = 9) -> DataFrame:
    """K5 + G7: the k largest |phi| per row (phi rounded to ``digits``)."""
    phi = shapley(df, features, baseline, score, id_col).withColumn("value", F.round("value", digits))
    return topk_abs(phi, k, id_col)


def sentence(pred_label: Column, prob: Column, f1: Column, v1: Column, f2: Column, v2: Column,
             short: bool = False) -> Column:
    """Plain-language summary of the two strongest influences; with
    fewer than two features only the prediction is stated."""
    d1 = F.when(v1 > 0, F.lit("increases")).otherwise(F.lit("decreases"))
    d2 = F.when(v2 > 0, F.lit("increases")).otherwise(F.lit("decreases"))
    if short:
        full = F.format_string("The model predicted %s. The strongest influences were %s, %s. "
                               "In short: %s %s the chance and %s %s the chance.",
                               pred_label, f1, f2, f1, d1, f2, d2)
        fallback = F.format_string("The model predicted %s.", pred_label)
    else:
        full = F.format_string("The model predicted %s (prob %.2f). The strongest influences were %s, %s. "
                               "In short: %s %s the chance and %s %s the chance.",
                               pred_label, prob, f1, f2, f1, d1, f2, d2)
        fallback = F.format_string("Model predicted %s with probability %.2f.", pred_label, prob)
    return F.when(f2.isNull(), fallback).otherwise(full)


def explain_rows(top: DataFrame, preds: DataFrame, id_col: str = "id") -> DataFrame:
    """I13 over a top-k table: one full and one short sentence per row.
    ``preds`` holds (id, label_text, prob)."""
    first = top.where(F.col("rank") == 1).select(id_col, F.col("feature").alias("f1"), F.col("value").alias("v1"))
    second = top.where(F.col("rank") == 2).select(id_col, F.col("feature").alias("f2"), F.col("value").alias("v2"))
    j = preds.join(first, id_col, "left").join(second, id_col, "left")
    return j.select(id_col,
                    sentence(F.col("label_text"), F.col("prob"), F.col("f1"), F.col("v1"), F.col("f2"),
                             F.col("v2")).alias("eli5"),
                    sentence(F.col("label_text"), F.col("prob"), F.col("f1"), F.col("v1"), F.col("f2"),
                             F.col("v2"), short=True).alias("eli5_short"))


def first_row(df: DataFrame, id_col: str = "id") -> DataFrame:
    """K6: the first row by id (per-partition top-1, then merge)."""
    return df.orderBy(id_col).limit(1)
