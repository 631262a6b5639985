"""Preparation: impute, scale, class weights, split, folds, balancing
(F1-F9, F11-F13).

Fitting returns small Python dicts (one value per column or class); applying
them is a narrow projection with literals, so no join and no shuffle is
added to the data path.  Every pseudo-random choice is an md5 of
``seed|...`` and every per-class rank uses the salted ``class_rank``.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.functions.hashing import md5_number, seeded_md5
from corvid.operators.quantiles import exact_quantiles
from corvid.operators.ranking import bucket_counts, class_rank, totals

DEFAULT_SEED = 42


# --- F1 median imputation ----------------------------------------------------
def fit_median(df: DataFrame, cols: list[str]) -> dict:
    """Medians of the given (train) rows; all-null columns are left out, so
    names travel with the values (no positional misalignment)."""
    q = exact_quantiles(df, cols, [0.5])
    return {c: q[(c, 0.5)] for c in cols if q[(c, 0.5)] is not None}


def apply_fill(df: DataFrame, values: dict) -> DataFrame:
    return df.na.fill({k: float(v) for k, v in values.items()})


def impute_median(train: DataFrame, df: DataFrame, cols: list[str]) -> tuple[DataFrame, list[str]]:
    """Fit on ``train``, fill ``df``; returns (filled df, kept feature names)."""
    med = fit_median(train, cols)
    kept = [c for c in cols if c in med]
    return apply_fill(df, med), kept


# --- F2 / F3 scaling ------------------------------------------------------------
def fit_standard(df: DataFrame, cols: list[str]) -> dict:
    """Mean and population std per column (NaN counts as missing); zero std ->
    divisor 1."""
    v = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in cols}
    row = df.agg(*[F.avg(v[c]).alias(f"{c}__m") for c in cols],
                 *[F.stddev_pop(v[c]).alias(f"{c}__s") for c in cols]).first()
    out = {}
    for c in cols:
        s = row[f"{c}__s"]
        out[c] = (row[f"{c}__m"] or 0.0, s if s else 1.0)
    return out


def fit_robust(df: DataFrame, cols: list[str]) -> dict:
    """Median and exact inter-quartile range; zero range -> divisor 1."""
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    out = {}
    for c in cols:
        med = q[(c, 0.5)] or 0.0
        iqr = (q[(c, 0.75)] or 0.0) - (q[(c, 0.25)] or 0.0)
        out[c] = (med, iqr if iqr else 1.0)
    return out


def apply_scale(df: DataFrame, params: dict) -> DataFrame:
    cols = [((F.col(c) - F.lit(params[c][0])) / F.lit(params[c][1])).alias(c) if c in params else F.col(c)
            for c in df.columns]
    return df.select(*cols)


# --- F4 class weights ------------------------------------------------------------
def class_counts_local(df: DataFrame, label_col: str = "label") -> dict:
    """Rows per class, fetched to the driver: one row per class (bounded by
    the number of classes, not by the data)."""
    return {r[0]: r[1] for r in df.groupBy(label_col).count().collect()}


def balanced_weights(counts: dict) -> dict | None:
    """n / (k * n_c); None when fewer than two classes are present."""
    present = {k: v for k, v in counts.items() if k is not None and v}
    if len(present) < 2:
        return None
    n = sum(present.values())
    k = len(present)
    return {c: n / (k * v) for c, v in present.items()}


def with_class_weight(df: DataFrame, label_col: str = "label", weight_col: str = "weight") -> DataFrame:
    w = balanced_weights(class_counts_local(df, label_col))
    if w is None:
        return df.withColumn(weight_col, F.lit(None).cast("double"))
    expr = None
    for c, v in w.items():
        expr = F.when(F.col(label_col) == c, F.lit(v)) if expr is None else expr.when(F.col(label_col) == c, F.lit(v))
    return df.withColumn(weight_col, expr)


# --- F5 / F6 / F7 split and folds ---------------------------------------------------
def test_quotas(counts: dict, test_size: float) -> dict:
    """Per-class test rows: total ceil(n * size), shared by largest remainder
    (ties to the smaller class value)."""
    n = sum(counts.values())
    n_test = int(math.ceil(test_size * n))
    base = {c: (n_test * k) // n for c, k in counts.items()}
    rem = sorted(counts, key=lambda c: (-((n_test * counts[c]) % n), c))
    for c in rem[: n_test - sum(base.values())]:
        base[c] += 1
    return base


def _quota_col(label_col: str, quotas: dict):
    expr = None
    for c, q in quotas.items():
        expr = (F.when(F.col(label_col) == c, F.lit(q)) if expr is None
                else expr.when(F.col(label_col) == c, F.lit(q)))
    return expr.otherwise(F.lit(0))


def stratified_split(df: DataFrame, label_col: str = "label", id_col: str = "id",
                     test_size: float = 0.2, seed=DEFAULT_SEED, split_col: str = "split",
                     names: tuple = ("train", "test")) -> DataFrame:
    """the first quota rows of each class in md5(seed|id) order are test.
    Rows without a label belong to no class and leave."""
    keyed = df.where(F.col(label_col).isNotNull()).withColumn("_k", seeded_md5(seed, id_col))
    bc = bucket_counts(keyed, label_col, "_k")          # one bounded pass: classes x buckets
    quotas = test_quotas(totals(bc), test_size)
    ranked = class_rank(keyed, label_col, "_k", id_col, "_r", counts=bc)
    out = ranked.withColumn(split_col, F.when(F.col("_r") <= _quota_col(label_col, quotas), F.lit(names[1]))
                            .otherwise(F.lit(names[0])))
    return out.drop("_k", "_r")


def split_three_way(df: DataFrame, label_col: str = "label", id_col: str = "id",
                    test_size: float = 0.15, val_size: float = 0.15, seed=DEFAULT_SEED) -> DataFrame:
    """test first, then val from the rest with ratio val / (1 - test)."""
    first = stratified_split(df, label_col, id_col, test_size, seed, "_s1")
    rest = first.where(F.col("_s1") == "train")
    second = stratified_split(rest, label_col, id_col, val_size / (1.0 - test_size),
                              f"{seed}v", "_s2", ("train", "val"))
    test = first.where(F.col("_s1") == "test").withColumn("split", F.lit("test")).drop("_s1")
    return second.withColumn("split", F.col("_s2")).drop("_s1", "_s2").unionByName(test)


def kfold(df: DataFrame, k: int = 5, label_col: str = "label", id_col: str = "id",
          seed=DEFAULT_SEED, fold_col: str = "fold") -> DataFrame:
    """stratified folds, fold = (rank in class - 1) mod k.  Rows without a
    label leave."""
    keyed = df.where(F.col(label_col).isNotNull()).withColumn("_k", seeded_md5(seed, id_col))
    ranked = class_rank(keyed, label_col, "_k", id_col, "_r")
    return ranked.withColumn(fold_col, ((F.col("_r") - 1) % k).cast("int")).drop("_k", "_r")


# --- F8 / F9 balancing ------------------------------------------------------------------
def undersample(df: DataFrame, label_col: str = "label", id_col: str = "id",
                seed=DEFAULT_SEED) -> DataFrame:
    """F8: every class cut to the smallest class size; < 2 classes unchanged.
    Adds ``order_key`` (F11: the shuffled order is a hash, not a row order)."""
    df = df.where(F.col(label_col).isNotNull())
    keyed = df.withColumn("_k", seeded_md5(seed, id_col))
    bc = bucket_counts(keyed, label_col, "_k")
    counts = totals(bc)
    if len(counts) < 2:
        return df
    m = min(counts.values())
    ranked = class_rank(keyed, label_col, "_k", id_col, "_r", counts=bc)
    return (ranked.where(F.col("_r") <= m).withColumn("order_key", seeded_md5(f"{seed}s", id_col))
            .drop("_k", "_r"))


def oversample(df: DataFrame, label_col: str = "label", id_col: str = "id",
               seed=DEFAULT_SEED) -> DataFrame:
    """every class drawn with replacement up to the largest class size.

    Draw j (1..N) of class c takes the row of rank md5(seed|c|j) mod n_c + 1.
    The draw numbers are generated by the rows themselves (row r of class c
    emits r, r + n_c, r + 2 n_c, ... <= N), so no task generates a whole
    class; the draws are fetched by an equi-join on the unique (class, rank).
    Output: the source columns plus ``draw`` and ``src_id``."""
    df = df.where(F.col(label_col).isNotNull())
    keyed = df.withColumn("_k", seeded_md5(seed, id_col))
    bc = bucket_counts(keyed, label_col, "_k")
    counts = totals(bc)
    if len(counts) < 2:
        return df
    big = max(counts.values())
    ncol = None
    for c, k in counts.items():
        ncol = F.when(F.col(label_col) == c, F.lit(k)) if ncol is None else ncol.when(F.col(label_col) == c, F.lit(k))
    ranked = class_rank(keyed, label_col, "_k", id_col, "_r", counts=bc).drop("_k").withColumn("_n", ncol)
    draws = (ranked.select(label_col, "_n", F.explode(F.sequence(F.col("_r"), F.lit(big).cast("long"),
                                                                   F.col("_n").cast("long"))).alias("draw"))
             .withColumn("_pick", md5_number(seeded_md5(seed, label_col, "draw")) % F.col("_n") + 1)
             .drop("_n"))
    fetched = draws.join(ranked.withColumnRenamed("_r", "_pick").drop("_n"), [label_col, "_pick"], "inner")
    return fetched.withColumnRenamed(id_col, "src_id").drop("_pick")


def balance(df: DataFrame, method: str = "none", features: list[str] | None = None,
            label_col: str = "label", id_col: str = "id", seed=DEFAULT_SEED) -> DataFrame:
    """dispatch; a method that cannot work on its input raises.  SMOTE
    works on rows filled by their medians, and looks for neighbours among
    standardized features."""
    if method == "none":
        return df
    if method == "undersample":
        return undersample(df, label_col, id_col, seed)
    if method == "oversample":
        return oversample(df, label_col, id_col, seed)
    if method == "smote":
        from corvid.operators.neighbors import smote
        medians = fit_median(df, features)
        kept = [c for c in features if c in medians]
        filled = apply_fill(df, medians)
        out = smote(filled, kept, label_col, id_col, seed=seed, scales=fit_standard(filled, kept))
        return out.withColumns({c: F.lit(None).cast("double") for c in features if c not in medians})
    raise ValueError(f"unknown balancing method {method!r}")


# --- F12 assemble ------------------------------------------------------------------------
def assembler(features: list[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="error")
