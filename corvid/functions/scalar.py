"""Scalar column functions (I1-I19).  All are built-in expressions, so they
are evaluated JVM-side inside whole-stage codegen.

Fixed values: luminosity reference temperature 5778; ratio epsilon 1e-6;
class threshold 0.5 (strict); label texts PLANET / NOT_PLANET and
EXOPLANET / FALSE_POSITIVE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUN_TEFF = 5778.0
RATIO_EPS = 1e-6
THRESHOLD = 0.5


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c) -> Column:
    """Text or number -> double; non-numeric text and NaN -> null."""
    v = F.trim(_c(c).cast("string")).try_cast("double")
    return F.when(~F.isnan(v), v)


def finite_or_null(c) -> Column:
    """NaN and +-infinity -> null."""
    v = _c(c).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def nan_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Ingest rule: one missing value (NULL); NaN is converted once."""
    from pyspark.sql.types import DoubleType, FloatType
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.select(*[(F.when(~F.isnan(F.col(c)), F.col(c)).alias(c) if c in cols else F.col(c))
                       for c in df.columns])


def log1p_feature(c) -> Column:
    """log(1 + x); null where x <= -1 (no -inf / NaN)."""
    return F.log1p(_c(c))


def ratio_feature(num, den) -> Column:
    """Num / (den + 1e-6); null instead of infinity on a zero divisor."""
    return F.try_divide(_c(num), _c(den) + F.lit(RATIO_EPS))


def product_feature(a, b) -> Column:
    """I7."""
    return _c(a) * _c(b)


def luminosity(st_rad, st_teff) -> Column:
    """I8: st_rad^2 * (st_teff / 5778)^4."""
    return F.pow(_c(st_rad), 2) * F.pow(_c(st_teff) / F.lit(SUN_TEFF), 4)


def engineer_features(df: DataFrame) -> DataFrame:
    """I5-I8 added when their inputs exist."""
    cols = set(df.columns)
    out = df
    for name, src in (("log_period", "period"), ("log_duration", "duration"), ("log_depth", "depth")):
        if src in cols:
            out = out.withColumn(name, log1p_feature(src))
    if {"period", "duration"} <= cols:
        out = out.withColumn("period_duration_ratio", ratio_feature("period", "duration"))
    if {"depth", "prad"} <= cols:
        out = out.withColumn("depth_prad_product", product_feature("depth", "prad"))
    if {"st_teff", "st_rad"} <= cols:
        out = out.withColumn("stellar_luminosity", luminosity("st_rad", "st_teff"))
    return out


def threshold_class(score, threshold: float = THRESHOLD) -> Column:
    """class = score > threshold (strict)."""
    return (_c(score) > F.lit(threshold)).cast("int")


def round_half_even(c) -> Column:
    """0.5 -> 0, 1.5 -> 2."""
    return F.rint(_c(c))


def planet_text(cls) -> Column:
    """I12 (API form)."""
    return F.when(_c(cls) == 1, F.lit("PLANET")).otherwise(F.lit("NOT_PLANET"))


def exoplanet_text(cls) -> Column:
    """I12 (detector form)."""
    return F.when(_c(cls) == 1, F.lit("EXOPLANET")).otherwise(F.lit("FALSE_POSITIVE"))


def format_pct(c) -> Column:
    """Two decimals and a percent sign, or N/A."""
    return F.when(_c(c).isNotNull() & ~F.isnan(_c(c)),
                  F.format_string("%.2f%%", _c(c) * 100)).otherwise(F.lit("N/A"))


def label_to_int(c) -> Column:
    """Numeric text -> int; blank, null, NaN, text or out of range -> 0."""
    return F.coalesce(F.trim(_c(c).cast("string")).try_cast("double").try_cast("int"), F.lit(0))


def blank_to_zero(c) -> Column:
    """Empty form value -> 0.0."""
    return F.coalesce(to_number(c), F.lit(0.0))


def per_sample_ms(total_seconds, rows) -> Column:
    """I16: total time / rows * 1000."""
    return F.try_divide(_c(total_seconds), _c(rows).cast("double")) * F.lit(1000.0)


def flops_estimate(model, n_train, n_test, n_features) -> Column:
    """Closed-form work estimate per model name (exact names).

    Fixed values:
      Logistic Regression                  n_features * 2 * n_test
      Random Forest, XGBoost,
      HistGradientBoosting, Gradient Boosting   10 * n_features * 100 * n_test
      CatBoost                             6 * n_features * 100 * n_test
      Support Vector Machine               n_train * n_features * n_test
      K-Nearest Neighbors                  n_train * n_features * n_test * 5
      Decision Tree                        15 * n_features * n_test
      AdaBoost                             1 * n_features * 100 * n_test
      Naive Bayes                          n_features * n_test
      anything else                        0
    """
    m = _c(model)
    nt, ns, nf = (_c(n_train).cast("long"), _c(n_test).cast("long"), _c(n_features).cast("long"))
    return (F.when(m == "Logistic Regression", nf * 2 * ns)
            .when(m.isin("Random Forest", "XGBoost", "HistGradientBoosting", "Gradient Boosting"),
                  F.lit(10) * nf * 100 * ns)
            .when(m == "CatBoost", F.lit(6) * nf * 100 * ns)
            .when(m == "Support Vector Machine", nt * nf * ns)
            .when(m == "K-Nearest Neighbors", nt * nf * ns * 5)
            .when(m == "Decision Tree", F.lit(15) * nf * ns)
            .when(m == "AdaBoost", F.lit(1) * nf * 100 * ns)
            .when(m == "Naive Bayes", nf * ns)
            .otherwise(F.lit(0))).cast("long")
