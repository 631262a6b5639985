"""Row filters and feature selection.

Selections are decided from ONE aggregation pass over all candidate
columns (Catalyst does not merge separate actions), then applied as a
projection, so the scan only reads the kept columns downstream.

Fixed values: the exclusion patterns, safe prefixes and priority list of the
original pipelines, listed below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from corvid.functions.labels import binary_filter  # noqa: F401  (B7 re-export)

# --- fixed values -------------------------------------------------------------
EXCLUDE_PATTERNS = ["kepoi", "kepid", "name", "id", "rowid", "score", "fpflag",
                    "disposition", "comment", "datalink", "pdisposition"]
SAFE_PREFIXES = ["koi_period", "koi_time0bk", "koi_impact", "koi_duration", "koi_depth",
                 "koi_prad", "koi_teq", "koi_insol", "koi_model_snr", "koi_steff",
                 "koi_slogg", "koi_srad", "ra", "dec", "koi_kepmag"]
PRIORITY_FEATURES = ["koi_period", "koi_duration", "koi_depth", "koi_prad", "koi_teq",
                     "koi_insol", "koi_model_snr", "koi_steff", "koi_slogg", "koi_srad",
                     "koi_impact", "koi_time0bk", "koi_time0", "koi_eccen", "koi_longp",
                     "koi_trans_depth", "koi_ror", "koi_dor", "koi_incl", "koi_limbdark_mod"]
API_EXCLUDE = ["binary_label", "kepoi_name", "kepler_name", "kepid", "label"]
# -------------------------------------------------------------------------------


def min_present(df: DataFrame, cols: list[str], thresh: int = 2) -> DataFrame:
    """Keep rows with at least ``thresh`` non-null values in ``cols``."""
    return df.na.drop(thresh=thresh, subset=cols)


def drop_any_null(df: DataFrame, cols: list[str]) -> DataFrame:
    """B9."""
    return df.na.drop(how="any", subset=cols)


def exclude_cols(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop the named columns that exist (absent names ignored)."""
    return df.drop(*[n for n in names if n and n in df.columns])


def numeric_cols(df: DataFrame, exclude: tuple | list = ()) -> list[str]:
    """Numeric columns by type (metadata only)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]


def present_fractions(df: DataFrame, cols: list[str]) -> DataFrame:
    """One pass: (feature, present_frac) for every column."""
    n = F.count(F.lit(1))
    row = df.agg(*[(F.count(F.col(c)) / n).alias(c) for c in cols])
    return _to_long(row, cols, "present_frac")


def _to_long(one_row: DataFrame, cols: list[str], value: str) -> DataFrame:
    """Unpivot a one-row stats frame to (feature, position, value)."""
    packed = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(i).alias("position"),
                                F.col(c).cast("double").alias(value)) for i, c in enumerate(cols)])
    return one_row.select(F.explode(packed).alias("s")).select("s.*")


def select_safe(df: DataFrame, candidates: list[str] | None = None,
                exclude_patterns=EXCLUDE_PATTERNS, safe_prefixes=SAFE_PREFIXES,
                min_frac: float = 0.5) -> DataFrame:
    """B12 decision table: (feature, position, present_frac, kept).

    A numeric column is kept when no exclude pattern occurs in its lower-cased
    name, it starts with a safe prefix, and at least ``min_frac`` of its
    values are present."""
    cands = candidates or numeric_cols(df)
    stats = present_fractions(df, cands)
    low = F.lower(F.col("feature"))
    excluded = F.lit(False)
    for p in exclude_patterns:
        excluded = excluded | low.contains(p)
    safe = F.lit(False)
    for p in safe_prefixes:
        safe = safe | low.startswith(p)
    kept = (~excluded & safe & (F.col("present_frac") >= min_frac)).cast("int")
    return stats.withColumn("kept", kept)


def select_priority(df: DataFrame, priority=PRIORITY_FEATURES, max_missing_pct: float = 80.0,
                    fallback_n: int = 20, min_features: int = 3,
                    target: str = "target") -> list[str]:
    """Priority names with < 80 % missing; fall back to the first 20
    numeric columns; refuse under 3."""
    present = [c for c in priority if c in df.columns]
    chosen: list[str] = []
    if present:
        stats = {r["feature"]: r["present_frac"] for r in present_fractions(df, present).collect()}
        chosen = [c for c in present if (1.0 - (stats[c] or 0.0)) * 100 < max_missing_pct]
    if len(chosen) < min_features:
        nums = [c for c in numeric_cols(df) if c != target]
        if len(nums) < min_features:
            raise ValueError("Not enough numeric features.")
        chosen = nums[:min(fallback_n, len(nums))]
    return chosen


def priority_table(df: DataFrame, priority=PRIORITY_FEATURES,
                   max_missing_pct: float = 80.0) -> DataFrame:
    """B13 decision table: (feature, position, missing_pct, kept)."""
    present = [c for c in priority if c in df.columns]
    stats = present_fractions(df, present)
    miss = F.round((F.lit(1.0) - F.col("present_frac")) * 100, 4)
    return (stats.select("feature", "position", miss.alias("missing_pct"))
            .withColumn("kept", ((F.lit(1.0) - F.col("missing_pct") / 100) * 100 < F.lit(max_missing_pct))
                        .cast("int")))


def variances(df: DataFrame, cols: list[str], kind: str = "pop") -> DataFrame:
    """One pass: (feature, position, variance)."""
    fn = F.var_pop if kind == "pop" else F.var_samp
    row = df.agg(*[fn(F.col(c)).alias(c) for c in cols])
    return _to_long(row, cols, "variance")


def variance_filter(df: DataFrame, cols: list[str]) -> DataFrame:
    """B14 decision table: keep columns with population variance > 0."""
    v = variances(df, cols, "pop")
    return v.withColumn("kept", (F.coalesce(F.col("variance"), F.lit(0.0)) > 0).cast("int"))


def top_variance(df: DataFrame, cols: list[str], k: int = 30) -> DataFrame:
    """The k columns of largest sample variance (ties by position)."""
    v = variances(df, cols, "samp")
    return v.orderBy(F.desc_nulls_last("variance"), "position").limit(k)


def align_features(df: DataFrame, names: list[str], keep: list[str] = ()) -> DataFrame:
    """Trained names in order; absent ones as 0.0; extras dropped."""
    have = set(df.columns)
    return df.select(*[F.col(k) for k in keep if k in have],
                     *[(F.col(n).cast("double") if n in have else F.lit(0.0)).alias(n) for n in names])


def has_min_rows(df: DataFrame, n: int) -> bool:
    """At least ``n`` rows, reading no more than n."""
    return df.limit(n).count() >= n
