"""Label column discovery (B5) and the five label policies.

Every policy is a single Column expression (no Python UDF), so it stays inside
whole-stage codegen.

Fixed values that must equal the original pipelines (text maps and the
name lists used to find a label column):

* general  : numeric 0/1 kept; else 0 when the upper-cased text contains
             ``FALSE``, contains `` FP`` or trims to ``FP``; else 1; null -> null
* contains : 1 when upper text contains ``CONFIRMED`` or ``CANDIDATE`` else 0
* in       : 1 when text is exactly ``CANDIDATE`` or ``CONFIRMED`` else 0
* strict   : upper text mapped by {CANDIDATE: 1, CONFIRMED: 1, FALSE POSITIVE: 0},
             other values -> null
* replace  : upper text replaced by a per-source map, unmapped text kept
    koi: CANDIDATE 1, CONFIRMED 1, FALSE POSITIVE 0, FALSE_POSITIVE 0
    toi: PC 1, KP 1, CONFIRMED 1, CANDIDATE 1, FP 0, FALSE POSITIVE 0
    k2 : CANDIDATE 1, CONFIRMED 1, FALSE POSITIVE 0, FALSE_POSITIVE 0, FALSE_POSITIVE? 0
* label column by name: first column whose lower-cased name contains
  ``disposition`` or ``status``; preference list
  koi_disposition, koi_pdisposition, exo_disposition
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
LABEL_NAME_HINTS = ("disposition", "status")
LABEL_PREFERENCE = ("koi_disposition", "koi_pdisposition", "exo_disposition")
STRICT_MAP = {"CANDIDATE": 1, "CONFIRMED": 1, "FALSE POSITIVE": 0}
REPLACE_MAPS = {
    "koi": {"CANDIDATE": 1, "CONFIRMED": 1, "FALSE POSITIVE": 0, "FALSE_POSITIVE": 0},
    "toi": {"PC": 1, "KP": 1, "CONFIRMED": 1, "CANDIDATE": 1, "FP": 0, "FALSE POSITIVE": 0},
    "k2": {"CANDIDATE": 1, "CONFIRMED": 1, "FALSE POSITIVE": 0, "FALSE_POSITIVE": 0,
           "FALSE_POSITIVE?": 0},
}
IN_VALUES = ("CANDIDATE", "CONFIRMED")
# -----------------------------------------------------------------------------


def find_label_column(df: DataFrame, preference: tuple | list | None = None) -> str | None:
    """Metadata-only lookup of the label column."""
    if preference:
        for name in preference:
            if name in df.columns:
                return name
        return None
    for name in df.columns:
        low = name.lower()
        if any(h in low for h in LABEL_NAME_HINTS):
            return name
    return None


def _map_expr(text: Column, mapping: dict, default: Column) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = (F.when(text == k, F.lit(v)) if expr is None else expr.when(text == k, F.lit(v)))
    return expr.otherwise(default) if expr is not None else default


def label_general(c: Column) -> Column:
    s = c.cast("string")
    num = F.trim(s).try_cast("double")
    up = F.upper(s)
    is_zero = up.contains("FALSE") | up.contains(" FP") | (F.trim(up) == "FP")
    return (F.when(c.isNull(), F.lit(None).cast("int"))
            .when(num.isin(0.0, 1.0), num.cast("int"))
            .when(is_zero, F.lit(0))
            .otherwise(F.lit(1)))


def label_contains(c: Column) -> Column:
    up = F.upper(F.coalesce(c.cast("string"), F.lit("NAN")))
    return F.when(up.contains("CONFIRMED") | up.contains("CANDIDATE"), F.lit(1)).otherwise(F.lit(0))


def label_in(c: Column) -> Column:
    return F.when(c.cast("string").isin(*IN_VALUES), F.lit(1)).otherwise(F.lit(0))


def label_strict(c: Column) -> Column:
    up = F.upper(c.cast("string"))
    return _map_expr(up, STRICT_MAP, F.lit(None).cast("int")).cast("int")


def label_replace(c: Column, source: str = "koi") -> Column:
    """Text result: '1' / '0' for mapped values, the upper-cased text
    otherwise ('NAN' for null), as a pandas replace on ``astype(str)`` gives."""
    up = F.upper(F.coalesce(c.cast("string"), F.lit("nan")))
    mapping = {k: str(v) for k, v in REPLACE_MAPS[source].items()}
    return _map_expr(up, mapping, up)


POLICIES = {
    "general": label_general,
    "contains": label_contains,
    "in": label_in,
    "strict": label_strict,
}


def map_label(df: DataFrame, source_col: str, policy: str = "general",
              out_col: str = "label", source: str = "koi") -> DataFrame:
    """One operator, five policies."""
    if policy == "replace":
        return df.withColumn(out_col, label_replace(F.col(source_col), source))
    return df.withColumn(out_col, POLICIES[policy](F.col(source_col)).cast("int"))


def binary_filter(df: DataFrame, col: str = "label") -> DataFrame:
    """Keep rows whose label is 0 or 1 (text labels cast first)."""
    as_int = F.col(col).cast("string").try_cast("int")
    return df.where(as_int.isin(0, 1)).withColumn(col, as_int)
