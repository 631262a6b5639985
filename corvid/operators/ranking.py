"""Skew-safe per-class ranking.

A window ``partitionBy(label).orderBy(key)`` sends each class to one task;
with two classes that is half the table per task.  Here the rank is computed
in (class, salt bucket) windows, where the salt bucket is a prefix of the
md5 order key itself, so the global order (key, id) inside a class equals the
order (bucket, key, id).  Per-bucket counts (at most #classes x 16**digits
rows, independent of the data size) give each bucket its offset; the offsets
table is broadcast.  The result equals the plain window exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# 16**3 = 4096 buckets per class: bounded broadcast of offsets, and at 10^12
# rows about 2.5e8 / 4096 rows per window task per class.
DEFAULT_SALT_DIGITS = 3


def bucket_counts(df: DataFrame, class_col: str, key_col: str,
                  salt_digits: int = DEFAULT_SALT_DIGITS) -> list[tuple]:
    """(class, bucket, rows) fetched to the driver: at most #classes x
    16**salt_digits rows whatever the data size (one map-side combined pass)."""
    b = F.substring(F.col(key_col), 1, salt_digits)
    rows = df.groupBy(F.col(class_col).alias("_c"), b.alias("_b")).agg(F.count(F.lit(1)).alias("_n")).collect()
    return [(r["_c"], r["_b"], r["_n"]) for r in rows]


def totals(counts: list[tuple]) -> dict:
    """Rows per class from ``bucket_counts``."""
    out: dict = {}
    for c, _, n in counts:
        out[c] = out.get(c, 0) + n
    return out


def class_rank(df: DataFrame, class_col: str, key_col: str, id_col: str,
               rank_col: str = "rank", salt_digits: int = DEFAULT_SALT_DIGITS,
               with_count: str | None = None, counts: list[tuple] | None = None) -> DataFrame:
    """Add ``rank_col`` = 1-based position of the row inside its class when
    ordered by (``key_col``, ``id_col``).  ``key_col`` must be an md5 hex
    string (uniform prefix).  Optionally add the class size as ``with_count``.
    ``counts`` (from ``bucket_counts``) saves the counting pass."""
    counts = bucket_counts(df, class_col, key_col, salt_digits) if counts is None else counts
    per_class = totals(counts)
    run: dict = {}
    offsets = []
    for c, bkt, n in sorted(counts, key=lambda x: (str(x[0]), x[1])):
        offsets.append((c, bkt, run.get(c, 0), per_class[c]))
        run[c] = run.get(c, 0) + n
    ctype = df.schema[class_col].dataType.simpleString()
    off = df.sparkSession.createDataFrame(offsets, f"_c {ctype}, _salt_b string, _off long, _cnt long")
    b = "_salt_b"
    salted = df.withColumn(b, F.substring(F.col(key_col), 1, salt_digits))
    local = salted.withColumn(
        "_local_rn",
        F.row_number().over(Window.partitionBy(class_col, b).orderBy(key_col, id_col)),
    )
    # offsets: one row per (class, bucket), bounded, broadcast
    out = local.join(F.broadcast(off), (local[class_col] == off["_c"]) & (local[b] == off[b]), "inner")
    out = out.withColumn(rank_col, (F.col("_off") + F.col("_local_rn")).cast("long"))
    if with_count:
        out = out.withColumn(with_count, F.col("_cnt"))
    return out.drop(b, "_local_rn", "_off", "_c", "_cnt")


def class_counts(df: DataFrame, class_col: str, count_col: str = "n") -> DataFrame:
    """Rows per class (map-side combined aggregate; tiny result)."""
    return df.groupBy(class_col).agg(F.count(F.lit(1)).alias(count_col))
