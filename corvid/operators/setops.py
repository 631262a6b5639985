"""Set operations (H1, H2) and the seen-row anti join (C4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """H1: union by column name, absent columns null.  A column whose type
    differs between inputs is cast to string on every side first (under ANSI
    a string/bigint union would otherwise become bigint and fail on text)."""
    types: dict = {}
    for f in frames:
        for fld in f.schema.fields:
            types.setdefault(fld.name, set()).add(fld.dataType.simpleString())
    conflict = {n for n, t in types.items() if len(t) > 1}
    fixed = [f.select(*[F.col(c).cast(StringType()).alias(c) if c in conflict else F.col(c)
                        for c in f.columns]) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), fixed)


def drop_exact_duplicates(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """H2: whole-row (or key) de-duplication; nulls compare equal.
    Partial aggregation removes most duplicates before the shuffle."""
    return df.dropDuplicates(keys) if keys else df.dropDuplicates()


def row_hash(cols: list[str]):
    """A 64-bit hash of the whole row (nulls hash as null markers)."""
    return F.xxhash64(*[F.col(c) for c in cols])


def anti_join_seen(new: DataFrame, seen: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """C4: rows of ``new`` not already in ``seen`` (whole row, null-safe).
    Joined on a row hash (an equi-join key, so it shuffles by hash) with
    null-safe equality of every column as the residual condition."""
    cols = cols or new.columns
    n = new.withColumn("_h", row_hash(cols))
    # de-duplicate the seen side first (map-side combine), so the build side
    # has one row per key even when one row value holds a third of the table
    s = seen.select(*cols).dropDuplicates().withColumn("_h", row_hash(cols))
    cond = [n["_h"] == s["_h"]] + [n[c].eqNullSafe(s[c]) for c in cols]
    return n.join(s, cond, "left_anti").drop("_h")
