"""Deterministic pseudo-random keys.

Spark has no row order, so every sampling, split or draw is keyed by an md5
of ``seed|id``.  The same key is expressible in DuckDB, which is what lets
the oracle reproduce every split row for row:

    Spark : conv(substr(md5(s), 1, 8), 16, 10)  -> bigint
    DuckDB: ('0x' || substr(md5(s), 1, 8))::BIGINT
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_md5(seed, *parts) -> Column:
    """Hex md5 of ``seed|part1|part2...`` (parts are columns or names)."""
    items = [F.lit(str(seed))]
    for p in parts:
        items.append(F.lit("|"))
        c = F.col(p) if isinstance(p, str) else p
        items.append(c.cast("string"))
    return F.md5(F.concat(*items))


def md5_number(hex_col: Column, digits: int = 8) -> Column:
    """First ``digits`` hex characters of an md5 as a non-negative bigint."""
    return F.conv(F.substring(hex_col, 1, digits), 16, 10).cast("bigint")


def md5_unit(hex_col: Column) -> Column:
    """Uniform number in [0, 1) from the first 8 hex characters."""
    return md5_number(hex_col, 8).cast("double") / F.lit(4294967296.0)
