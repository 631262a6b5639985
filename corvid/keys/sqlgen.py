"""Small helpers shared by the Spark side and the SQL oracle side of keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sig_sql(x: str, digits: int = 9) -> str:
    """SQL text (valid in Spark SQL and DuckDB) rounding ``x`` to ``digits``
    significant digits; used for large-magnitude aggregates whose last bits
    depend on the summation order."""
    e = f"floor(log10(abs({x})))"
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} = 0 THEN 0.0 "
            f"ELSE round({x} / power(10, {e}), {digits - 1}) * power(10, {e}) END)")


def sig(c: Column | str, digits: int = 9) -> Column:
    """Spark side of ``sig_sql`` (same expression text)."""
    name = c if isinstance(c, str) else None
    if name is None:
        raise TypeError("pass a column name")
    return F.expr(sig_sql(f"`{name}`", digits))


def unpivot_sql(cols: list[str], expr_fmt: str, table: str, value: str) -> str:
    """One-row-per-column stats as UNION ALL of single-column aggregates."""
    parts = [f"SELECT '{c}' AS feature, {i} AS position, {expr_fmt.format(c=c)} AS {value} FROM {table}"
             for i, c in enumerate(cols)]
    return "\nUNION ALL\n".join(parts)
