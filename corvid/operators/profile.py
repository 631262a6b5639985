"""Profiling aggregates.

Every profile is a single aggregation pass over all columns (partial
aggregation on the map side; the result is one row per column or class),
unpivoted to long form.  Exact quantiles use the bracketing selection in
``corvid.operators.quantiles`` instead of a global exact percentile buffer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvid.operators.quantiles import exact_quantiles
from corvid.operators.select import _to_long

N_HIST_BINS = 20


def value_counts(df: DataFrame, col: str = "label") -> DataFrame:
    """Rows per value, nulls included."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))


def class_share(df: DataFrame, col: str = "label") -> DataFrame:
    """Count and percentage per class.  The window runs over the tiny
    aggregated table (one row per class), not over the data."""
    counts = value_counts(df, col)
    total = F.sum("count").over(Window.partitionBy())
    return counts.withColumn("pct", F.round(F.col("count") * 100.0 / total, 4))


def class_ratio(df: DataFrame, col: str = "label") -> DataFrame:
    """D3: negatives per positive (null when there is no positive)."""
    neg = F.count_if(F.col(col) == 0)
    pos = F.count_if(F.col(col) == 1)
    return df.agg(neg.alias("n_neg"), pos.alias("n_pos"),
                  F.round(F.try_divide(neg.cast("double"), pos.cast("double")), 4).alias("ratio"))


def null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(feature, position, nulls) for every column, one pass."""
    cols = cols or df.columns
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return _to_long(row, cols, "nulls").withColumn("nulls", F.col("nulls").cast("long"))


def missing_pct(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Percentage of nulls per column."""
    cols = cols or df.columns
    n = F.count(F.lit(1))
    row = df.agg(*[(F.count_if(F.col(c).isNull()) * 100.0 / n).alias(c) for c in cols])
    return _to_long(row, cols, "missing_pct").withColumn("missing_pct", F.round("missing_pct", 4))


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, mean, sample std, min, exact 25/50/75 %, max per column."""
    aggs = []
    for c in cols:
        v = F.col(c).cast("double")
        aggs += [F.count(v).alias(f"{c}__count"), F.avg(v).alias(f"{c}__mean"),
                 F.stddev_samp(v).alias(f"{c}__std"), F.min(v).alias(f"{c}__min"),
                 F.max(v).alias(f"{c}__max")]
    row = df.agg(*aggs).first()
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    rows = []
    for i, c in enumerate(cols):
        rows.append((c, i, int(row[f"{c}__count"]), row[f"{c}__mean"], row[f"{c}__std"],
                     row[f"{c}__min"], q[(c, 0.25)], q[(c, 0.5)], q[(c, 0.75)], row[f"{c}__max"]))
    schema = ("feature string, position int, count long, mean double, std double, min double, "
              "p25 double, p50 double, p75 double, max double")
    out = df.sparkSession.createDataFrame(rows, schema)
    return out.select("feature", "position", "count",
                      *[F.round(x, 4).alias(x) for x in ("mean", "std", "min", "p25", "p50", "p75", "max")])


def histogram(df: DataFrame, cols: list[str], bins: int = N_HIST_BINS) -> DataFrame:
    """Equal-width bins on [min, max] per column; the last bin includes
    the maximum.  Long output (feature, bin, count); constant columns put all
    values in bin 0.  The bounds are one small aggregate row, applied as
    literals (no join)."""
    bounds = df.agg(*[F.min(F.col(c).cast("double")).alias(f"{c}__lo") for c in cols],
                    *[F.max(F.col(c).cast("double")).alias(f"{c}__hi") for c in cols]).first()
    items = []
    for c in cols:
        lo, hi = bounds[f"{c}__lo"], bounds[f"{c}__hi"]
        v = F.col(c).cast("double")
        if lo is None:
            b = F.lit(None).cast("int")
        elif hi > lo:
            b = F.least(F.floor((v - F.lit(lo)) / F.lit(hi - lo) * bins), F.lit(bins - 1)).cast("int")
        else:
            b = F.lit(0)
        items.append(F.struct(F.lit(c).alias("feature"), F.when(v.isNotNull(), b).alias("bin")))
    long = df.select(F.explode(F.array(*items)).alias("s")).select("s.*").where(F.col("bin").isNotNull())
    return long.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("count"))


def _moments(cols: list[str]):
    """Per task one row per pair of columns: rows that have both, their means, squared
    deviations and co-deviation.  Blocks are summed as matrix products of values
    relative to the task's first ones, so a constant column deviates by exactly 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(cols)
        n, sx, sxx, sxy = (np.zeros((k, k)) for _ in range(4))     # of the row's column, where the other is there too
        base = np.full(k, np.nan)
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.float64)
            x[~np.isfinite(x)] = np.nan
            for i in np.flatnonzero(np.isnan(base)):
                some = x[~np.isnan(x[:, i]), i]
                base[i] = some[0] if len(some) else np.nan
            there = (~np.isnan(x)).astype(np.float64)
            x = np.nan_to_num(x - base)
            n += there.T @ there
            sx += x.T @ there
            sxx += (x * x).T @ there
            sxy += x.T @ x
        a, b = np.triu_indices(k, 1)
        some = n[a, b] > 0
        a, b = a[some], b[some]
        m, s_a, s_b = n[a, b], sx[a, b], sx[b, a]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v) for v in (a.astype(np.int32), b.astype(np.int32), m, base[a] + s_a / m, base[b] + s_b / m,
                                   sxx[a, b] - s_a * s_a / m, sxx[b, a] - s_b * s_b / m, sxy[a, b] - s_a * s_b / m)],
            ["a", "b", "n", "mx", "my", "xx", "yy", "xy"])
    return run


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation on pairwise complete rows, long form, one pass.

    A task returns one small row per pair, however many rows it has read; these are
    merged pair by pair (a pair's list has one entry per task).  NaN and infinite
    values count as missing; a pair without two different values on both sides has
    no correlation."""
    numbers = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    parts = numbers.mapInArrow(_moments(cols), "a int, b int, n double, mx double, my double, xx double, yy double, xy double")
    fields = ["n", "mx", "my", "xx", "yy", "xy"]

    def merge(s, t):
        n, dx, dy = s["n"] + t["n"], t["mx"] - s["mx"], t["my"] - s["my"]
        w = s["n"] * t["n"] / n
        return F.struct(n.alias("n"), (s["mx"] + dx * (t["n"] / n)).alias("mx"), (s["my"] + dy * (t["n"] / n)).alias("my"),
                        (s["xx"] + t["xx"] + dx * dx * w).alias("xx"), (s["yy"] + t["yy"] + dy * dy * w).alias("yy"),
                        (s["xy"] + t["xy"] + dx * dy * w).alias("xy"))

    zero = F.struct(*[F.lit(0.0).alias(f) for f in fields])
    whole = (parts.groupBy("a", "b").agg(F.collect_list(F.struct(*fields)).alias("p"))
             .select("a", "b", F.aggregate("p", zero, merge).alias("m")))
    names = F.array(*[F.lit(c) for c in cols])
    corr = F.when((F.col("m.xx") > 0) & (F.col("m.yy") > 0), F.col("m.xy") / F.sqrt("m.xx") / F.sqrt("m.yy"))
    pairs = df.sparkSession.createDataFrame([(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))], "a int, b int")
    return (pairs.join(whole, ["a", "b"], "left")
            .select(names[F.col("a")].alias("feature_a"), names[F.col("b")].alias("feature_b"),
                    F.round(corr, 4).alias("corr")))


def shape(df: DataFrame) -> DataFrame:
    """Rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)).cast("long"))


def head_n(df: DataFrame, n: int = 5, order_col: str = "id") -> DataFrame:
    """First n rows by id (TakeOrderedAndProject: per-partition top-n)."""
    return df.orderBy(order_col).limit(n)


def source_rollup(df: DataFrame, source_col: str = "source", label_col: str = "label") -> DataFrame:
    """Rows and label counts per source plus the total (rollup)."""
    return (df.rollup(source_col)
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.count_if(F.col(label_col) == 1).alias("n_pos"),
                 F.count_if(F.col(label_col) == 0).alias("n_neg"))
            .withColumn(source_col, F.coalesce(F.col(source_col), F.lit("ALL"))))


def fold_summary(folds: DataFrame, metric_cols: list[str]) -> DataFrame:
    """Mean and population std of each metric over folds, long form."""
    aggs = []
    for m in metric_cols:
        aggs += [F.avg(m).alias(f"{m}__mean"), F.stddev_pop(m).alias(f"{m}__std")]
    row = folds.agg(*aggs)
    packed = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}__mean").alias("mean"),
                                F.col(f"{m}__std").alias("std")) for m in metric_cols])
    return (row.select(F.explode(packed).alias("s")).select("s.*")
            .select("metric", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std")))
