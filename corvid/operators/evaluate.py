"""Evaluation.

Scores are first grouped by distinct value (map-side combined), so a score
value shared by a third of the rows is one row.  Running sums over the
score order never use a single global window: distinct scores are cut into
order-preserving buckets at approximate-quantile boundaries (bounded count),
summed per bucket (tiny table, prefix-summed), and the running sum inside a
bucket is a window partitioned by bucket.  The result is exact.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

N_BUCKETS = 512


def _r4(c):
    return F.round(c, 4)


def running_sums(df: DataFrame, order_col: str, sum_cols: list[str], group_cols: list[str] = (),
                 ascending: bool = True, n_buckets: int = N_BUCKETS, suffix: str = "_cum") -> DataFrame:
    """Inclusive running sums of ``sum_cols`` in ``order_col`` order (rows
    must be unique per (group, order value)); also adds ``_idx``, the 1-based
    position in that order."""
    key = "_ok"
    d = df.withColumn(key, F.col(order_col) if ascending else -F.col(order_col))
    probs = [i / n_buckets for i in range(1, n_buckets)]
    bounds = d.agg(F.percentile_approx(key, probs, 10000).alias("b")).first()["b"] or []
    splits = [float("-inf")] + sorted({float(b) for b in bounds}) + [float("inf")]
    d = Bucketizer(splits=splits, inputCol=key, outputCol="_bk").transform(d)
    cols = list(sum_cols) + ["_one"]
    d = d.withColumn("_one", F.lit(1).cast("long"))
    g = list(group_cols)
    totals = d.groupBy(*g, "_bk").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    before = Window.partitionBy(*g).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*g, "_bk", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}")
                                         for c in cols])
    within = Window.partitionBy(*g, "_bk").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    d = d.select("*", *[F.sum(c).over(within).alias(f"_w_{c}") for c in cols])
    out = d.join(F.broadcast(offsets), [*g, "_bk"], "inner")
    out = out.select(*df.columns, *[(F.col(f"_o_{c}") + F.col(f"_w_{c}")).alias(f"{c}{suffix}")
                                    for c in sum_cols],
                     (F.col("_o__one") + F.col("_w__one")).alias("_idx"))
    return out


def score_groups(df: DataFrame, score: str, label: str, group_cols: list[str] = (), count: str | None = None) -> DataFrame:
    """(group, score, pos, neg) for finite scores; ``count``: a column of how many rows each row stands for."""
    s = F.col(score).cast("double")
    ok = s.isNotNull() & ~F.isnan(s) & (F.abs(s) != F.lit(float("inf")))
    return (df.where(ok).groupBy(*group_cols, s.alias("score"))
            .agg(*[(F.coalesce(F.sum(F.when(F.col(label) == y, F.col(count))), F.lit(0)) if count else F.count_if(F.col(label) == y))
                   .cast("long").alias(c) for c, y in (("pos", 1), ("neg", 0))]))


def confusion(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """One aggregation of count_if."""
    y, p = F.col(label), F.col(pred)
    return df.agg(F.count_if((y == 0) & (p == 0)).cast("long").alias("tn"),
                  F.count_if((y == 0) & (p == 1)).cast("long").alias("fp"),
                  F.count_if((y == 1) & (p == 0)).cast("long").alias("fn"),
                  F.count_if((y == 1) & (p == 1)).cast("long").alias("tp"))


def roc_auc(df: DataFrame, score: str = "score", label: str = "label",
            group_cols: list[str] = (), count: str | None = None) -> DataFrame:
    """Rank-sum AUC with half credit for ties; null with one class."""
    g = score_groups(df, score, label, group_cols, count)
    r = running_sums(g, "score", ["neg"], group_cols)
    below = F.col("neg_cum") - F.col("neg")
    agg = (r.groupBy(*group_cols)
           .agg(F.sum(F.col("pos") * (below + F.col("neg") * 0.5)).alias("_u"),
                F.sum("pos").alias("_p"), F.sum("neg").alias("_n")))
    auc = F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_u") / (F.col("_p") * F.col("_n")))
    return agg.select(*group_cols, _r4(auc).alias("auc"))


def binary_metrics(df: DataFrame, label: str = "label", pred: str = "pred",
                   score: str | None = "score") -> DataFrame:
    """Accuracy, precision, recall, F1 (0 on zero division), AUC."""
    cm = confusion(df, label, pred)
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    z = F.lit(0.0)
    out = cm.select(
        _r4((tp + tn) / (tp + tn + fp + fn)).alias("accuracy"),
        _r4(F.coalesce(F.try_divide(tp, tp + fp), z)).alias("precision"),
        _r4(F.coalesce(F.try_divide(tp, tp + fn), z)).alias("recall"),
        _r4(F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), z)).alias("f1"))
    if score:
        # both sides are one row: a broadcast of one row, no shuffle of data
        out = _one_row_merge(out, roc_auc(df, score, label), "auc", "roc_auc")
    return out


def _one_row_merge(a: DataFrame, b: DataFrame, col: str, alias: str) -> DataFrame:
    """Attach the single value of one-row ``b`` to one-row ``a``."""
    val = b.first()[col]
    return a.withColumn(alias, F.lit(val).cast("double"))


def specificity(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Tn / (tn + fp)."""
    cm = confusion(df, label, pred)
    return cm.select(_r4(F.try_divide(F.col("tn").cast("double"),
                                      (F.col("tn") + F.col("fp")).cast("double"))).alias("specificity"))


def class_report(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Per class precision / recall / F1 / support, then accuracy, macro
    and weighted averages (accuracy row: value in f1, total support)."""
    y, p = F.col(label), F.col(pred)
    per = (df.select(F.explode(F.array(
        F.struct(y.alias("cls"), F.lit(1).alias("is_true"), (y == p).cast("int").alias("hit")),
        F.struct(p.alias("cls"), F.lit(0).alias("is_true"), (y == p).cast("int").alias("hit")))).alias("s"))
        .select("s.*")
        .groupBy("cls")
        .agg(F.sum("is_true").cast("long").alias("support"),
             F.count_if(F.col("is_true") == 0).cast("long").alias("n_pred"),
             F.count_if((F.col("is_true") == 1) & (F.col("hit") == 1)).cast("long").alias("tp")))
    z = F.lit(0.0)
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("n_pred").cast("double")), z)
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support").cast("double")), z)
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), (F.col("n_pred") + F.col("support")).cast("double")), z)
    rows = per.select(F.col("cls").cast("string").alias("label"), prec.alias("precision"),
                      rec.alias("recall"), f1.alias("f1"), "support", "tp")
    tot = rows.agg(F.sum("support").alias("n"), F.sum("tp").alias("hits"),
                   F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                   (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
                   (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
                   (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"))
    acc = tot.select(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"),
                     (F.col("hits") / F.col("n")).alias("f1"), F.col("n").alias("support"))
    macro = tot.select(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"),
                       F.col("mr").alias("recall"), F.col("mf").alias("f1"), F.col("n").alias("support"))
    weighted = tot.select(F.lit("weighted avg").alias("label"), F.col("wp").alias("precision"),
                          F.col("wr").alias("recall"), F.col("wf").alias("f1"), F.col("n").alias("support"))
    allrows = rows.drop("tp").unionByName(acc).unionByName(macro).unionByName(weighted)
    return allrows.select("label", *[_r4(c).alias(c) for c in ("precision", "recall", "f1")],
                          F.col("support").cast("long").alias("support"))


def weighted_metrics(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Support-weighted precision, recall and F1 (one row)."""
    rep = class_report(df, label, pred).where(F.col("label") == "weighted avg")
    return rep.select(F.col("precision").alias("w_precision"), F.col("recall").alias("w_recall"),
                      F.col("f1").alias("w_f1"))


def roc_points(df: DataFrame, score: str = "score", label: str = "label",
               group_cols: list[str] = (), drop_intermediate: bool = True) -> DataFrame:
    """E5: (fpr, tpr, threshold) per distinct score, descending; first point
    (0, 0, null = +infinity).  Needs both classes (else empty).  Collinear
    points are dropped as by second differences of (fps, tps)."""
    g = list(group_cols)
    sg = score_groups(df, score, label, g)
    r = running_sums(sg, "score", ["pos", "neg"], g, ascending=False)
    r = r.select(*g, "score", F.col("pos_cum").alias("tps"), F.col("neg_cum").alias("fps"), "_idx")
    tot = r.groupBy(*g).agg(F.max("tps").alias("P"), F.max("fps").alias("N"), F.max("_idx").alias("m"))
    r = r.join(F.broadcast(tot), g, "inner") if g else _attach_totals(r, tot)
    r = r.where((F.col("P") > 0) & (F.col("N") > 0))
    if drop_intermediate:
        prev = r.select(*g, (F.col("_idx") + 1).alias("_idx"), F.col("tps").alias("tp_prev"),
                        F.col("fps").alias("fp_prev"))
        nxt = r.select(*g, (F.col("_idx") - 1).alias("_idx"), F.col("tps").alias("tp_next"),
                       F.col("fps").alias("fp_next"))
        j = r.join(prev, [*g, "_idx"], "left").join(nxt, [*g, "_idx"], "left")
        keep = ((F.col("_idx") == 1) | (F.col("_idx") == F.col("m"))
                | (F.col("fp_next") - 2 * F.col("fps") + F.col("fp_prev") != 0)
                | (F.col("tp_next") - 2 * F.col("tps") + F.col("tp_prev") != 0))
        r = j.where(keep)
    pts = r.select(*g, _r4(F.col("fps") / F.col("N")).alias("fpr"), _r4(F.col("tps") / F.col("P")).alias("tpr"),
                   _r4(F.col("score")).alias("threshold"))
    origin = tot.where((F.col("P") > 0) & (F.col("N") > 0)).select(
        *g, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(None).cast("double").alias("threshold"))
    return origin.unionByName(pts)


def _attach_totals(r: DataFrame, tot: DataFrame) -> DataFrame:
    row = tot.first()
    if row is None:
        return r.withColumn("P", F.lit(0)).withColumn("N", F.lit(0)).withColumn("m", F.lit(0))
    return (r.withColumn("P", F.lit(row["P"])).withColumn("N", F.lit(row["N"]))
            .withColumn("m", F.lit(row["m"])))


def roc_ovr(df: DataFrame, class_col: str, score_cols: dict) -> DataFrame:
    """One-vs-rest ROC per class; ``score_cols`` maps class -> column."""
    items = [F.struct(F.lit(c).alias("cls"), F.col(s).cast("double").alias("score"),
                      (F.col(class_col) == F.lit(c)).cast("int").alias("y"))
             for c, s in score_cols.items()]
    long = df.select(F.explode(F.array(*items)).alias("s")).select("s.*")
    return roc_points(long, "score", "y", ["cls"])


def comparison_long(results: DataFrame, id_col: str = "model") -> DataFrame:
    """Wide per-model metric table -> (model, metric, value)."""
    metrics = [c for c in results.columns if c != id_col]
    typed = results.select(id_col, *[F.col(m).cast("double").alias(m) for m in metrics])
    return typed.unpivot([id_col], metrics, "metric", "value")


def eval_bundle(df: DataFrame, label: str = "label", pred: str = "pred", score: str = "score",
                importances: list[tuple[str, float]] | None = None, top: int = 20) -> dict:
    """Metrics and confusion (one small row each, non-finite -> None),
    the sample count, the ROC points as a DataFrame (its size grows with the
    distinct scores, so it is not pulled to the driver), and the ``top`` features
    of a model's ``importances``, the largest first, equal ones by name."""
    import math as _m

    def fin(v):
        return v if not isinstance(v, float) or _m.isfinite(v) else None
    m = binary_metrics(df, label, pred, score).first().asDict()
    cm = confusion(df, label, pred).first().asDict()
    ranked = sorted(((f, fin(float(v))) for f, v in importances or []), key=lambda x: (-(x[1] or 0.0), x[0]))
    return {"metrics": {k: fin(v) for k, v in m.items()}, "confusion": cm, "importance": ranked[:top],
            "roc": roc_points(df, score, label), "n_samples": sum(cm.values())}
