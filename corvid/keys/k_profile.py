"""Keys for profiling aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvid.functions import labels as L
from corvid.keys import key
from corvid.keys.k_select import LT_CTE, _GENERAL_SQL, _KOI_STD, _TOI_STD, _std_sql
from corvid.keys.shapes import KOI_SQL, TOI_SQL, koi_like, label_text, toi_like
from corvid.keys.sqlgen import unpivot_sql
from corvid.keys.splits_sql import fold_sql
from corvid.keys.shapes import SCORED_SIG_SQL, scored_sig
from corvid.operators import profile as P
from corvid.operators.prep import kfold
from corvid.operators.setops import union_by_name
from corvid.operators.standardize import standardize
from corvid.sources import views

_F = views.OBS_FEATURES
_GEN_CTE = LT_CTE + f", g AS (SELECT id, CAST({_GENERAL_SQL} AS INTEGER) AS label FROM lt)\n"


def _general(spark, sf):
    return L.map_label(label_text(spark, sf), "disp", "general")


@key("value_counts", _GEN_CTE + "SELECT label, count(*) AS count FROM g GROUP BY label")
def value_counts(spark, sf):
    return P.value_counts(_general(spark, sf), "label")


@key("class_share", _GEN_CTE + """SELECT label, count, round(count * 100.0 / sum(count) OVER (), 4) AS pct
FROM (SELECT label, count(*) AS count FROM g GROUP BY label) c""")
def class_share(spark, sf):
    return P.class_share(_general(spark, sf), "label")


@key("class_ratio", """SELECT CAST(count_if(label = 0) AS BIGINT) AS n_neg, CAST(count_if(label = 1) AS BIGINT) AS n_pos,
  round(CAST(count_if(label = 0) AS DOUBLE) / nullif(count_if(label = 1), 0), 4) AS ratio FROM sig""")
def class_ratio(spark, sf):
    return P.class_ratio(views.sig(spark, sf), "label")


_OBS_ALL = ["id", "disposition"] + _F


@key("null_counts", unpivot_sql(_OBS_ALL, "CAST(count_if({c} IS NULL) AS BIGINT)", "obs", "nulls"))
def null_counts(spark, sf):
    return P.null_counts(views.obs(spark, sf))


@key("missing_pct", unpivot_sql(_OBS_ALL, "round(count_if({c} IS NULL) * 100.0 / count(*), 4)", "obs",
                                "missing_pct"))
def missing_pct(spark, sf):
    return P.missing_pct(views.obs(spark, sf))


_DESC_FMT = ("count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
             "round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, "
             "round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75, "
             "round(max({c}), 4) AS max")


@key("describe", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, {i} AS position, {_DESC_FMT.format(c=c)} FROM obs" for i, c in enumerate(_F)))
def describe(spark, sf):
    return P.describe(views.obs(spark, sf).select(*_F).persist(), _F)


def _hist_sql():
    parts = []
    for c in _F:
        parts.append(f"""SELECT '{c}' AS feature, CAST(CASE WHEN b.hi > b.lo
            THEN least(floor(({c} - b.lo) / (b.hi - b.lo) * 20), 19) ELSE 0 END AS INTEGER) AS bin
          FROM obs, (SELECT min({c}) AS lo, max({c}) AS hi FROM obs) b WHERE {c} IS NOT NULL""")
    return ("SELECT feature, bin, count(*) AS count FROM (" + "\nUNION ALL\n".join(parts)
            + ") h GROUP BY feature, bin")


@key("histogram20", _hist_sql())
def histogram20(spark, sf):
    return P.histogram(views.obs(spark, sf), _F, 20)


@key("corr_matrix", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 4) AS corr FROM obs"
    for i, a in enumerate(_F) for b in _F[i + 1:]))
def corr_matrix(spark, sf):
    return P.corr_matrix(views.obs(spark, sf), _F)


@key("shape", f"SELECT count(*) AS n_rows, CAST({len(_OBS_ALL)} AS BIGINT) AS n_cols FROM obs")
def shape(spark, sf):
    return P.shape(views.obs(spark, sf))


@key("bincount", "SELECT label, count(*) AS count FROM sig GROUP BY label")
def bincount(spark, sf):
    return P.value_counts(views.sig(spark, sf), "label")


@key("head_n", "SELECT * FROM obs ORDER BY id LIMIT 5")
def head_n(spark, sf):
    return P.head_n(views.obs(spark, sf), 5, "id")


_STD_KOI_SQL = _std_sql("koi", "koi", _KOI_STD)
_STD_TOI_SQL = _std_sql("toi", "toi", _TOI_STD)


@key("source_rollup", f""", koi AS ({KOI_SQL}), toi AS ({TOI_SQL}),
u AS (SELECT 'koi' AS source, CAST(label AS INTEGER) AS label FROM ({_STD_KOI_SQL}) a
        WHERE TRY_CAST(label AS INTEGER) IN (0, 1)
      UNION ALL
      SELECT 'toi' AS source, CAST(label AS INTEGER) AS label FROM ({_STD_TOI_SQL}) b
        WHERE TRY_CAST(label AS INTEGER) IN (0, 1))
SELECT coalesce(source, 'ALL') AS source, count(*) AS n_rows, CAST(count_if(label = 1) AS BIGINT) AS n_pos,
       CAST(count_if(label = 0) AS BIGINT) AS n_neg
FROM u GROUP BY ROLLUP (source)""")
def source_rollup(spark, sf):
    k = L.binary_filter(standardize(koi_like(spark, sf), "koi")).withColumn("source", F.lit("koi"))
    t = L.binary_filter(standardize(toi_like(spark, sf), "toi")).withColumn("source", F.lit("toi"))
    return P.source_rollup(union_by_name([k, t]).select("source", "label"), "source", "label")


_CV_METRICS = ["accuracy", "precision", "recall", "f1"]


@key("cv_summary", f""", ss AS ({SCORED_SIG_SQL})
{fold_sql('ss', 'fo', 5, 42)}
, m AS (SELECT fold,
    CAST(count_if(label = pred) AS DOUBLE) / count(*) AS accuracy,
    coalesce(CAST(count_if(label = 1 AND pred = 1) AS DOUBLE) / nullif(count_if(pred = 1), 0), 0.0) AS precision,
    coalesce(CAST(count_if(label = 1 AND pred = 1) AS DOUBLE) / nullif(count_if(label = 1), 0), 0.0) AS recall,
    coalesce(2.0 * count_if(label = 1 AND pred = 1)
             / nullif(2 * count_if(label = 1 AND pred = 1) + count_if(label = 0 AND pred = 1)
                      + count_if(label = 1 AND pred = 0), 0), 0.0) AS f1
  FROM fo GROUP BY fold)
""" + "\nUNION ALL\n".join(
    f"SELECT '{m}' AS metric, round(avg({m}), 4) AS mean, round(stddev_pop({m}), 4) AS std FROM m"
    for m in _CV_METRICS))
def cv_summary(spark, sf):
    folds = kfold(scored_sig(spark, sf), 5)
    cm = (folds.groupBy("fold").agg(
        F.count_if((F.col("label") == 0) & (F.col("pred") == 0)).alias("tn"),
        F.count_if((F.col("label") == 0) & (F.col("pred") == 1)).alias("fp"),
        F.count_if((F.col("label") == 1) & (F.col("pred") == 0)).alias("fn"),
        F.count_if((F.col("label") == 1) & (F.col("pred") == 1)).alias("tp")))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    z = F.lit(0.0)
    per_fold = cm.select("fold", ((tp + tn) / (tp + tn + fp + fn)).alias("accuracy"),
                         F.coalesce(F.try_divide(tp, tp + fp), z).alias("precision"),
                         F.coalesce(F.try_divide(tp, tp + fn), z).alias("recall"),
                         F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), z).alias("f1"))
    return P.fold_summary(per_fold, _CV_METRICS)
