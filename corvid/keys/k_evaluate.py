"""Keys for evaluation (E1-E10) and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvid.functions import labels as L
from corvid.keys import key
from corvid.keys.shapes import FIXED_SCORE_SQL, SCORED_SIG_SQL, fixed_score, scored_sig
from corvid.operators import evaluate as E
from corvid.operators import prep
from corvid.sources import views

SS = f", ss AS ({SCORED_SIG_SQL})\n"

_CONF_SQL = """CAST(count_if(label = 0 AND pred = 0) AS BIGINT) AS tn, CAST(count_if(label = 0 AND pred = 1) AS BIGINT) AS fp,
  CAST(count_if(label = 1 AND pred = 0) AS BIGINT) AS fn, CAST(count_if(label = 1 AND pred = 1) AS BIGINT) AS tp"""


def auc_sql(src: str, score: str = "score", label: str = "label", group: str | None = None) -> str:
    """Rank-sum AUC (ties half credit) as SQL over ``src``."""
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    return f"""(SELECT {g}round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0
        THEN sum(CAST(pos AS DOUBLE) * (coalesce(below, 0) + 0.5 * neg)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) END, 4) AS auc
      FROM (SELECT *, sum(neg) OVER ({part}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below
            FROM (SELECT {g}CAST({score} AS DOUBLE) AS score, count_if({label} = 1) AS pos, count_if({label} = 0) AS neg
                  FROM {src} WHERE {score} IS NOT NULL AND NOT isnan({score}) AND NOT isinf({score})
                  GROUP BY {g}CAST({score} AS DOUBLE)) a) b
      {('GROUP BY ' + group) if group else ''})"""


def _metrics_sql(cm: str) -> str:
    return f"""round(CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn), 4) AS accuracy,
  round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0), 4) AS precision,
  round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0), 4) AS recall,
  round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 4) AS f1"""


# --- flagship ------------------------------------------------------------------------------
FLAGSHIP_SQL = f"""
, lab AS (SELECT *, CAST(CASE WHEN disposition IS NULL THEN NULL
    WHEN contains(upper(disposition), 'FALSE') OR contains(upper(disposition), ' FP')
      OR trim(upper(disposition)) = 'FP' THEN 0 ELSE 1 END AS INTEGER) AS label FROM obs)
, med AS (SELECT quantile_cont(snr, 0.5) AS m FROM lab)
, sc AS (SELECT label, {FIXED_SCORE_SQL.replace('snr', '(coalesce(snr, (SELECT m FROM med)))')} AS score FROM lab)
, pr AS (SELECT label, score, CAST(score > 0.5 AS INTEGER) AS pred FROM sc)
, cm AS (SELECT {_CONF_SQL} FROM pr)
SELECT {_metrics_sql('cm')}, (SELECT auc FROM {auc_sql('pr')}) AS roc_auc, tn, fp, fn, tp FROM cm
"""


def flagship(spark, sf):
    """A1 scan -> V_OBS -> B6 general label -> B7 binary filter -> F1 median
    fill -> fixed score -> E1 metrics with E2 counts."""
    base = views.obs(spark, sf)
    # several passes follow (median bracket, metrics, AUC): keep the labelled
    # rows once (memory and disk) instead of re-aggregating lineitem per pass
    lab = L.binary_filter(L.map_label(base, "disposition", "general")).select("label", "snr").persist()
    filled, _ = prep.impute_median(lab, lab, ["snr"])
    scored = (filled.withColumn("score", fixed_score())
              .withColumn("pred", (F.col("score") > 0.5).cast("int")))
    m = E.binary_metrics(scored, "label", "pred", "score")
    cm = E.confusion(scored, "label", "pred").first()
    return m.select("*", *[F.lit(cm[c]).cast("long").alias(c) for c in ("tn", "fp", "fn", "tp")])


key("flagship", FLAGSHIP_SQL)(flagship)


# --- E1-E8 --------------------------------------------------------------------------------------
@key("binary_metrics", SS + f", cm AS (SELECT {_CONF_SQL} FROM ss)\n"
     f"SELECT {_metrics_sql('cm')}, (SELECT auc FROM {auc_sql('ss')}) AS roc_auc FROM cm")
def binary_metrics(spark, sf):
    return E.binary_metrics(scored_sig(spark, sf))


@key("confusion", SS + f"SELECT {_CONF_SQL} FROM ss")
def confusion(spark, sf):
    return E.confusion(scored_sig(spark, sf))


@key("specificity", SS + """SELECT round(CAST(count_if(label = 0 AND pred = 0) AS DOUBLE)
  / nullif(count_if(label = 0), 0), 4) AS specificity FROM ss""")
def specificity(spark, sf):
    return E.specificity(scored_sig(spark, sf))


@key("roc_auc", SS + f"SELECT auc FROM {auc_sql('ss')}")
def roc_auc(spark, sf):
    return E.roc_auc(scored_sig(spark, sf))


_REPORT_SQL = """
, per AS (SELECT cls, sum(is_true) AS support, count_if(is_true = 0) AS n_pred,
                 count_if(is_true = 1 AND hit = 1) AS tp
          FROM (SELECT label AS cls, 1 AS is_true, CAST(label = pred AS INTEGER) AS hit FROM ss
                UNION ALL SELECT pred AS cls, 0 AS is_true, CAST(label = pred AS INTEGER) AS hit FROM ss) x
          GROUP BY cls)
, rows_ AS (SELECT CAST(cls AS VARCHAR) AS label,
     coalesce(CAST(tp AS DOUBLE) / nullif(n_pred, 0), 0.0) AS precision,
     coalesce(CAST(tp AS DOUBLE) / nullif(support, 0), 0.0) AS recall,
     coalesce(2.0 * tp / nullif(n_pred + support, 0), 0.0) AS f1, support, tp FROM per)
, tot AS (SELECT sum(support) AS n, sum(tp) AS hits, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
     sum(precision * support) / sum(support) AS wp, sum(recall * support) / sum(support) AS wr,
     sum(f1 * support) / sum(support) AS wf FROM rows_)
, rep AS (
  SELECT label, precision, recall, f1, support FROM rows_
  UNION ALL SELECT 'accuracy', NULL, NULL, CAST(hits AS DOUBLE) / n, n FROM tot
  UNION ALL SELECT 'macro avg', mp, mr, mf, n FROM tot
  UNION ALL SELECT 'weighted avg', wp, wr, wf, n FROM tot)
"""


@key("class_report", SS + _REPORT_SQL + """SELECT label, round(precision, 4) AS precision, round(recall, 4) AS recall,
  round(f1, 4) AS f1, CAST(support AS BIGINT) AS support FROM rep""")
def class_report(spark, sf):
    return E.class_report(scored_sig(spark, sf))


@key("weighted_metrics", SS + _REPORT_SQL + """SELECT round(precision, 4) AS w_precision,
  round(recall, 4) AS w_recall, round(f1, 4) AS w_f1 FROM rep WHERE label = 'weighted avg'""")
def weighted_metrics(spark, sf):
    return E.weighted_metrics(scored_sig(spark, sf))


def roc_sql(src: str, score: str = "score", label: str = "label", group: str | None = None) -> str:
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    part_rc = f"PARTITION BY rc.{group} " if group else ""
    return f"""
, rg AS (SELECT {g}CAST({score} AS DOUBLE) AS score, count_if({label} = 1) AS pos, count_if({label} = 0) AS neg
         FROM {src} WHERE {score} IS NOT NULL AND NOT isnan({score}) AND NOT isinf({score}) GROUP BY {g}CAST({score} AS DOUBLE))
, rc AS (SELECT {g}score, sum(pos) OVER ({part}ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tps,
                sum(neg) OVER ({part}ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fps,
                row_number() OVER ({part}ORDER BY score DESC) AS idx
         FROM rg)
, rt AS (SELECT {g}max(tps) AS P, max(fps) AS N, max(idx) AS m FROM rc {('GROUP BY ' + group) if group else ''})
, rl AS (SELECT rc.*, rt.P, rt.N, rt.m,
                lag(tps) OVER ({part_rc}ORDER BY idx) AS tp_prev, lead(tps) OVER ({part_rc}ORDER BY idx) AS tp_next,
                lag(fps) OVER ({part_rc}ORDER BY idx) AS fp_prev, lead(fps) OVER ({part_rc}ORDER BY idx) AS fp_next
         FROM rc JOIN rt ON {('rc.' + group + ' = rt.' + group) if group else 'TRUE'})
, roc AS (
  SELECT {g}0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr, CAST(NULL AS DOUBLE) AS threshold FROM rt WHERE P > 0 AND N > 0
  UNION ALL
  SELECT {g}round(CAST(fps AS DOUBLE) / N, 4), round(CAST(tps AS DOUBLE) / P, 4), round(score, 4) FROM rl
  WHERE P > 0 AND N > 0 AND (idx = 1 OR idx = m OR fp_next - 2 * fps + fp_prev <> 0 OR tp_next - 2 * tps + tp_prev <> 0))
"""


@key("roc_points", SS + roc_sql("ss") + "SELECT * FROM roc")
def roc_points(spark, sf):
    return E.roc_points(scored_sig(spark, sf))


_OVR = {0: ("snr", 200.0), 1: ("depth", 4000.0), 2: ("period", 4.0)}


def _ovr_frame(spark, sf):
    o = views.obs(spark, sf)
    cls = (F.when(F.col("disposition") == "FALSE POSITIVE", 0)
           .when(F.col("disposition") == "CONFIRMED", 1).otherwise(2))
    out = o.withColumn("cls", cls)
    for c, (col, d) in _OVR.items():
        out = out.withColumn(f"s{c}", F.least(F.floor(F.coalesce(F.col(col), F.lit(0.0)) / d),
                                              F.lit(100)).cast("double") / 100.0)
    return out


_OVR_SQL = (", ov AS (SELECT CASE disposition WHEN 'FALSE POSITIVE' THEN 0 WHEN 'CONFIRMED' THEN 1 ELSE 2 END AS cls, "
            + ", ".join(f"CAST(least(floor(coalesce({col}, 0.0) / {d}), 100) AS DOUBLE) / 100.0 AS s{c}"
                        for c, (col, d) in _OVR.items()) + " FROM obs)\n"
            ", ovl AS (" + " UNION ALL ".join(
                f"SELECT {c} AS cls_k, s{c} AS score, CAST(cls = {c} AS INTEGER) AS y FROM ov" for c in _OVR) + ")\n")


@key("roc_ovr", _OVR_SQL + roc_sql("ovl", "score", "y", "cls_k") + "SELECT cls_k AS cls, fpr, tpr, threshold FROM roc")
def roc_ovr(spark, sf):
    return E.roc_ovr(_ovr_frame(spark, sf), "cls", {c: f"s{c}" for c in _OVR})


# --- E10 / G: fixed scorers compared as models ------------------------------------------------
SCORERS = {"snr_score": ("snr", 200.0), "depth_score": ("depth", 4000.0), "prad_score": ("prad", 600.0),
           "period_score": ("period", 4.0), "teff_score": ("st_teff", 5000.0)}


def scorer_counts(spark, sf):
    """V_SIG scored by every fixed scorer, as rows per (model, score, pred, label): the
    view is read once, and what is kept grows with the distinct scores, not with the rows."""
    s = views.sig(spark, sf)
    items = [F.struct(F.lit(m).alias("model"),
                      (F.least(F.floor(F.coalesce(F.col(c), F.lit(0.0)) / d), F.lit(100)).cast("double")
                       / 100.0).alias("score")) for m, (c, d) in SCORERS.items()]
    long = s.select("label", F.explode(F.array(*items)).alias("s")).select("label", "s.*")
    return long.groupBy("model", "score", (F.col("score") > 0.5).cast("int").alias("pred"), "label") \
        .agg(F.count(F.lit(1)).alias("n")).persist()


SCORER_LONG_SQL = ", sl AS (" + " UNION ALL ".join(
    f"SELECT id, label, '{m}' AS model, CAST(least(floor(coalesce({c}, 0.0) / {d}), 100) AS DOUBLE) / 100.0 AS score "
    f"FROM sig" for m, (c, d) in SCORERS.items()) + ")\n, slp AS (SELECT *, CAST(score > 0.5 AS INTEGER) AS pred FROM sl)\n"


def comparison(spark, sf):
    """Wide per-model table: model, accuracy, precision, recall, f1, roc_auc."""
    counts = scorer_counts(spark, sf)

    def rows(y, p):
        return F.coalesce(F.sum(F.when((F.col("label") == y) & (F.col("pred") == p), F.col("n"))), F.lit(0))
    cm = counts.groupBy("model").agg(rows(0, 0).alias("tn"), rows(0, 1).alias("fp"), rows(1, 0).alias("fn"), rows(1, 1).alias("tp"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    z = F.lit(0.0)
    met = cm.select("model", F.round((tp + tn) / (tp + tn + fp + fn), 4).alias("accuracy"),
                    F.round(F.coalesce(F.try_divide(tp, tp + fp), z), 4).alias("precision"),
                    F.round(F.coalesce(F.try_divide(tp, tp + fn), z), 4).alias("recall"),
                    F.round(F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), z), 4).alias("f1"))
    auc = E.roc_auc(counts, "score", "label", ["model"], "n").withColumnRenamed("auc", "roc_auc")
    # both sides hold one row per model (bounded by the model list)
    return met.join(F.broadcast(auc), "model", "inner")


COMPARISON_SQL = SCORER_LONG_SQL + f"""
, cmp AS (SELECT m.model, m.accuracy, m.precision, m.recall, m.f1, a.auc AS roc_auc
  FROM (SELECT model, {_metrics_sql('x')} FROM (SELECT model, {_CONF_SQL} FROM slp GROUP BY model) x) m
  JOIN {auc_sql('slp', group='model')} a ON m.model = a.model)
"""


@key("comparison_long", COMPARISON_SQL + """SELECT model, metric, value FROM cmp
  UNPIVOT (value FOR metric IN (accuracy, precision, recall, f1, roc_auc))""")
def comparison_long(spark, sf):
    return E.comparison_long(comparison(spark, sf), "model")


@key("eval_bundle", SS + roc_sql("ss") + f""", cm AS (SELECT {_CONF_SQL} FROM ss)
SELECT {_metrics_sql('cm')}, (SELECT auc FROM {auc_sql('ss')}) AS roc_auc, tn, fp, fn, tp,
  CAST(tn + fp + fn + tp AS BIGINT) AS n_samples, (SELECT count(*) FROM roc) AS n_roc_points FROM cm""")
def eval_bundle(spark, sf):
    b = E.eval_bundle(scored_sig(spark, sf))
    m, cm = b["metrics"], b["confusion"]
    row = {**m, **cm, "n_samples": b["n_samples"]}
    roc_n = b["roc"].count()
    return spark.createDataFrame([(*row.values(), roc_n)], [*row.keys(), "n_roc_points"])
