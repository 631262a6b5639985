"""Keys for ranking and choosing models (G1-G5) and the guaranteed-key
importance list (C3)."""

from __future__ import annotations


from pyspark.sql import functions as F

from corvid.keys import key
from corvid.keys.k_evaluate import COMPARISON_SQL, comparison
from corvid.operators import rank as R
from corvid.sources import views


@key("rank_models", COMPARISON_SQL + """SELECT model, accuracy,
  CAST(row_number() OVER (ORDER BY accuracy DESC, model) AS BIGINT) AS rank FROM cmp""")
def rank_models(spark, sf):
    return R.rank_models(comparison(spark, sf), "accuracy").select("model", "accuracy", "rank")


@key("top5_models", COMPARISON_SQL + "SELECT model, roc_auc FROM cmp ORDER BY roc_auc DESC NULLS LAST, model LIMIT 5")
def top5_models(spark, sf):
    return R.top_k(comparison(spark, sf), "roc_auc", 5).select("model", "roc_auc")


@key("best_by", COMPARISON_SQL + """SELECT
  (SELECT model FROM cmp ORDER BY roc_auc DESC, model LIMIT 1) AS best_auc_model,
  (SELECT model FROM cmp ORDER BY accuracy DESC, model LIMIT 1) AS best_accuracy_model,
  (SELECT model FROM cmp ORDER BY recall ASC, model LIMIT 1) AS lowest_recall_model""")
def best_by(spark, sf):
    return R.best_by(comparison(spark, sf), {"best_auc_model": ("roc_auc", "max"),
                                             "best_accuracy_model": ("accuracy", "max"),
                                             "lowest_recall_model": ("recall", "min")})


@key("auc_summary", COMPARISON_SQL + "SELECT round(avg(roc_auc), 4) AS mean_auc, max(roc_auc) AS best_auc FROM cmp")
def auc_summary(spark, sf):
    return R.auc_summary(comparison(spark, sf))


@key("recommend", COMPARISON_SQL + """, b AS (SELECT
  (SELECT model FROM cmp ORDER BY roc_auc DESC, model LIMIT 1) AS best,
  (SELECT model FROM cmp ORDER BY 1.0 + f1, model LIMIT 1) AS fast)
SELECT 'best' AS role, best AS model FROM b
UNION ALL SELECT 'fastest' AS role, fast AS model FROM b WHERE fast <> best""")
def recommend(spark, sf):
    # the fixed scorers have no timings; a time that grows with F1 stands in
    return R.recommend(comparison(spark, sf).withColumn("train_s", F.lit(1.0) + F.col("f1")), "roc_auc", "train_s")


_CHOSEN = ["snr", "depth", "koi_teq", "period"]
_CAND = views.OBS_FEATURES


@key("importance_guaranteed", """, imp AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(abs(corr({c}, CAST(label AS DOUBLE))), 4) AS importance FROM sig" for c in _CAND)
     + """)
, ch AS (SELECT * FROM (VALUES """ + ", ".join(f"('{c}', {i})" for i, c in enumerate(_CHOSEN)) + """) t(feature, pos))
SELECT feature, importance, CAST(rnk AS BIGINT) AS rank FROM (
  SELECT feature, importance, row_number() OVER (ORDER BY grp, pos, importance DESC, feature) AS rnk FROM (
    SELECT ch.feature, coalesce(imp.importance, 0.0) AS importance, 0 AS grp, ch.pos
      FROM ch LEFT JOIN imp ON ch.feature = imp.feature
    UNION ALL
    SELECT feature, importance, 1 AS grp, 0 AS pos FROM imp WHERE feature NOT IN (SELECT feature FROM ch)) u) r
WHERE rnk <= 50""")
def importance_guaranteed(spark, sf):
    s = views.sig(spark, sf)
    row = s.agg(*[F.round(F.abs(F.corr(c, F.col("label").cast("double"))), 4).alias(c) for c in _CAND])
    imp = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance"))
                                         for c in _CAND])).alias("s")).select("s.*")
    return R.guaranteed_list(imp, _CHOSEN, 50)


