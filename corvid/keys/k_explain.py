"""Keys for attribution and explanation."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvid.keys import key
from corvid.keys.k_models import split_sig
from corvid.keys.splits_sql import split_sql
from corvid.operators import attribution as A
from corvid.operators import explain as X
from corvid.operators import models as M
from corvid.operators import prep
from corvid.operators.rank import topk_abs
from corvid.sources import views

# fixed linear score used by the oracle keys: sum of COEF[c] * x_c + INTERCEPT
COEF = {"period": 0.01, "duration": -0.2, "depth": 1e-6, "prad": 2e-5, "snr": 5e-4, "st_teff": -1e-6,
        "st_rad": 0.1}
INTERCEPT = -4.5
FEATS = list(COEF)


def _filled(spark, sf):
    """V_SIG with nulls filled by the exact medians; returns (frame, medians)."""
    s = views.sig(spark, sf).persist()      # read by the median passes and the expansion
    med = prep.fit_median(s, FEATS)
    return prep.apply_fill(s, med), med


def _linear(frame):
    expr = F.lit(INTERCEPT)
    for c, a in COEF.items():
        expr = expr + F.lit(a) * F.col(c)
    return frame.withColumn("_v", expr)


_MED_CTE = (", med AS MATERIALIZED (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in FEATS) + " FROM sig)\n"
            ", fs AS MATERIALIZED (SELECT id, " + ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in FEATS)
            + ", " + ", ".join(f"m_{c}" for c in FEATS) + " FROM sig, med)\n")
_CONTRIB_SQL = _MED_CTE + ", ct AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT id, '{c}' AS feature, round(CAST({a!r} AS DOUBLE) * ({c} - m_{c}), 9) AS value FROM fs"
    for c, a in COEF.items()) + ")\n"
_TOP_SQL = _CONTRIB_SQL + """, tk AS MATERIALIZED (SELECT id, feature, value,
  CAST(row_number() OVER (PARTITION BY id ORDER BY abs(value) DESC, feature) AS BIGINT) AS rank FROM ct)
"""


@key("topk_abs", _TOP_SQL + "SELECT id, feature, round(value, 4) AS value, rank FROM tk WHERE rank <= 5")
def topk_abs_key(spark, sf):
    f, med = _filled(spark, sf)
    packed = F.array(*[F.struct(F.lit(c).alias("feature"),
                                F.round(F.lit(a) * (F.col(c) - F.lit(float(med[c]))), 9).alias("value"))
                       for c, a in COEF.items()])
    contrib = f.select("id", F.explode(packed).alias("s")).select("id", "s.*")
    return topk_abs(contrib, 5).select("id", "feature", F.round("value", 4).alias("value"), "rank")


@key("shapley_topk", _TOP_SQL + "SELECT id, feature, round(value, 4) AS value, rank FROM tk WHERE rank <= 5")
def shapley_topk(spark, sf):
    f, med = _filled(spark, sf)
    top = X.shapley_topk(f, FEATS, med, _linear, 5)
    return top.select("id", "feature", F.round("value", 4).alias("value"), "rank")


_LIN_SQL = " + ".join(f"CAST({a!r} AS DOUBLE) * {c}" for c, a in COEF.items()) + f" + CAST({INTERCEPT!r} AS DOUBLE)"


@key("explain_text", _TOP_SQL + f""", pr AS (SELECT id, 1.0 / (1.0 + exp(-({_LIN_SQL}))) AS prob FROM fs)
, pl AS (SELECT id, prob, CASE WHEN prob > 0.5 THEN 'PLANET' ELSE 'NOT_PLANET' END AS label_text FROM pr)
, t1 AS (SELECT id, feature AS f1, value AS v1 FROM tk WHERE rank = 1)
, t2 AS (SELECT id, feature AS f2, value AS v2 FROM tk WHERE rank = 2)
SELECT pl.id,
  CASE WHEN f2 IS NULL THEN printf('Model predicted %s with probability %.2f.', label_text, prob)
       ELSE printf('The model predicted %s (prob %.2f). The strongest influences were %s, %s. In short: %s %s the chance and %s %s the chance.',
                   label_text, prob, f1, f2, f1, CASE WHEN v1 > 0 THEN 'increases' ELSE 'decreases' END,
                   f2, CASE WHEN v2 > 0 THEN 'increases' ELSE 'decreases' END) END AS eli5,
  CASE WHEN f2 IS NULL THEN printf('The model predicted %s.', label_text)
       ELSE printf('The model predicted %s. The strongest influences were %s, %s. In short: %s %s the chance and %s %s the chance.',
                   label_text, f1, f2, f1, CASE WHEN v1 > 0 THEN 'increases' ELSE 'decreases' END,
                   f2, CASE WHEN v2 > 0 THEN 'increases' ELSE 'decreases' END) END AS eli5_short
FROM pl LEFT JOIN t1 ON pl.id = t1.id LEFT JOIN t2 ON pl.id = t2.id""")
def explain_text(spark, sf):
    f, med = _filled(spark, sf)
    top = X.shapley_topk(f, FEATS, med, _linear, 5)
    scored = _linear(f).select("id", (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_v")))).alias("prob"))
    preds = scored.withColumn("label_text", F.when(F.col("prob") > 0.5, "PLANET").otherwise("NOT_PLANET"))
    return X.explain_rows(top, preds)


@key("shapley_tree", split_sql("sig", "sp", 0.2, 42)
     + f"SELECT id, CAST({len(FEATS)} AS BIGINT) AS n_features, true AS adds_up FROM sp WHERE split = 'test'")
def shapley_tree(spark, sf):
    """K5 on a fitted tree: of every held-out row the attributions of all
    features add up to its score less the score of the baseline row."""
    sp = prep.stratified_split(views.sig(spark, sf), test_size=0.2, seed=42).cache()
    train, test = sp.where(F.col("split") == "train"), sp.where(F.col("split") == "test")
    m = M.fit(train, FEATS, "dt", {"maxDepth": 6})
    med = prep.fit_median(train, FEATS)

    def score(frame, keep=("id", "_m")):
        return M.score(m, frame, list(keep)).withColumnRenamed("p1", "_v")
    base = spark.createDataFrame([tuple(float(med[c]) for c in FEATS)], ", ".join(f"{c} double" for c in FEATS))
    at_base = score(base, ()).first()["_v"]
    phi = X.shapley(test, FEATS, med, score).groupBy("id") \
        .agg(F.count("value").alias("n_features"), F.sum("value").alias("total"))
    gap = F.col("_v") - F.lit(float(at_base)) - F.col("total")
    return score(test, ("id",)).join(phi, "id").select("id", "n_features", (F.abs(gap) < 1e-9).alias("adds_up"))


# fourteen features: the seven measured ones and their logarithms
WIDE = FEATS + [f"log_{c}" for c in FEATS]


@key("shapley_boosted", split_sql("sig", "sp", 0.2, 42)
     + f"SELECT id, CAST({len(WIDE)} AS BIGINT) AS n_features, true AS adds_up FROM sp WHERE split = 'test'")
def shapley_boosted(spark, sf):
    """K5 above ten features, on 100 boosted trees: the closed form's values of every
    held-out row add up to its margin less that of the baseline row."""
    sp = split_sig(spark, sf) \
        .withColumns({f"log_{c}": F.log1p(F.col(c)) for c in FEATS}).cache()
    train, test = sp.where(F.col("split") == "train"), sp.where(F.col("split") == "test")
    m = M.fit(train, WIDE, "gbt")
    mean = train.agg(*[F.avg(c).alias(c) for c in WIDE]).first().asDict()
    base = spark.createDataFrame([tuple(mean.values())], ", ".join(f"{c} double" for c in mean))
    at_base = base.select(m.margin_column().alias("v")).first()["v"]
    phi = A.attributions(m, test, mean).groupBy("id").agg(F.count("value").alias("n_features"), F.sum("value").alias("total"))
    gap = F.col("v") - F.lit(float(at_base)) - F.col("total")
    return test.select("id", m.margin_column().alias("v")).join(phi, "id") \
        .select("id", "n_features", (F.abs(gap) < 1e-9).alias("adds_up"))


@key("explain_first", _TOP_SQL + """SELECT id, feature, round(value, 4) AS value, rank FROM tk
  WHERE rank <= 5 AND id = (SELECT min(id) FROM sig)""")
def explain_first(spark, sf):
    """K6: after a batch upload, explain its first row."""
    f, med = _filled(spark, sf)
    top = X.shapley_topk(X.first_row(f), FEATS, med, _linear, 5)
    return top.select("id", "feature", F.round("value", 4).alias("value"), "rank")
