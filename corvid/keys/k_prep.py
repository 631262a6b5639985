"""Keys for preparation: impute, scale, weights, split, folds, balancing (F)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from corvid.keys import key
from corvid.keys.splits_sql import fold_sql, ranked_sql, split_sql
from corvid.operators import prep
from corvid.sources import views

_F = views.OBS_FEATURES
_I = views.IMB_FEATURES


def _r4_all(df, cols, keep):
    return df.select(*keep, *[F.round(c, 4).alias(c) for c in cols])


@key("impute_median", split_sql("sig", "sp", 0.2, 42) + """
, med AS (SELECT """ + ", ".join(f"quantile_cont({c}, 0.5) FILTER (WHERE split = 'train') AS m_{c}"
                                  for c in _F) + """ FROM sp)
SELECT id, split, """ + ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in _F) + """
FROM sp, med""")
def impute_median(spark, sf):
    sp = prep.stratified_split(views.sig(spark, sf).persist(), test_size=0.2, seed=42).persist()
    filled, _ = prep.impute_median(sp.where(F.col("split") == "train"), sp, _F)
    # not rounded: raw features are exact decimals (rounding would hit ties)
    # and the interpolated medians are computed with the same formula
    return filled.select("id", "split", *_F)


@key("scale_standard", """, nn AS (SELECT * FROM obs WHERE """ + " AND ".join(f"{c} IS NOT NULL" for c in _F) + """)
, st AS (SELECT """ + ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 OR stddev_pop({c}) IS NULL "
                                  f"THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}" for c in _F) + """ FROM nn)
SELECT id, """ + ", ".join(f"round(({c} - m_{c}) / s_{c}, 4) AS {c}" for c in _F) + " FROM nn, st")
def scale_standard(spark, sf):
    nn = views.obs(spark, sf).na.drop("any", subset=_F)
    return _r4_all(prep.apply_scale(nn, prep.fit_standard(nn, _F)), _F, ["id"])


@key("scale_robust", """, st AS (SELECT """ + ", ".join(
    f"quantile_cont({c}, 0.5) AS m_{c}, CASE WHEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) = 0 "
    f"THEN 1.0 ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END AS s_{c}" for c in _I) + """ FROM imb)
SELECT id, """ + ", ".join(f"round(({c} - m_{c}) / s_{c}, 4) AS {c}" for c in _I) + " FROM imb, st")
def scale_robust(spark, sf):
    d = views.imb(spark, sf)
    return _r4_all(prep.apply_scale(d, prep.fit_robust(d, _I)), _I, ["id"])


@key("class_weights", """, c AS (SELECT label, count(*) AS n_c FROM imb GROUP BY label)
, t AS (SELECT sum(n_c) AS n, count(*) AS k FROM c)
SELECT i.id, i.label, round(CAST(t.n AS DOUBLE) / (t.k * c.n_c), 4) AS weight
FROM imb i JOIN c ON i.label = c.label, t""")
def class_weights(spark, sf):
    w = prep.with_class_weight(views.imb(spark, sf), "label", "weight")
    return w.select("id", "label", F.round("weight", 4).alias("weight"))


@key("split_stratified", split_sql("sig", "sp", 0.2, 42) + "SELECT id, label, split FROM sp")
def split_stratified(spark, sf):
    sig = views.sig(spark, sf).select("id", "label").persist()   # counted, then ranked
    return prep.stratified_split(sig, test_size=0.2, seed=42).select("id", "label", "split")


@key("split_three_way", split_sql("sig", "s1", 0.15, 42)
     + ", rest AS (SELECT * EXCLUDE (split) FROM s1 WHERE split = 'train')\n"
     + split_sql("rest", "s2", 0.15 / (1.0 - 0.15), "42v", "val", "train")
     + "SELECT id, label, split FROM s2 UNION ALL SELECT id, label, split FROM s1 WHERE split = 'test'")
def split_three_way(spark, sf):
    return prep.split_three_way(views.sig(spark, sf), test_size=0.15, val_size=0.15, seed=42).select(
        "id", "label", "split")


@key("kfold", fold_sql("sig", "fo", 5, 42) + "SELECT id, label, fold FROM fo")
def kfold_key(spark, sf):
    return prep.kfold(views.sig(spark, sf), 5, seed=42).select("id", "label", "fold")


@key("undersample", ranked_sql("imb", "rk", 42)
     + "SELECT id, label FROM rk WHERE _rnk <= (SELECT min(_n) FROM rk)")
def undersample(spark, sf):
    return prep.undersample(views.imb(spark, sf), seed=42).select("id", "label")


@key("oversample", ranked_sql("imb", "rk", 42) + """
, cls AS (SELECT DISTINCT label, _n FROM rk)
, draws AS (SELECT label, _n, unnest(generate_series(1, (SELECT max(_n) FROM rk))) AS draw FROM cls)
SELECT d.draw, d.label, r.id AS src_id, r.n_chars
FROM draws d JOIN rk r ON r.label = d.label
 AND r._rnk = (('0x' || substr(md5('42|' || CAST(d.label AS VARCHAR) || '|' || CAST(d.draw AS VARCHAR)), 1, 8))::BIGINT
               % d._n) + 1""")
def oversample(spark, sf):
    return prep.oversample(views.imb(spark, sf), seed=42).select("draw", "label", "src_id", "n_chars")


@key("balance_dispatch", """, c AS (SELECT label, count(*) AS n FROM imb WHERE label IS NOT NULL GROUP BY label)
SELECT 'none' AS method, label, n FROM c
UNION ALL SELECT 'undersample', label, (SELECT min(n) FROM c) FROM c
UNION ALL SELECT 'oversample', label, (SELECT max(n) FROM c) FROM c""")
def balance_dispatch(spark, sf):
    """rows per class by method."""
    d = views.imb(spark, sf).where("label IS NOT NULL")
    out = [prep.balance(d, m).groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(F.lit(m).alias("method"), "label", "n")
           for m in ("none", "undersample", "oversample")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@key("assembled", "SELECT id, period AS x0, duration AS x1 FROM obs WHERE period IS NOT NULL AND duration IS NOT NULL")
def assembled(spark, sf):
    """columns as one vector, in their order."""
    rows = views.obs(spark, sf).where("period IS NOT NULL AND duration IS NOT NULL").select("id", "period", "duration")
    v = vector_to_array(F.col("features"))
    return prep.assembler(["period", "duration"]).transform(rows).select("id", v[0].alias("x0"), v[1].alias("x1"))
