"""Keys for model fitting, training plans and scoring (J, K1-K4, A12, A14,
G6).  Fits run on the train side of the md5 split of V_SIG and score the
held-out side; these are rows checks (plus quality floors in the tests),
except naive Bayes, whose fit and scores SQL states in closed form, and the
ensemble vote, which has an oracle on fixed-formula scores."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corvid.functions import labels as L
from corvid.keys import key
from corvid.keys.k_evaluate import SCORERS
from corvid.keys.shapes import koi_like, toi_like
from corvid.keys.splits_sql import gaussian_nb_sql, split_sql
from corvid.operators import models as M
from corvid.operators import prep
from corvid.operators import rank as R
from corvid.operators import score as S
from corvid.operators.profile import fold_summary
from corvid.operators.setops import union_by_name
from corvid.operators.standardize import standardize
from corvid.plans import train as T
from corvid.session import scratch_dir
from corvid.sources import views

FEATS = views.OBS_FEATURES


def split_sig(spark, sf):
    # the view (a lineitem aggregate joined to orders) is read by the bucket
    # count pass and the ranking pass: keep it once
    return prep.stratified_split(views.sig(spark, sf).persist(), test_size=0.2, seed=42)


def _fit_and_score(family):
    def run(spark, sf):
        sp = split_sig(spark, sf).cache()
        m = M.fit(sp.where(F.col("split") == "train"), FEATS, family)
        return M.score(m, sp.where(F.col("split") == "test"))
    run.__name__ = f"fit_{family}"
    return run


for _fam in ("rf", "gbt_hist", "gbt_xgb", "gbt_cat", "gbt", "logreg", "dt", "svc", "mlp",
             "adaboost", "subspace", "stacking"):
    key(f"fit_{_fam}")(_fit_and_score(_fam))


def rounded(scored):
    """Probabilities to four digits, as both engines agree on them."""
    return scored.withColumns({c: F.round(c, 4) for c in ("p1", "confidence")})


NB_ROWS = """SELECT id, {label}prediction, round(p1, 4) AS p1, round(greatest(p1, 1.0 - p1), 4) AS confidence FROM nb"""


@key("fit_nb", split_sql("sig", "sp", 0.2, 42) + gaussian_nb_sql("sp", "nb", FEATS) + NB_ROWS.format(label="label, "))
def fit_nb(spark, sf):
    """Class means, variances and posteriors equal the closed form."""
    return rounded(_fit_and_score("nb")(spark, sf))


# the 11 models of the comparison, with 100 rounds of depth 6 without weights
# and early stop for the CatBoost-like one
COMPARE_FAMILIES = ["logreg", "rf", "gbt_xgb", "gbt_cat", "gbt_hist", "gbt", "svc", "knn", "dt", "adaboost", "nb"]
COMPARE_PARAMS = {"gbt_cat": {"maxIter": 100, "maxDepth": 6, "validation": None, "patience": None, "balanced": False}}


def _cross_validate(family):
    def run(spark, sf):
        folds = T.cross_validate(views.sig(spark, sf), FEATS, family, 5, params=COMPARE_PARAMS.get(family))
        return fold_summary(folds, T.METRICS + T.TRAIN_METRICS)
    run.__name__ = f"cross_validate_{family}"
    return run


# one key per family, as five fits of each take long; logreg has the plain name
for _fam in COMPARE_FAMILIES:
    key("cross_validate" if _fam == "logreg" else f"cross_validate_{_fam}")(_cross_validate(_fam))


@key("compare_models")
def compare_models(spark, sf):
    sp = split_sig(spark, sf).cache()
    return T.compare_models(sp.where(F.col("split") == "train"), sp.where(F.col("split") == "test"),
                            FEATS, COMPARE_FAMILIES, COMPARE_PARAMS)


@key("train_per_source")
def train_per_source(spark, sf):
    k = L.binary_filter(standardize(koi_like(spark, sf), "koi")).withColumn("source", F.lit("koi"))
    t = L.binary_filter(standardize(toi_like(spark, sf), "toi")).withColumn("source", F.lit("toi"))
    both = union_by_name([k, t])
    # 200 trees or rounds each, as in the reference
    return T.train_per_source(both, "source", ["period", "duration", "depth", "prad"], ["rf", "gbt_xgb"],
                              params={"rf": {"numTrees": 200}, "gbt_xgb": {"maxIter": 200}})


@key("retrain_one")
def retrain_one(spark, sf):
    sig = views.sig(spark, sf).persist()        # read by both passes of the split and by the fit
    path = scratch_dir(spark, f"split-{uuid.uuid4().hex}")
    T.persist_split(prep.stratified_split(sig, test_size=0.2), path)
    _, met = T.retrain_one(sig, path, FEATS, "dt", {"maxDepth": 8})
    return spark.createDataFrame([tuple(met.values())], list(met.keys()))


@key("train_job")
def train_job(spark, sf):
    out = scratch_dir(spark, f"job-{uuid.uuid4().hex}")
    upload = koi_like(spark, sf).withColumnRenamed("kepid", "id").drop("koi_pdisposition", "kepoi_name")
    res = T.train_job(spark, upload, out, label_col="koi_disposition", policy="general",
                      families=("rf", "gbt_hist", "gbt_xgb", "gbt_cat"), balance="smote")
    rows = [(fam, *[m[x] for x in T.METRICS]) for fam, m in res["metrics"].items()]
    return spark.createDataFrame(rows, "model string, " + ", ".join(f"{m} double" for m in T.METRICS))


def _three_models(spark, sf):
    sp = split_sig(spark, sf).cache()
    train = sp.where(F.col("split") == "train")
    stats = M.prepared(train, FEATS)            # shared by the three
    return sp, {f: M.fit(train, FEATS, f, stats=stats) for f in ("logreg", "dt", "nb")}


@key("batch_score")
def batch_score(spark, sf):
    sp, models = _three_models(spark, sf)
    unlabeled = sp.where(F.col("split") == "test").drop("label", "disposition", "split")
    return S.batch_score(models, unlabeled)


@key("single_score", split_sql("sig", "sp", 0.2, 42) + gaussian_nb_sql("sp", "nb", FEATS, absent=("st_rad",))
     + NB_ROWS.format(label="label, "))
def single_score(spark, sf):
    """K4 against the closed form of naive Bayes."""
    sp = split_sig(spark, sf).cache()
    m = M.fit(sp.where(F.col("split") == "train"), FEATS, "nb")
    # scoring input lacks one trained feature (aligned to 0.0) and has an extra
    test = sp.where(F.col("split") == "test").drop("st_rad").withColumn("extra", F.lit(1.0))
    return rounded(S.single_score(m, test))


_VOTE = list(SCORERS)[:4]


@key("ensemble_vote", """SELECT id, CAST(round_even((""" + " + ".join(
    f"CAST(CAST(least(floor(coalesce({SCORERS[m][0]}, 0.0) / {SCORERS[m][1]}), 100) AS DOUBLE) / 100.0 > 0.5 AS INTEGER)"
    for m in _VOTE) + f") / {float(len(_VOTE))}, 0) AS INTEGER) AS vote, round((" + " + ".join(
    f"CAST(least(floor(coalesce({SCORERS[m][0]}, 0.0) / {SCORERS[m][1]}), 100) AS DOUBLE) / 100.0" for m in _VOTE)
    + f") / {float(len(_VOTE))}, 4) AS p1_mean FROM sig")
def ensemble_vote(spark, sf):
    s = views.sig(spark, sf)
    for m in _VOTE:
        c, d = SCORERS[m]
        sc = F.least(F.floor(F.coalesce(F.col(c), F.lit(0.0)) / d), F.lit(100)).cast("double") / 100.0
        s = s.withColumn(f"p_{m}", sc).withColumn(f"c_{m}", (sc > 0.5).cast("int"))
    v = S.ensemble_vote(s, [f"c_{m}" for m in _VOTE], [f"p_{m}" for m in _VOTE])
    return v.select("id", "vote", F.round("p1_mean", 4).alias("p1_mean"))


@key("model_roundtrip", split_sql("sig", "sp", 0.2, 42)
     + "SELECT id, label, true AS same FROM sp WHERE split = 'test'")
def model_roundtrip(spark, sf):
    """Held-out rows score the same before saving and after loading."""
    sp = split_sig(spark, sf).cache()
    m = M.fit(sp.where(F.col("split") == "train"), FEATS, "dt")
    path = scratch_dir(spark, f"model-{uuid.uuid4().hex}")
    M.save(m, path)
    back = M.load(path)
    test = sp.where(F.col("split") == "test")
    a = M.score(m, test, ["id", "label"]).select("id", "label", F.col("prediction").alias("c"), F.col("p1").alias("p"))
    b = M.score(back, test, ["id"])
    return a.join(b, "id").select("id", "label", ((F.col("c") == F.col("prediction")) & (F.col("p") == F.col("p1")))
                                  .alias("same"))


_STATUS = ("dt", "logreg", "nb")


@key("model_status", split_sql("sig", "sp", 0.2, 42) + f"""
, fams AS (SELECT unnest({list(_STATUS) + ['svc']!r}) AS model)
SELECT model, model <> 'svc' AS trained,
  CASE WHEN model <> 'svc' THEN (SELECT count(*) FROM sp WHERE split = 'train') END AS n_train,
  CASE WHEN model <> 'svc' THEN (SELECT count(*) FROM sp WHERE split = 'train' AND label = 1) END AS n_positive,
  CASE WHEN model <> 'svc' THEN {len(FEATS)} ELSE 0 END AS n_features,
  CASE WHEN model <> 'svc' THEN '{",".join(FEATS)}' ELSE '' END AS features FROM fams""")
def model_status(spark, sf):
    """Three families are fitted and saved, a fourth one is not there."""
    _, models = _three_models(spark, sf)
    root = scratch_dir(spark, f"models-{uuid.uuid4().hex}")
    for name, m in models.items():
        M.save(m, f"{root}/{name}")
    return M.status(spark, {name: f"{root}/{name}" for name in (*_STATUS, "svc")})


@key("importance_topk")
def importance_topk(spark, sf):
    sp = split_sig(spark, sf).cache()
    m = M.fit(sp.where(F.col("split") == "train"), FEATS, "rf", {"maxDepth": 10})
    imp = R.importance_table(spark, *zip(*M.importances(m)), model="Random Forest")
    return R.importance_topk(imp, 20)


@key("manual_rows", """SELECT id, period AS koi_period, duration AS koi_duration, depth AS koi_depth,
  prad AS koi_prad, snr AS koi_model_snr, st_teff AS koi_steff, st_rad AS koi_srad, label,
  valid, CASE WHEN NOT valid THEN NULL WHEN label = 'PLANET' THEN 'CONFIRMED' ELSE 'FALSE POSITIVE' END AS koi_disposition
FROM (SELECT *, (period IS NOT NULL AND duration IS NOT NULL AND depth IS NOT NULL AND prad IS NOT NULL
                 AND coalesce(label IN ('PLANET', 'NOT_PLANET'), false)) AS valid
      FROM (SELECT *, CASE WHEN disposition = 'FALSE POSITIVE' THEN 'NOT_PLANET' WHEN disposition = 'CONFIRMED' THEN 'PLANET'
                           WHEN id % 2 = 0 THEN 'MAYBE' END AS label FROM obs) l) o""")
def manual_rows(spark, sf):
    """Manual records (here: V_OBS rows typed in through the manual
    form schema, candidates with an unknown or no label) are validated, and
    valid ones are mapped so that they train."""
    from corvid.sources import io
    o = views.obs(spark, sf)
    recs = o.select(F.col("id"), F.col("period").alias("koi_period"), F.col("duration").alias("koi_duration"),
                    F.col("depth").alias("koi_depth"), F.col("prad").alias("koi_prad"),
                    F.col("snr").alias("koi_model_snr"), F.col("st_teff").alias("koi_steff"),
                    F.col("st_rad").alias("koi_srad"),
                    F.when(F.col("disposition") == "FALSE POSITIVE", "NOT_PLANET")
                    .when(F.col("disposition") == "CONFIRMED", "PLANET").when(F.col("id") % 2 == 0, "MAYBE").alias("label"))
    return io.validate_manual(recs)


@key("best_iteration", """, lg AS (SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS iter,
    CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) / count(*) AS loss FROM orders GROUP BY 1)
SELECT iter AS best_iter, loss AS best_logloss FROM lg ORDER BY loss, iter LIMIT 1""")
def best_iteration(spark, sf):
    """A log of one loss per iteration (here: the share of finished orders
    in each month) is written tab-separated, read back, and its best iteration
    found; of equal losses the earliest."""
    from corvid.sources import io
    from corvid.sources.tables import load
    when = F.col("o_orderdate")
    log = load(spark, sf, "orders").groupBy((F.year(when) * 12 + F.month(when)).cast("int").alias("iter")) \
        .agg((F.count_if(F.col("o_orderstatus") == "F").cast("double") / F.count(F.lit(1))).alias("Logloss"))
    path = scratch_dir(spark, f"log-{uuid.uuid4().hex}")
    io.write_training_log(log, path)
    return io.best_iteration(io.read_training_log(spark, path), "Logloss", "iter", "min")


@key("boosting_log")
def boosting_log(spark, sf):
    """A16 on a real log: validation loss of a boosted model after each of 200
    rounds, written, read back, best iteration."""
    from corvid.operators import boosting as B
    from corvid.sources import io
    p = {**M.PRESETS["gbt"], "maxIter": 200}
    m = B.fit(split_sig(spark, sf).cache(), FEATS, "gbt", M.boosting_params(p, "gbt"), held=F.col("split") == "test")[0]
    log = spark.createDataFrame([(i + 1, v) for i, v in enumerate(m.held_loss[1:])], "iter int, Logloss double")
    path = scratch_dir(spark, f"log-{uuid.uuid4().hex}")
    io.write_training_log(log, path)
    return io.best_iteration(io.read_training_log(spark, path), "Logloss", "iter", "min")


@key("score_record")
def score_record(spark, sf):
    """K1: one feature map (the first V_SIG row by id) scored by the same
    path as the batch."""
    sp, models = _three_models(spark, sf)
    first = sp.where(F.col("split") == "test").orderBy("id").limit(1).select(*FEATS).first().asDict()
    return S.score_record(spark, models, first)
