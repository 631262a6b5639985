"""Keys for standardize, label policies, filters, selection (B) and scalar
functions (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvid.functions import labels as L
from corvid.functions import scalar as S
from corvid.keys import key
from corvid.keys.shapes import (K2_SQL, KOI_SQL, LABEL_TEXT_SQL, TOI_SQL, k2_like, koi_like, label_text,
                                toi_like)
from corvid.keys.sqlgen import sig, sig_sql, unpivot_sql
from corvid.operators import select as SEL
from corvid.operators.profile import class_share
from corvid.operators.standardize import standardize
from corvid.sources import views
from corvid.sources.tables import load

KOI_CTE = f", koi AS ({KOI_SQL})\n"
TOI_CTE = f", toi AS ({TOI_SQL})\n"
K2_CTE = f", k2 AS ({K2_SQL})\n"
LT_CTE = f", lt AS ({LABEL_TEXT_SQL})\n"


def _replace_sql(col: str, mapping: dict) -> str:
    up = f"upper(coalesce({col}, 'nan'))"
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {up} {whens} ELSE {up} END"


def _std_sql(table: str, source: str, cols: dict) -> str:
    label = _replace_sql(cols["label"], L.REPLACE_MAPS[source])
    out = [f"CAST({cols['id']} AS VARCHAR) AS id", f"{label} AS label"]
    for name in ("period", "duration", "depth", "prad", "snr", "st_teff", "st_rad"):
        src = cols.get(name)
        out.append(f"{src} AS {name}" if src else f"CAST(NULL AS DOUBLE) AS {name}")
    return f"SELECT {', '.join(out)} FROM {table}"


_KOI_STD = dict(id="kepoi_name", label="koi_disposition", period="koi_period", duration="koi_duration",
                depth="koi_depth", prad="koi_prad", snr="koi_model_snr")
_TOI_STD = dict(id="toi", label="tfopwg_disp", period="pl_orbper", duration="pl_trandurh",
                depth="pl_trandep", prad="pl_rade", st_teff="st_teff", st_rad="st_rad")
_K2_STD = dict(id="pl_name", label="disposition", period="pl_orbper", duration="pl_trandur",
               depth="pl_trandepl", prad="pl_rade", st_teff="st_teff", st_rad="st_rad")


# --- B1-B4 --------------------------------------------------------------------------
@key("std_koi", KOI_CTE + _std_sql("koi", "koi", _KOI_STD))
def std_koi(spark, sf):
    return standardize(koi_like(spark, sf), "koi")


@key("std_toi", TOI_CTE + _std_sql("toi", "toi", _TOI_STD))
def std_toi(spark, sf):
    return standardize(toi_like(spark, sf), "toi")


@key("std_k2", K2_CTE + _std_sql("k2", "k2", _K2_STD))
def std_k2(spark, sf):
    return standardize(k2_like(spark, sf), "k2")


# --- B5 / B6 / B7 ----------------------------------------------------------------------
@key("find_label", "SELECT id, disposition AS label_source FROM obs")
def find_label(spark, sf):
    o = views.obs(spark, sf)
    c = L.find_label_column(o)
    return o.select("id", F.col(c).alias("label_source"))


_GENERAL_SQL = """CASE WHEN disp IS NULL THEN NULL
  WHEN TRY_CAST(trim(disp) AS DOUBLE) IN (0.0, 1.0) THEN CAST(TRY_CAST(trim(disp) AS DOUBLE) AS INTEGER)
  WHEN contains(upper(disp), 'FALSE') OR contains(upper(disp), ' FP') OR trim(upper(disp)) = 'FP' THEN 0
  ELSE 1 END"""


@key("label_general", LT_CTE + f"SELECT id, CAST({_GENERAL_SQL} AS INTEGER) AS label FROM lt")
def label_general(spark, sf):
    return L.map_label(label_text(spark, sf), "disp", "general").select("id", "label")


@key("label_contains", LT_CTE + """SELECT id, CASE WHEN contains(upper(coalesce(disp, 'NAN')), 'CONFIRMED')
  OR contains(upper(coalesce(disp, 'NAN')), 'CANDIDATE') THEN 1 ELSE 0 END AS label FROM lt""")
def label_contains(spark, sf):
    return L.map_label(label_text(spark, sf), "disp", "contains").select("id", "label")


@key("label_in", LT_CTE + "SELECT id, CASE WHEN disp IN ('CANDIDATE', 'CONFIRMED') THEN 1 ELSE 0 END AS label FROM lt")
def label_in(spark, sf):
    return L.map_label(label_text(spark, sf), "disp", "in").select("id", "label")


@key("label_strict", LT_CTE + """SELECT id, CAST(CASE upper(disp) WHEN 'CANDIDATE' THEN 1 WHEN 'CONFIRMED' THEN 1
  WHEN 'FALSE POSITIVE' THEN 0 END AS INTEGER) AS label FROM lt""")
def label_strict(spark, sf):
    return L.map_label(label_text(spark, sf), "disp", "strict").select("id", "label")


@key("label_replace", LT_CTE + f"SELECT id, {_replace_sql('disp', L.REPLACE_MAPS['koi'])} AS label FROM lt")
def label_replace(spark, sf):
    return L.map_label(label_text(spark, sf), "disp", "replace", source="koi").select("id", "label")


@key("filter_binary", TOI_CTE + f", ts AS ({_std_sql('toi', 'toi', _TOI_STD)})\n"
     "SELECT id, CAST(label AS INTEGER) AS label FROM ts WHERE TRY_CAST(label AS INTEGER) IN (0, 1)")
def filter_binary(spark, sf):
    return L.binary_filter(standardize(toi_like(spark, sf), "toi")).select("id", "label")


# --- B8-B17 ----------------------------------------------------------------------------------
_F = views.OBS_FEATURES
_PRESENT = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in _F)


@key("min_present", f"SELECT id FROM obs WHERE {_PRESENT} >= 2")
def min_present(spark, sf):
    return SEL.min_present(views.obs(spark, sf), _F, 2).select("id")


@key("drop_any_null", "SELECT id FROM obs WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _F))
def drop_any_null(spark, sf):
    return SEL.drop_any_null(views.obs(spark, sf), _F).select("id")


_KOI_COLS = ["kepid", "kepoi_name", "koi_disposition", "koi_pdisposition", "koi_period", "koi_duration",
             "koi_depth", "koi_prad", "koi_model_snr", "koi_steff", "koi_srad", "koi_teq", "koi_insol",
             "koi_score", "ra"]
_KOI_NUMERIC = [c for c in _KOI_COLS if c not in ("kepoi_name", "koi_disposition", "koi_pdisposition")]
_EXCLUDED = ["koi_disposition"] + SEL.API_EXCLUDE


@key("exclude_cols", KOI_CTE + "SELECT " + ", ".join(c for c in _KOI_COLS if c not in _EXCLUDED) + " FROM koi")
def exclude_cols(spark, sf):
    return SEL.exclude_cols(koi_like(spark, sf), _EXCLUDED)


@key("numeric_cols", KOI_CTE + "SELECT " + ", ".join(_KOI_NUMERIC) + " FROM koi")
def numeric_cols(spark, sf):
    k = koi_like(spark, sf)
    return k.select(*SEL.numeric_cols(k))


def _safe_sql():
    excl = " OR ".join(f"contains(lower(feature), '{p}')" for p in SEL.EXCLUDE_PATTERNS)
    safe = " OR ".join(f"starts_with(lower(feature), '{p}')" for p in SEL.SAFE_PREFIXES)
    inner = unpivot_sql(_KOI_NUMERIC, "CAST(count({c}) AS DOUBLE) / count(*)", "koi", "present_frac")
    return (KOI_CTE + f", st AS ({inner})\n"
            f"SELECT feature, position, round(present_frac, 4) AS present_frac, "
            f"CAST((NOT ({excl})) AND ({safe}) AND present_frac >= 0.5 AS INTEGER) AS kept FROM st")


@key("select_safe", _safe_sql())
def select_safe(spark, sf):
    t = SEL.select_safe(koi_like(spark, sf))
    return t.select("feature", "position", F.round("present_frac", 4).alias("present_frac"), "kept")


def _priority_sql():
    present = [c for c in SEL.PRIORITY_FEATURES if c in _KOI_COLS]
    inner = unpivot_sql(present, "round((1.0 - CAST(count({c}) AS DOUBLE) / count(*)) * 100, 4)", "koi",
                        "missing_pct")
    return (KOI_CTE + f", st AS ({inner})\n"
            "SELECT feature, position, missing_pct, "
            "CAST((1.0 - missing_pct / 100) * 100 < 80.0 AS INTEGER) AS kept FROM st")


@key("select_priority", _priority_sql())
def select_priority(spark, sf):
    return SEL.priority_table(koi_like(spark, sf))


_VAR_COLS = ["koi_period", "koi_duration", "koi_depth", "koi_prad", "koi_model_snr", "koi_steff",
             "koi_srad", "koi_score"]


@key("variance_filter", KOI_CTE + f", st AS ({unpivot_sql(_VAR_COLS, 'var_pop({c})', 'koi', 'variance')})\n"
     f"SELECT feature, position, {sig_sql('variance')} AS variance, "
     "CAST(coalesce(variance, 0.0) > 0 AS INTEGER) AS kept FROM st")
def variance_filter(spark, sf):
    t = SEL.variance_filter(koi_like(spark, sf), _VAR_COLS)
    return t.select("feature", "position", sig("variance").alias("variance"), "kept")


@key("top_variance", f", st AS ({unpivot_sql(_F, 'var_samp({c})', 'obs', 'variance')})\n"
     f"SELECT feature, position, {sig_sql('variance')} AS variance FROM st "
     "ORDER BY variance DESC NULLS LAST, position LIMIT 30")
def top_variance(spark, sf):
    t = SEL.top_variance(views.obs(spark, sf), _F, 30)
    return t.select("feature", "position", sig("variance").alias("variance"))


@key("align_features", "SELECT id, period, 0.0::DOUBLE AS koi_teq, depth, snr FROM obs")
def align_features(spark, sf):
    return SEL.align_features(views.obs(spark, sf), ["period", "koi_teq", "depth", "snr"], keep=["id"])


# --- I: scalar functions --------------------------------------------------------------------------
def num_text(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    pr = F.col("o_orderpriority")
    p = F.col("o_totalprice").cast("string")
    txt = (F.when(pr == "1-URGENT", F.lit("abc"))
           .when(pr == "2-HIGH", F.concat(F.lit(" "), p, F.lit(" ")))
           .when(pr == "3-MEDIUM", F.lit(""))
           .when(pr == "4-NOT SPECIFIED", F.lit("1e3"))
           .when(pr == "5-LOW", F.lit("NaN"))
           .otherwise(p))
    return o.select(F.col("o_orderkey").alias("id"), txt.alias("txt"))


NUM_TEXT_CTE = """
, nt AS (SELECT o_orderkey AS id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'abc' WHEN '2-HIGH' THEN ' ' || CAST(o_totalprice AS VARCHAR) || ' '
    WHEN '3-MEDIUM' THEN '' WHEN '4-NOT SPECIFIED' THEN '1e3' WHEN '5-LOW' THEN 'NaN'
    ELSE CAST(o_totalprice AS VARCHAR) END AS txt FROM orders)
"""
_TO_NUM_SQL = ("CASE WHEN isnan(TRY_CAST(trim(txt) AS DOUBLE)) THEN NULL "
               "ELSE TRY_CAST(trim(txt) AS DOUBLE) END")


@key("to_number", NUM_TEXT_CTE + f"SELECT id, {_TO_NUM_SQL} AS value FROM nt")
def to_number(spark, sf):
    return num_text(spark, sf).select("id", S.to_number("txt").alias("value"))


@key("blank_to_zero", NUM_TEXT_CTE + f"SELECT id, coalesce({_TO_NUM_SQL}, 0.0) AS value FROM nt")
def blank_to_zero(spark, sf):
    return num_text(spark, sf).select("id", S.blank_to_zero("txt").alias("value"))


@key("label_to_int", LT_CTE + "SELECT id, coalesce(CAST(trunc(TRY_CAST(trim(disp) AS DOUBLE)) AS INTEGER), 0) AS label FROM lt")
def label_to_int(spark, sf):
    return label_text(spark, sf).select("id", S.label_to_int("disp").alias("label"))


_ENG_SQL = f"""
SELECT id, round(ln(1 + period), 4) AS log_period, round(ln(1 + duration), 4) AS log_duration,
       round(ln(1 + depth), 4) AS log_depth,
       round(period / (duration + CAST(1e-6 AS DOUBLE)), 4) AS period_duration_ratio,
       {sig_sql('depth * prad')} AS depth_prad_product,
       {sig_sql('pow(st_rad, 2) * pow(st_teff / 5778.0, 4)')} AS stellar_luminosity
FROM obs"""


@key("engineer_features", _ENG_SQL)
def engineer_features(spark, sf):
    e = S.engineer_features(views.obs(spark, sf))
    e = e.withColumn("_dp", F.col("depth_prad_product")).withColumn("_sl", F.col("stellar_luminosity"))
    return e.select("id", *[F.round(c, 4).alias(c) for c in ("log_period", "log_duration", "log_depth",
                                                           "period_duration_ratio")],
                    sig("_dp").alias("depth_prad_product"), sig("_sl").alias("stellar_luminosity"))


@key("finite_or_null", """SELECT id, CASE WHEN st_rad IS NULL THEN NULL WHEN st_rad >= 7 THEN NULL
  ELSE snr END AS value FROM obs""")
def finite_or_null(spark, sf):
    o = views.obs(spark, sf)
    raw = (F.when(F.col("st_rad").isNull(), F.lit(float("nan")))
           .when(F.col("st_rad") >= 7, F.lit(float("inf"))).otherwise(F.col("snr")))
    return o.select("id", S.finite_or_null(raw).alias("value"))


@key("format_pct", LT_CTE + f""", g AS (SELECT CAST({_GENERAL_SQL} AS INTEGER) AS label FROM lt),
c AS (SELECT label, count(*) AS n FROM g GROUP BY label)
SELECT label, CASE WHEN pct IS NOT NULL THEN printf('%.2f%%', pct * 100) ELSE 'N/A' END AS pct_text
FROM (SELECT label, round(n * 100.0 / sum(n) OVER (), 4) / 100 AS pct FROM c) z""")
def format_pct(spark, sf):
    g = L.map_label(label_text(spark, sf), "disp", "general")
    share = class_share(g, "label")
    return share.select("label", S.format_pct(F.col("pct") / 100).alias("pct_text"))


_DEFAULT_PARAMS = {"k": "0", "depth": "6", "rate": "0.1"}


@key("params_merge", """SELECT event_id, coalesce(json_extract_string(props, '$.k'), '0') AS k,
  coalesce(json_extract_string(props, '$.depth'), '6') AS depth,
  coalesce(json_extract_string(props, '$.rate'), '0.1') AS rate FROM events""")
def params_merge(spark, sf):
    ev = load(spark, sf, "events").select("event_id", "props")
    user = F.from_json("props", "map<string,string>")
    defaults = F.create_map(*[x for kv in _DEFAULT_PARAMS.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    merged = F.map_concat(F.map_filter(defaults, lambda k, v: ~F.array_contains(F.map_keys(user), k)), user)
    return ev.select("event_id", *[merged[k].alias(k) for k in _DEFAULT_PARAMS])


_MODEL_NAMES = ["Logistic Regression", "Random Forest", "XGBoost", "HistGradientBoosting", "Gradient Boosting",
                "CatBoost", "Support Vector Machine", "K-Nearest Neighbors", "Decision Tree", "AdaBoost",
                "Naive Bayes", "Stacking"]


@key("flops_formula", """, c AS (SELECT count(*) AS n, CAST(ceil(CAST(0.2 AS DOUBLE) * count(*)) AS BIGINT) AS n_test
  FROM sig),
m AS (SELECT * FROM (VALUES """ + ", ".join(f"('{m}')" for m in _MODEL_NAMES) + """) t(model))
SELECT model, n - n_test AS n_train, n_test, CAST(7 AS BIGINT) AS n_features,
  CAST(CASE WHEN model = 'Logistic Regression' THEN 7 * 2 * n_test
    WHEN model IN ('Random Forest', 'XGBoost', 'HistGradientBoosting', 'Gradient Boosting') THEN 10 * 7 * 100 * n_test
    WHEN model = 'CatBoost' THEN 6 * 7 * 100 * n_test
    WHEN model = 'Support Vector Machine' THEN (n - n_test) * 7 * n_test
    WHEN model = 'K-Nearest Neighbors' THEN (n - n_test) * 7 * n_test * 5
    WHEN model = 'Decision Tree' THEN 15 * 7 * n_test
    WHEN model = 'AdaBoost' THEN 1 * 7 * 100 * n_test
    WHEN model = 'Naive Bayes' THEN 7 * n_test ELSE 0 END AS BIGINT) AS flops
FROM c, m""")
def flops_formula(spark, sf):
    s = views.sig(spark, sf)
    c = s.agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("n_test", F.ceil(F.lit(0.2) * F.col("n")).cast("long"))
    rows = c.select(F.explode(F.array(*[F.lit(m) for m in _MODEL_NAMES])).alias("model"),
                    (F.col("n") - F.col("n_test")).alias("n_train"), "n_test",
                    F.lit(len(views.OBS_FEATURES)).cast("long").alias("n_features"))
    return rows.withColumn("flops", S.flops_estimate("model", "n_train", "n_test", "n_features"))



@key("min_rows", """
SELECT n, (SELECT count(*) FROM obs) >= n AS enough FROM (SELECT unnest([1, 10, 1000000000000]) AS n) t""")
def min_rows(spark, sf):
    """Reads no more rows than the wanted number."""
    o = views.obs(spark, sf)
    return spark.createDataFrame([(n, SEL.has_min_rows(o, n)) for n in (1, 10)], "n long, enough boolean").unionByName(
        o.agg(F.lit(1000000000000).alias("n"), (F.count(F.lit(1)) >= F.lit(1000000000000)).alias("enough")))


@key("class_texts", """
SELECT o_orderkey, CASE WHEN o_totalprice / 400000 > 0.5 THEN 1 ELSE 0 END AS cls,
  CASE WHEN o_totalprice / 400000 > 0.5 THEN 'PLANET' ELSE 'NOT_PLANET' END AS planet,
  CASE WHEN o_totalprice / 400000 > 0.5 THEN 'EXOPLANET' ELSE 'FALSE_POSITIVE' END AS exoplanet,
  round_even(o_orderkey / 2, 0) AS halves, o_totalprice / nullif(o_custkey % 7, 0) * 1000.0 AS ms FROM orders""")
def class_texts(spark, sf):
    """I10, I11, I12, I16 over every order; no rows, no time per row."""
    o = load(spark, sf, "orders").withColumn("cls", S.threshold_class(F.col("o_totalprice") / 400000))
    return o.select("o_orderkey", "cls", S.planet_text("cls").alias("planet"), S.exoplanet_text("cls").alias("exoplanet"),
                    S.round_half_even(F.col("o_orderkey") / 2).alias("halves"),
                    S.per_sample_ms("o_totalprice", F.col("o_custkey") % 7).alias("ms"))
