"""Source-shaped views derived from the driver tables.

The driver data has no survey tables, so three survey-shaped tables are
derived from ``orders`` / ``lineitem`` (through V_OBS) with the column
names of the three survey sources; the text labels use the order status
and priority to cover mapped, unmapped, padded and lower-case values.
Each has a DuckDB twin used by the oracle SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.sources import views
from corvid.sources.tables import load


def koi_like(spark: SparkSession, sf: str) -> DataFrame:
    o = views.obs(spark, sf)
    idc = F.col("id")
    return o.select(
        idc.alias("kepid"),
        F.concat(F.lit("K"), idc.cast("string")).alias("kepoi_name"),
        F.col("disposition").alias("koi_disposition"),
        F.col("disposition").alias("koi_pdisposition"),
        F.col("period").alias("koi_period"), F.col("duration").alias("koi_duration"),
        F.col("depth").alias("koi_depth"), F.col("prad").alias("koi_prad"),
        F.col("snr").alias("koi_model_snr"), F.col("st_teff").alias("koi_steff"),
        F.col("st_rad").alias("koi_srad"),
        F.when(F.col("st_rad") >= 7, F.col("st_teff")).alias("koi_teq"),
        F.when(F.col("st_rad") >= 4, F.col("snr")).alias("koi_insol"),
        F.lit(1.0).alias("koi_score"),
        F.col("st_rad").alias("ra"),
    )


KOI_SQL = """
SELECT id AS kepid, 'K' || CAST(id AS VARCHAR) AS kepoi_name,
       disposition AS koi_disposition, disposition AS koi_pdisposition,
       period AS koi_period, duration AS koi_duration, depth AS koi_depth, prad AS koi_prad,
       snr AS koi_model_snr, st_teff AS koi_steff, st_rad AS koi_srad,
       CASE WHEN st_rad >= 7 THEN st_teff END AS koi_teq,
       CASE WHEN st_rad >= 4 THEN snr END AS koi_insol,
       1.0::DOUBLE AS koi_score, st_rad AS ra
FROM obs
"""


def toi_like(spark: SparkSession, sf: str) -> DataFrame:
    o = views.obs(spark, sf)
    return o.select(
        F.concat(F.col("id").cast("string"), F.lit(".01")).alias("toi"),
        F.when(F.col("disposition") == "FALSE POSITIVE", "FP")
        .when(F.col("disposition") == "CONFIRMED", "PC").otherwise("APC").alias("tfopwg_disp"),
        F.col("period").alias("pl_orbper"), F.col("duration").alias("pl_trandurh"),
        F.col("depth").alias("pl_trandep"), F.col("prad").alias("pl_rade"),
        F.col("st_teff").alias("st_teff"), F.col("st_rad").alias("st_rad"))


TOI_SQL = """
SELECT CAST(id AS VARCHAR) || '.01' AS toi,
       CASE disposition WHEN 'FALSE POSITIVE' THEN 'FP' WHEN 'CONFIRMED' THEN 'PC' ELSE 'APC' END AS tfopwg_disp,
       period AS pl_orbper, duration AS pl_trandurh, depth AS pl_trandep, prad AS pl_rade,
       st_teff, st_rad
FROM obs
"""


def k2_like(spark: SparkSession, sf: str) -> DataFrame:
    o = views.obs(spark, sf)
    return o.select(
        F.concat(F.lit("EPIC "), F.col("id").cast("string")).alias("pl_name"),
        F.when(F.col("disposition") == "FALSE POSITIVE", "FALSE_POSITIVE?")
        .when(F.col("disposition") == "CONFIRMED", "CONFIRMED").otherwise("candidate").alias("disposition"),
        F.col("period").alias("pl_orbper"), F.col("duration").alias("pl_trandur"),
        F.col("depth").alias("pl_trandepl"), F.col("prad").alias("pl_rade"),
        F.col("st_teff").alias("st_teff"), F.col("st_rad").alias("st_rad"))


K2_SQL = """
SELECT 'EPIC ' || CAST(id AS VARCHAR) AS pl_name,
       CASE disposition WHEN 'FALSE POSITIVE' THEN 'FALSE_POSITIVE?' WHEN 'CONFIRMED' THEN 'CONFIRMED'
            ELSE 'candidate' END AS disposition,
       period AS pl_orbper, duration AS pl_trandur, depth AS pl_trandepl, prad AS pl_rade,
       st_teff, st_rad
FROM obs
"""


def label_text(spark: SparkSession, sf: str) -> DataFrame:
    """Varied disposition text per order: exact, lower-case, padded, code,
    numeric text, null and unknown values."""
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    base = (F.when(F.col("o_orderstatus") == "F", "FALSE POSITIVE")
            .when(F.col("o_orderstatus") == "O", "CONFIRMED").otherwise("CANDIDATE"))
    pr = F.col("o_orderpriority")
    raw = (F.when(pr == "1-URGENT", F.when(F.col("o_orderstatus") == "F", F.lit("FP"))
                  .when(F.col("o_orderstatus") == "O", F.lit("1.0")).otherwise(F.lit("0")))
           .when(pr == "2-HIGH", F.lower(base))
           .when(pr == "3-MEDIUM", F.concat(F.lit(" "), base, F.lit(" ")))
           .when(pr == "4-NOT SPECIFIED", F.when(F.col("o_orderstatus") == "F", F.lit(None).cast("string"))
                 .when(F.col("o_orderstatus") == "O", F.lit("KP FP")).otherwise(F.lit("REFUTED")))
           .otherwise(base))
    return o.select(F.col("o_orderkey").alias("id"), raw.alias("disp"))


LABEL_TEXT_SQL = """
SELECT o_orderkey AS id,
  CASE o_orderpriority
    WHEN '1-URGENT' THEN CASE o_orderstatus WHEN 'F' THEN 'FP' WHEN 'O' THEN '1.0' ELSE '0' END
    WHEN '2-HIGH' THEN lower(CASE o_orderstatus WHEN 'F' THEN 'FALSE POSITIVE' WHEN 'O' THEN 'CONFIRMED' ELSE 'CANDIDATE' END)
    WHEN '3-MEDIUM' THEN ' ' || (CASE o_orderstatus WHEN 'F' THEN 'FALSE POSITIVE' WHEN 'O' THEN 'CONFIRMED' ELSE 'CANDIDATE' END) || ' '
    WHEN '4-NOT SPECIFIED' THEN CASE o_orderstatus WHEN 'F' THEN NULL WHEN 'O' THEN 'KP FP' ELSE 'REFUTED' END
    ELSE (CASE o_orderstatus WHEN 'F' THEN 'FALSE POSITIVE' WHEN 'O' THEN 'CONFIRMED' ELSE 'CANDIDATE' END)
  END AS disp
FROM orders
"""


def fixed_score(c_snr: str = "snr"):
    """A fixed-formula score in [0, 1] with many ties: floor(snr / 200) / 100,
    capped at 1; identical IEEE arithmetic in Spark and DuckDB."""
    return F.least(F.floor(F.coalesce(F.col(c_snr), F.lit(0.0)) / 200.0), F.lit(100)).cast("double") / 100.0


FIXED_SCORE_SQL = "CAST(least(floor(coalesce(snr, 0.0) / 200.0), 100) AS DOUBLE) / 100.0"


def scored_sig(spark: SparkSession, sf: str) -> DataFrame:
    """V_SIG with the fixed score and its strict 0.5 threshold class.
    Evaluation reads it several times (counts, score buckets, running sums),
    so the narrow result is persisted (memory and disk) once."""
    s = views.sig(spark, sf)
    return (s.withColumn("score", fixed_score())
            .withColumn("pred", (F.col("score") > 0.5).cast("int"))
            .select("id", "label", "score", "pred").persist())


SCORED_SIG_SQL = f"""
SELECT *, CAST(score > 0.5 AS INTEGER) AS pred
FROM (SELECT *, {FIXED_SCORE_SQL} AS score FROM sig) z
"""
