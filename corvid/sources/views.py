"""Fixture views built from the driver tables.

* ``obs``  (V_OBS): one row per order, transit-like features from the order's
  line items, a three-valued text disposition from the order status.  Orders
  without lines keep null features (a real source of nulls).
* ``imb``  (V_IMB): labelled documents, text features, imbalanced label.
* ``sig``  (V_SIG): ``obs`` plus a planted label that the features predict.

Features are built from exact integer sums and one final division, so they
are bit-identical on any engine and in any summation order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.functions.hashing import md5_number
from corvid.sources.tables import load

OBS_FEATURES = ["period", "duration", "depth", "prad", "snr", "st_teff", "st_rad"]
IMB_FEATURES = ["n_chars", "n_words", "mean_word_len", "digit_share"]
SIG_THRESHOLD = 9700.0


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    # money in integer cents (and cent x basis-point products), summed exactly,
    # then one division: the same IEEE result on every engine and in any
    # summation order, so no rounding is needed.
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    disc_bp = F.round(F.col("l_discount") * 100).cast("long")
    per_order = li.groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("_q"),
        F.sum(cents).alias("_c"),
        F.sum(cents * disc_bp).alias("_cd"),
        F.count("l_orderkey").alias("_n"),
    ).select(
        "l_orderkey",
        F.col("_q").alias("period"),
        (F.col("_q") / F.col("_n")).alias("duration"),
        (F.col("_c").cast("double") / 100.0).alias("depth"),
        (F.col("_c").cast("double") / F.col("_n") / 100.0).alias("prad"),
        (F.col("_cd").cast("double") / 10000.0).alias("snr"),
        F.col("_n").cast("double").alias("st_rad"),
    )
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    disp = (F.when(F.col("o_orderstatus") == "F", "FALSE POSITIVE")
            .when(F.col("o_orderstatus") == "O", "CONFIRMED")
            .otherwise("CANDIDATE"))
    # Both sides are keyed by order; the aggregate side is already hash
    # partitioned on l_orderkey, so the join reuses that exchange.
    return (o.join(per_order, o.o_orderkey == per_order.l_orderkey, "left")
            .select(F.col("o_orderkey").alias("id"), disp.alias("disposition"),
                    "period", "duration", "depth", "prad", "snr",
                    F.col("o_totalprice").alias("st_teff"), "st_rad"))


def imb(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality")
    text = F.col("text")
    n_len = F.length(text)
    n_sep = (n_len - F.length(F.replace(text, F.lit(" "), F.lit("")))
             + n_len - F.length(F.replace(text, F.lit("\n"), F.lit(""))))
    n_words = n_sep + 1
    n_digits = n_len - F.length(F.regexp_replace(text, "[0-9]", ""))
    return (docs.join(labels, "doc_id", "inner")
            .select(F.col("doc_id").alias("id"),
                    F.col("quality").cast("int").alias("label"),
                    F.col("n_chars").cast("double").alias("n_chars"),
                    n_words.cast("double").alias("n_words"),
                    ((n_len - n_sep) / n_words).alias("mean_word_len"),
                    F.when(n_len > 0, n_digits / n_len).otherwise(F.lit(0.0)).alias("digit_share")))


def sig(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = obs(spark, sf_dir)
    planted = (F.coalesce(F.col("snr"), F.lit(0.0)) > SIG_THRESHOLD).cast("int")
    flip = (md5_number(F.md5(F.col("id").cast("string"))) % 10) == 0
    label = F.when(flip, F.lit(1) - planted).otherwise(planted)
    return base.withColumn("label", label.cast("int"))


# ---------------------------------------------------------------------------
# The same views in DuckDB SQL, used by the oracle side of every query key.
# ---------------------------------------------------------------------------
OBS_SQL = """
SELECT o.o_orderkey AS id,
       CASE o.o_orderstatus WHEN 'F' THEN 'FALSE POSITIVE' WHEN 'O' THEN 'CONFIRMED'
            ELSE 'CANDIDATE' END AS disposition,
       li.period, li.duration, li.depth, li.prad, li.snr,
       o.o_totalprice AS st_teff, li.st_rad
FROM orders o LEFT JOIN (
  SELECT l_orderkey, _q AS period, _q / _n AS duration,
         CAST(_c AS DOUBLE) / 100.0 AS depth, CAST(_c AS DOUBLE) / _n / 100.0 AS prad,
         CAST(_cd AS DOUBLE) / 10000.0 AS snr, CAST(_n AS DOUBLE) AS st_rad
  FROM (SELECT l_orderkey, sum(l_quantity) AS _q,
               sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS _c,
               sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT)) AS _cd,
               count(l_orderkey) AS _n
        FROM lineitem GROUP BY l_orderkey) a) li ON o.o_orderkey = li.l_orderkey
"""

IMB_SQL = """
SELECT id, label, n_chars, n_words,
       (n_len - n_sep) / n_words AS mean_word_len,
       CASE WHEN n_len > 0 THEN n_digits / n_len ELSE 0.0 END AS digit_share
FROM (
  SELECT d.doc_id AS id, CAST(l.quality AS INTEGER) AS label,
         CAST(d.n_chars AS DOUBLE) AS n_chars,
         CAST(length(d.text) AS DOUBLE) AS n_len,
         CAST((length(d.text) - length(replace(d.text, ' ', '')))
              + (length(d.text) - length(replace(d.text, chr(10), ''))) AS DOUBLE) AS n_sep,
         CAST((length(d.text) - length(replace(d.text, ' ', '')))
              + (length(d.text) - length(replace(d.text, chr(10), ''))) + 1 AS DOUBLE) AS n_words,
         CAST(length(d.text) - length(regexp_replace(d.text, '[0-9]', '', 'g')) AS DOUBLE) AS n_digits
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id) t
"""

SIG_SQL = f"""
SELECT *, CAST(CASE WHEN (('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 8))::BIGINT % 10) = 0
                    THEN 1 - planted ELSE planted END AS INTEGER) AS label
FROM (SELECT *, CASE WHEN coalesce(snr, 0.0) > {SIG_THRESHOLD} THEN 1 ELSE 0 END AS planted
      FROM ({OBS_SQL}) o) s
"""


def with_views(sql: str) -> str:
    """Prefix a query with the three views as CTEs (obs, imb, sig)."""
    sig_cols = "id, disposition, period, duration, depth, prad, snr, st_teff, st_rad, label"
    return (f"WITH obs AS ({OBS_SQL}),\n imb AS ({IMB_SQL}),\n"
            f" sig AS (SELECT {sig_cols} FROM ({SIG_SQL}) x)\n{sql}")
