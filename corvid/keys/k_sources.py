"""Keys for sources, sinks and set operations (A, H, C4)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corvid.keys import key
from corvid.keys.shapes import koi_like
from corvid.operators.setops import anti_join_seen, drop_exact_duplicates, union_by_name
from corvid.operators.standardize import extract, standardize
from corvid.session import scratch_dir
from corvid.keys.shapes import toi_like
from corvid.sources import io, views
from corvid.sources.tables import table_path


@key("scan_obs", "SELECT * FROM obs")
def scan_obs(spark, sf):
    return views.obs(spark, sf)


@key("scan_optional", "SELECT o_orderkey, o_orderstatus FROM orders")
def scan_optional(spark, sf):
    schema = "o_orderkey long, o_orderstatus string"
    present = io.read_optional(spark, table_path(sf, "orders"), schema).select("o_orderkey", "o_orderstatus")
    absent = io.read_optional(spark, table_path(sf, "no_such_table"), schema)
    return present.unionByName(absent)


@key("union_tagged", """
SELECT 'orders' AS source_dataset, o_orderkey, CAST(NULL AS BIGINT) AS c_custkey FROM orders
UNION ALL
SELECT 'customer' AS source_dataset, CAST(NULL AS BIGINT) AS o_orderkey, c_custkey FROM customer
""")
def union_tagged(spark, sf):
    paths = {"orders": table_path(sf, "orders"), "missing": table_path(sf, "no_such_table"),
             "customer": table_path(sf, "customer")}
    return io.read_many_tagged(spark, paths).select("source_dataset", "o_orderkey", "c_custkey")


_KOI_SQL_CTE = None


def _koi_cte():
    from corvid.keys.shapes import KOI_SQL
    return f", koi AS ({KOI_SQL})\n"


@key("extract_cols", _koi_cte() + """SELECT kepoi_name, koi_disposition, koi_pdisposition, koi_period,
       koi_duration, koi_prad, koi_depth, koi_model_snr FROM koi""")
def extract_cols(spark, sf):
    return extract(koi_like(spark, sf), "koi")


@key("csv_text_rows", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def csv_text_rows(spark, sf):
    """The header names the columns in another order and has further ones."""
    o = spark.read.parquet(table_path(sf, "orders"))
    lines = o.select(F.to_csv(F.struct("o_totalprice", "o_custkey", "o_orderkey", "o_orderstatus")).alias("value"))
    head = spark.createDataFrame([(' O_TOTALPRICE,"o_custkey", o_orderkey ,o_orderstatus',)], "value string")
    return io.csv_text_to_table(head.unionByName(lines), "o_orderkey long, o_orderstatus string, o_totalprice double")


@key("csv_text_by_place", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def csv_text_by_place(spark, sf):
    """A6 without a header line."""
    o = spark.read.parquet(table_path(sf, "orders"))
    lines = o.select(F.to_csv(F.struct("o_orderkey", "o_orderstatus", "o_totalprice")).alias("value"))
    return io.csv_text_to_table(lines, "o_orderkey long, o_orderstatus string, o_totalprice double", header=False)


@key("scan_csv", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 100000")
def scan_csv(spark, sf):
    """A1 on CSV: the orders are written as CSV with a header and read back,
    with the columns and the filter given to the scan."""
    path = scratch_dir(spark, f"csv-{uuid.uuid4().hex}")
    spark.read.parquet(table_path(sf, "orders")).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice") \
        .write.option("header", True).csv(path)
    return io.read_table(spark, path, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double", "csv") \
        .where("o_totalprice > 100000").select("o_orderkey", "o_orderstatus", "o_totalprice")


_BATCHES_SQL = """
, b1 AS (SELECT * FROM obs WHERE disposition IN ('FALSE POSITIVE', 'CANDIDATE'))
, b2 AS (SELECT * FROM obs WHERE disposition IN ('CONFIRMED', 'CANDIDATE'))
"""


def _batches(spark, sf):
    o = views.obs(spark, sf)
    return (o.where(F.col("disposition").isin("FALSE POSITIVE", "CANDIDATE")),
            o.where(F.col("disposition").isin("CONFIRMED", "CANDIDATE")))


@key("master_append", _BATCHES_SQL + "SELECT DISTINCT * FROM (SELECT * FROM b1 UNION ALL SELECT * FROM b2) u")
def master_append(spark, sf):
    b1, b2 = _batches(spark, sf)
    return io.append_master(b2, b1)


@key("append_anti", _BATCHES_SQL + "SELECT * FROM b2 EXCEPT SELECT * FROM b1")
def append_anti(spark, sf):
    b1, b2 = _batches(spark, sf)
    return anti_join_seen(b2, b1)


@key("drop_dups", "SELECT DISTINCT * FROM (SELECT * FROM obs UNION ALL SELECT * FROM obs) u")
def drop_dups(spark, sf):
    o = views.obs(spark, sf)
    return drop_exact_duplicates(o.unionByName(o))


def _toi_std_sql():
    from corvid.keys.shapes import TOI_SQL
    return f""", toi AS ({TOI_SQL}),
toi_std AS (
  SELECT toi AS id,
         CASE upper(coalesce(tfopwg_disp, 'nan'))
           WHEN 'PC' THEN '1' WHEN 'KP' THEN '1' WHEN 'CONFIRMED' THEN '1' WHEN 'CANDIDATE' THEN '1'
           WHEN 'FP' THEN '0' WHEN 'FALSE POSITIVE' THEN '0' ELSE upper(coalesce(tfopwg_disp, 'nan')) END AS label,
         pl_orbper AS period, pl_trandurh AS duration, pl_trandep AS depth, pl_rade AS prad,
         CAST(NULL AS DOUBLE) AS snr, st_teff, st_rad
  FROM toi)
"""


@key("union_by_name", _toi_std_sql() + """
SELECT CAST(id AS VARCHAR) AS id, period, CAST(NULL AS VARCHAR) AS label FROM obs
UNION ALL
SELECT id, CAST(NULL AS DOUBLE) AS period, label FROM toi_std
""")
def union_by_name_key(spark, sf):
    a = views.obs(spark, sf).select("id", "period")
    b = standardize(toi_like(spark, sf), "toi").select("id", "label")
    return union_by_name([a, b])


@key("history_last10", "SELECT event_id, user_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def history_last10(spark, sf):
    ev = spark.read.parquet(table_path(sf, "events"))
    return io.last_runs(ev.select("event_id", "user_id", "value", "ts"), 10, "ts", "event_id").select(
        "event_id", "user_id", "value")


def _fresh(spark, name):
    return scratch_dir(spark, f"{name}-{uuid.uuid4().hex}")


@key("land_once", "SELECT id, disposition, true AS landed FROM obs WHERE disposition = 'CONFIRMED'")
def land_once_key(spark, sf):
    """A5: the first landing stays, a second one to the same place does nothing."""
    o, path = views.obs(spark, sf).select("id", "disposition"), _fresh(spark, "landed")
    first = io.land_once(o.where("disposition = 'CONFIRMED'"), path)
    second = io.land_once(o, path)
    return spark.read.parquet(path).withColumn("landed", F.lit(first and not second))


@key("last_upload", _BATCHES_SQL + "SELECT * FROM b2")
def last_upload(spark, sf):
    """Two stored uploads and no master: training reads the later one."""
    root = _fresh(spark, "uploads")
    b1, b2 = _batches(spark, sf)
    io.write_snapshot(b2, root, "20240102_000000")
    io.write_snapshot(b1, root, "20240101_235959")
    return io.resolve_training_source(spark, root + "-master", root)


@key("current_master", _BATCHES_SQL + "SELECT DISTINCT * FROM (SELECT * FROM b1 UNION ALL SELECT * FROM b2) u")
def current_master(spark, sf):
    """A second version of the master replaces the first and goes before uploads."""
    root = _fresh(spark, "master")
    b1, b2 = _batches(spark, sf)
    io.write_versioned(io.append_master(b1, None), root)
    io.write_versioned(io.append_master(b2, io.read_versioned(spark, root)), root)
    return io.resolve_training_source(spark, root, root + "-uploads")


@key("result_table", "SELECT disposition, count(*) AS n FROM obs GROUP BY disposition")
def result_table(spark, sf):
    """Counts written as one CSV table with a header and read back."""
    path = _fresh(spark, "counts")
    io.write_result_table(views.obs(spark, sf).groupBy("disposition").agg(F.count(F.lit(1)).alias("n")), path)
    return io.read_table(spark, path, "disposition string, n long", "csv")


@key("report_lines", """
SELECT printf('%12s %9.4f %9.4f %9.4f %9d', o_orderstatus, count(*) FILTER (WHERE o_totalprice > 150000) / 100000,
              0.0, 0.25, count(*)) AS value FROM orders GROUP BY o_orderstatus""")
def report_lines(spark, sf):
    """Report rows as text lines, nulls as zero."""
    o = spark.read.parquet(table_path(sf, "orders"))
    report = o.groupBy(F.col("o_orderstatus").alias("label")).agg(
        (F.count_if(F.col("o_totalprice") > 150000) / F.lit(100000.0)).alias("precision"),
        F.lit(None).cast("double").alias("recall"), F.lit(0.25).alias("f1"), F.count(F.lit(1)).alias("support"))
    path = _fresh(spark, "report")
    io.report_text(report, path)
    return spark.read.text(path)
