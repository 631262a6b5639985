"""Plan checks: per-class windows are salted, data never funnels through a
single-partition window, scans are pruned."""

from pyspark.sql import functions as F

from corvid.operators import evaluate as E
from corvid.operators import prep
from corvid.sources import views
from tests.conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_split_windows_are_salted(spark):
    sp = prep.stratified_split(views.sig(spark, SF_SMALL).select("id", "label"), test_size=0.2)
    plan = _plan(sp)
    assert "_salt_b" in plan
    for line in plan.splitlines():
        if "Window [" in line and "row_number()" in line:
            assert "_salt_b" in line, line


def test_obs_scan_is_pruned(spark):
    o = views.obs(spark, SF_SMALL).select("id", "snr")
    plan = o._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in plan and "l_comment" not in plan


def test_auc_single_partition_only_on_bounded_tables(spark):
    s = views.sig(spark, SF_SMALL).withColumn("score", (F.col("snr") / 20000.0))
    plan = _plan(E.roc_auc(s))
    # the single-partition window runs over the per-bucket totals (_bk) only
    for line in plan.splitlines():
        if "Window [" in line and "unboundedpreceding" in line.lower() and "_bk" not in line:
            assert "partitionBy" in line or "_bk" in line, line
