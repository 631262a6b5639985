"""Fixed scorers compared on rows per distinct score: what is kept does not grow with the view."""

from corvid.keys import k_evaluate as K
from corvid.operators import evaluate as E
from corvid.sources import views
from tests.conftest import SF_SMALL


def test_counts_stand_for_all_rows(spark):
    n = views.sig(spark, SF_SMALL).count()
    counts = K.scorer_counts(spark, SF_SMALL).toPandas()
    assert (counts.groupby("model").n.sum() == n).all() and set(counts.model) == set(K.SCORERS)
    assert not counts.duplicated(["model", "score", "pred", "label"]).any()
    assert counts.groupby("model").score.nunique().max() <= 101 and len(counts) < 5 * n


def test_area_of_counted_rows_is_that_of_the_rows(spark):
    rows = [("a", 0.1, 0), ("a", 0.1, 1), ("a", 0.7, 1), ("a", 0.7, 1), ("a", 0.2, 0), ("b", 0.5, 1), ("b", float("nan"), 0), ("b", 0.5, 0)]
    df = spark.createDataFrame(rows, "model string, score double, label int")
    few = df.groupBy("model", "score", "label").count().withColumnRenamed("count", "n")

    def areas(got):
        return {r.model: r.auc for r in got.collect()}
    assert areas(E.roc_auc(few, group_cols=["model"], count="n")) == areas(E.roc_auc(df, group_cols=["model"])) == {"a": 0.75, "b": 0.5}
