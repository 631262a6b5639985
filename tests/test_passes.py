"""Keys that fit and score evaluate their view once, however many passes follow."""

import pytest
from pyspark.sql import functions as F

from corvid.keys import k_explain, k_models, k_stream
from corvid.operators import models as M
from corvid.operators import prep
from corvid.sources import views
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("run", [k_stream.stream_score, k_explain.shapley_boosted, k_models.retrain_one, k_models.score_record],
                         ids=["stream_score", "shapley_boosted", "retrain_one", "score_record"])
def test_the_view_is_evaluated_once(spark, monkeypatch, run):
    spark.catalog.clearCache()
    rows, seen = views.sig(spark, SF_SMALL).count(), spark.sparkContext.accumulator(0)

    @F.udf("double")
    def noted(x):
        seen.add(1)
        return x

    view, medians, fit_median = views.sig, [], prep.fit_median
    monkeypatch.setattr(views, "sig", lambda *a: view(*a).withColumn("snr", noted.asNondeterministic()("snr")))
    monkeypatch.setattr(prep, "fit_median", lambda *a: medians.append(1) or fit_median(*a))
    monkeypatch.setitem(M.PRESETS, "gbt", {**M.PRESETS["gbt"], "maxIter": 3})
    run(spark, SF_SMALL).collect()
    assert seen.value == rows and len(medians) <= 1
    spark.catalog.clearCache()
