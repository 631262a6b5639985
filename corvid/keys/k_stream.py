"""Keys for the streaming forms (S1, S2); the tests assert that each equals
its batch form (A8, K2) on the same files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corvid.keys import key
from corvid.keys.k_models import NB_ROWS, rounded, split_sig
from corvid.keys.k_sources import _BATCHES_SQL, _batches
from corvid.keys.splits_sql import gaussian_nb_sql, split_sql
from corvid.operators import models as M
from corvid.session import scratch_dir
from corvid.sources import views
from corvid.streaming import stream as ST


@key("stream_append", _BATCHES_SQL + "SELECT DISTINCT * FROM (SELECT * FROM b1 UNION ALL SELECT * FROM b2) u")
def stream_append(spark, sf):
    """Two overlapping uploads of V_OBS land as files; the stream appends
    them to the master without duplicates (equals master_append)."""
    root = scratch_dir(spark, f"stream-append-{uuid.uuid4().hex}")
    b1, b2 = _batches(spark, sf)
    b1.write.parquet(f"{root}/drop/b1")
    b2.write.parquet(f"{root}/drop/b2")
    schema = b1.schema
    q = ST.continuous_master_append(spark, f"{root}/drop/*", schema, f"{root}/master", f"{root}/ckpt")
    ST.run_to_end(q)
    return ST.read_master(spark, f"{root}/master")


@key("stream_score", split_sql("sig", "sp", 0.2, 42) + gaussian_nb_sql("sp", "nb", views.OBS_FEATURES)
     + NB_ROWS.format(label=""))
def stream_score(spark, sf):
    """New V_SIG rows are scored by a saved model as they land (naive Bayes,
    whose scores SQL states in closed form)."""
    root = scratch_dir(spark, f"stream-score-{uuid.uuid4().hex}")
    sp = split_sig(spark, sf).cache()
    feats = views.OBS_FEATURES
    m = M.fit(sp.where(F.col("split") == "train"), feats, "nb")
    M.save(m, f"{root}/model")
    test = sp.where(F.col("split") == "test").select("id", *feats)
    test.write.parquet(f"{root}/drop")
    q = ST.continuous_scoring(spark, f"{root}/drop", test.schema, f"{root}/model", f"{root}/out", f"{root}/ckpt")
    ST.run_to_end(q)
    return rounded(spark.read.parquet(f"{root}/out"))
