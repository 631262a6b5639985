"""Model quality floors, save/load, scoring alignment, streaming equals
batch, set operations and sources."""

import uuid

import pytest
from pyspark.sql import functions as F

from corvid.operators import models as M
from corvid.operators import prep
from corvid.operators import score as S
from corvid.operators.evaluate import binary_metrics
from corvid.operators.setops import anti_join_seen, drop_exact_duplicates, union_by_name
from corvid.session import scratch_dir
from corvid.sources import io, views
from tests.conftest import SF_SMALL

FEATS = views.OBS_FEATURES


@pytest.fixture(scope="module")
def split(spark):
    return prep.stratified_split(views.sig(spark, SF_SMALL), test_size=0.2, seed=42).cache()


@pytest.mark.parametrize("family,params,floor", [
    ("dt", {"maxDepth": 6}, 0.8), ("rf", {"numTrees": 20, "maxDepth": 8}, 0.8),
    ("gbt", {"maxIter": 10}, 0.8), ("logreg", {}, 0.6), ("nb", {}, 0.55)])
def test_quality_floor_on_planted_label(spark, split, family, params, floor):
    m = M.fit(split.where("split = 'train'"), FEATS, family, params)
    s = M.score(m, split.where("split = 'test'"))
    met = binary_metrics(s, "label", "prediction", "p1").first()
    assert met["accuracy"] >= floor, met


def test_save_load_and_alignment(spark, split):
    m = M.fit(split.where("split = 'train'"), FEATS, "dt", {"maxDepth": 5})
    path = scratch_dir(spark, f"t-model-{uuid.uuid4().hex}")
    M.save(m, path)
    back = M.load(path)
    test = split.where("split = 'test'")
    a = M.score(m, test).select("id", F.col("prediction").alias("a"))
    b = M.score(back, test).select("id", F.col("prediction").alias("b"))
    assert a.join(b, "id").where("a != b").count() == 0
    # missing feature -> 0.0, extra ignored, unlabelled rows are kept
    t2 = test.drop("st_rad", "label").withColumn("junk", F.lit("x"))
    out = S.single_score(m, t2, keep=("id",))
    assert out.count() == test.count()


@pytest.mark.parametrize("family,params", [
    ("adaboost", {"rounds": 3}), ("stacking", {"numTrees": 3, "folds": 2, "maxDepth": 3})])
def test_ensembles_save_load_and_batch_score(spark, split, family, params):
    m = M.fit(split.where("split = 'train'"), FEATS, family, params)
    assert M.feature_names(m) == FEATS and len(M.importances(m)) == len(FEATS)
    path = scratch_dir(spark, f"t-model-{uuid.uuid4().hex}")
    M.save(m, path, {"policy": "general"})
    assert M.metadata(spark, path)["policy"] == "general"
    back = M.load(path)
    test = split.where("split = 'test'")
    a = M.score(m, test).select("id", F.col("p1").alias("a"))
    b = M.score(back, test).select("id", F.col("p1").alias("b"))
    assert a.join(b, "id").where("a != b").count() == 0
    t2 = test.drop("st_rad", "label").withColumn("junk", F.lit("x"))
    assert S.batch_score({"x": m, "y": back}, t2).where("pred_x = pred_y").count() == test.count()
    st = {r["model"]: r for r in M.status(spark, {"x": path, "none": f"{path}-none"}).collect()}
    assert st["x"]["trained"] and not st["none"]["trained"]
    assert st["x"]["n_train"] == split.where("split = 'train'").count()


def test_fit_takes_nan_as_missing(spark, split):
    tr = split.where("split = 'train'").withColumn("snr", F.when(F.col("id") % 3 == 0, float("nan")).otherwise(F.col("snr")))
    m = M.fit(tr, FEATS, "logreg", {"maxIter": 5})
    assert M.score(m, tr).where("isnan(p1) or p1 is null").count() == 0


def test_smote_balance_fills_and_scales(spark):
    # neighbours by the scaled features: along `small`, not along the wide `big`
    rows = [(i, float(i % 2) * 1000 + i % 7, float(i // 2), 1) for i in range(12)]
    rows += [(100 + i, float(i), float(i), 0) for i in range(40)] + [(90, None, 5.0, 1)]
    df = spark.createDataFrame(rows, "id long, big double, small double, label int").withColumn("empty", F.lit(None).cast("double"))
    out = prep.balance(df, "smote", ["big", "small", "empty"]).cache()
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == {0: 40, 1: 40}
    assert out.where("big is null or small is null or empty is not null").count() == 0
    assert out.where("id < 0").dropDuplicates(["big", "small"]).count() > 20


def test_null_labels_leave_splits_and_folds(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2) for i in range(50)], "id long, label int")
    assert prep.stratified_split(df).count() == 40 and prep.kfold(df, 3).count() == 40


def test_all_null_feature_leaves_by_name(spark, split):
    tr = split.where("split = 'train'").withColumn("empty", F.lit(None).cast("double"))
    m = M.fit(tr, FEATS + ["empty"], "dt", {"maxDepth": 3})
    assert M.feature_names(m) == FEATS
    assert [n for n, _ in M.importances(m)] == FEATS


def test_ensemble_vote_half_even(spark):
    df = spark.createDataFrame([(1, 0, 1, 0.4, 0.6), (2, 1, 1, 0.7, 0.9)], "id int, a int, b int, pa double, pb double")
    r = {x["id"]: x for x in S.ensemble_vote(df, ["a", "b"], ["pa", "pb"]).collect()}
    assert r[1]["vote"] == 0 and r[2]["vote"] == 1 and r[1]["p1_mean"] == pytest.approx(0.5)


def test_stream_append_equals_batch(spark):
    from corvid.keys.k_sources import master_append
    from corvid.keys.k_stream import stream_append
    a = stream_append(spark, SF_SMALL)
    b = master_append(spark, SF_SMALL)
    assert a.count() == b.count() == a.unionByName(b).distinct().count()


def test_setops(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "id long, v string")
    b = spark.createDataFrame([("abc", 1.5)], "id string, w double")
    u = union_by_name([a, b])
    assert dict(u.dtypes)["id"] == "string" and u.count() == 3
    d = drop_exact_duplicates(a.unionByName(a))
    assert d.count() == 2                            # nulls compare equal
    new = spark.createDataFrame([(2, None), (3, "z")], "id long, v string")
    assert [r["id"] for r in anti_join_seen(new, a).collect()] == [3]


def test_sources(spark, tmp_path):
    miss = io.read_optional(spark, str(tmp_path / "nope.csv"), "a int")
    assert miss.count() == 0 and miss.columns == ["a"]
    lines = spark.createDataFrame([(" 1, x ",), ("",), ("2,y",)], "value string")
    t = io.csv_text_to_table(lines, "a int, b string").orderBy("a").collect()
    assert [(r["a"], r["b"]) for r in t] == [(1, "x"), (2, "y")]
    rec = io.manual_rows(spark, [dict(koi_period=1.0, koi_duration=2.0, koi_depth=3.0, koi_prad=4.0,
                                      label="PLANET")])
    assert rec.first()["koi_disposition"] == "CONFIRMED"
    with pytest.raises(ValueError):
        io.manual_rows(spark, [dict(koi_period=1.0, label="PLANET")])
    log = spark.createDataFrame([(1, 0.8, 0.5), (2, 0.9, 0.4), (3, 0.85, 0.3)], "iter int, AUC double, Logloss double")
    assert io.best_iteration(log).first()["best_iter"] == 2


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and 0.0 <= rows[0]["accuracy"] <= 1.0


def test_sinks_and_resolve(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    root = str(tmp_path / "raw")
    io.write_snapshot(df, root, "20240101_000000")
    io.write_snapshot(df.limit(1), root, "20240102_000000")
    last = io.resolve_training_source(spark, str(tmp_path / "master"), root)
    assert last.count() == 1
    io.write_versioned(df, str(tmp_path / "master"))
    assert io.resolve_training_source(spark, str(tmp_path / "master"), root).count() == 2
    assert io.land_once(df, str(tmp_path / "land")) is True
    assert io.land_once(df, str(tmp_path / "land")) is False
    io.write_result_table(df, str(tmp_path / "res"))
    assert spark.read.option("header", True).csv(str(tmp_path / "res")).count() == 2
    from corvid.operators.select import has_min_rows
    assert has_min_rows(df, 2) and not has_min_rows(df, 3)


def test_report_text(spark, tmp_path):
    from corvid.operators.evaluate import class_report
    df = spark.createDataFrame([(1, 1), (0, 1), (0, 0)], "label int, pred int")
    io.report_text(class_report(df), str(tmp_path / "rep"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "rep")).collect()]
    assert len(lines) == 5 and any("weighted avg" in x for x in lines)


def test_stream_append_across_many_micro_batches(spark):
    from corvid.keys.k_sources import _batches
    from corvid.streaming import stream as ST
    root = scratch_dir(spark, f"t-stream-{uuid.uuid4().hex}")
    b1, b2 = _batches(spark, SF_SMALL)
    b1.repartition(3).write.parquet(f"{root}/drop/b1")
    b2.repartition(3).write.parquet(f"{root}/drop/b2")
    q = ST.continuous_master_append(spark, f"{root}/drop/*", b1.schema, f"{root}/master", f"{root}/ckpt",
                                    max_files_per_trigger=1)
    ST.run_to_end(q)
    got = ST.read_master(spark, f"{root}/master")
    parts = spark.read.parquet(f"{root}/master").select("_batch").distinct().count()
    assert parts > 1                                     # several micro-batches ran
    want = io.append_master(b2, b1)
    assert got.count() == want.count() == got.unionByName(want).distinct().count()


def test_right_size_bounds(spark):
    df = spark.range(0, 100_000, numPartitions=40)
    assert M.right_size(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism   # coalesced
    one = spark.range(0, 100_000, numPartitions=1)
    assert M.right_size(one).rdd.getNumPartitions() == min(spark.sparkContext.defaultParallelism, 20)
    tiny = spark.range(0, 3_000, numPartitions=1)
    assert M.right_size(tiny).rdd.getNumPartitions() == 1       # not worth splitting


def test_validate_manual(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0, "PLANET"), (None, 1.0, 1.0, 1.0, "PLANET"),
                                (1.0, 1.0, 1.0, 1.0, "MAYBE")],
                               "koi_period double, koi_duration double, koi_depth double, koi_prad double, label string")
    v = [r["valid"] for r in io.validate_manual(df).collect()]
    assert v == [True, False, False]


def test_validate_manual_null_and_invalid_labels(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0, None), (1.0, 1.0, 1.0, 1.0, "MAYBE"), (1.0, 1.0, 1.0, 1.0, "NOT_PLANET")],
                               "koi_period double, koi_duration double, koi_depth double, koi_prad double, label string")
    got = [(r["valid"], r["koi_disposition"]) for r in io.validate_manual(df).collect()]
    assert got == [(False, None), (False, None), (True, "FALSE POSITIVE")]


def test_csv_upload_header_is_no_row(spark):
    lines = spark.createDataFrame([("a, b",), ("1,x",), (" ",), ("2,b",)], "value string")
    assert sorted(map(tuple, io.csv_text_to_table(lines, "a int, b string").collect())) == [(1, "x"), (2, "b")]


def test_csv_upload_takes_columns_by_name(spark):
    def read(*lines):
        df = spark.createDataFrame([(x,) for x in lines], "value string")
        return sorted(map(tuple, io.csv_text_to_table(df, "a int, b string").collect()))
    assert read("1,x,9", 'B, "extra" ,a', "b,extra,a", "x,9,1", "y,,2") == [(1, "x"), (2, "y"), (9, "1")]
    assert read("z,A,b", "5,1,x") == [(1, "x")]
    assert read("1,x", "2,b") == [(1, "x"), (2, "b")]           # no header
    with pytest.raises(ValueError, match="different orders"):
        read("a,b", "1,x", "b,a")
    three = spark.createDataFrame([("a,b",), ("1,2",)], "value string")
    with pytest.raises(ValueError, match="lacks"):
        io.csv_text_to_table(three, "a int, b int, c int")


def test_tagged_sources_are_read_or_fail(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "x.parquet"))
    got = io.read_many_tagged(spark, {"x": str(tmp_path / "x.parquet"), "y": str(tmp_path / "y.parquet")})
    assert got.count() == 3 and got.columns[0] in ("id", "source_dataset")
    with pytest.raises(ValueError):
        io.read_many_tagged(spark, {"y": str(tmp_path / "y.parquet")})
    (tmp_path / "bad.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        io.read_many_tagged(spark, {"x": str(tmp_path / "x.parquet"), "bad": str(tmp_path / "bad.parquet")}).count()


def test_bundle_ranks_importances(spark):
    from corvid.operators.evaluate import eval_bundle
    df = spark.createDataFrame([(0, 0, 0.2), (1, 1, 0.9), (1, 0, 0.4)], "label int, pred int, score double")
    b = eval_bundle(df, importances=[("b", 0.2), ("a", 0.2), ("c", 0.6), ("d", 0.0)], top=3)
    assert b["importance"] == [("c", 0.6), ("a", 0.2), ("b", 0.2)] and eval_bundle(df)["importance"] == []


def test_optional_table_keeps_the_given_schema(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("code\n007\n")
    assert [r.code for r in io.read_optional(spark, str(p), "code string").collect()] == ["007"]


def test_versions_change_by_one_rename(spark, tmp_path):
    root = str(tmp_path / "m")
    assert io.read_versioned(spark, root) is None
    for n in (1, 2, 3):
        io.write_versioned(spark.range(n), root)
        assert io.read_versioned(spark, root).count() == n
    (tmp_path / "m" / "CURRENT").rename(tmp_path / "gone")
    with pytest.raises(RuntimeError):
        io.read_versioned(spark, root)


def test_recommend_takes_the_shortest_time(spark):
    from corvid.operators import rank
    df = spark.createDataFrame([("slow", 0.9, 10.0), ("quick", 0.8, 1.0)], "model string, roc_auc double, train_s double")
    assert sorted(map(tuple, rank.recommend(df, "roc_auc", "train_s").collect())) == [("best", "slow"), ("fastest", "quick")]


def test_label_to_int_of_odd_numbers(spark):
    from pyspark.sql import functions as F
    from corvid.functions import scalar as S
    df = spark.createDataFrame([("NaN",), ("1e12",), (" 2.9 ",), ("x",), (None,)], "t string")
    assert [r.l for r in df.select(S.label_to_int(F.col("t")).alias("l")).collect()] == [0, 0, 2, 0, 0]
