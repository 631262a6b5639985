"""Label policies on hand-made edge cases (every policy, padded, mixed
case, codes, numeric text, null, unknown)."""


from corvid.functions import labels as L

CASES = [None, "", " fp ", "CFP", "FP", "KP FP", "False Positive", "FALSE_POSITIVE", "0", "1.0",
         "REFUTED", "NOT CANDIDATE", "candidate", "CONFIRMED", "CANDIDATE", "FALSE POSITIVE"]


def _apply(spark, policy, source="koi"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(CASES)], "i int, v string")
    out = L.map_label(df, "v", policy, "y", source).orderBy("i").collect()
    return {CASES[r["i"]]: r["y"] for r in out}


def test_general(spark):
    got = _apply(spark, "general")
    assert got[None] is None
    assert got[" fp "] == 0 and got["FP"] == 0 and got["KP FP"] == 0
    assert got["CFP"] == 1            # no space before FP and not exactly FP
    assert got["False Positive"] == 0 and got["FALSE_POSITIVE"] == 0
    assert got["0"] == 0 and got["1.0"] == 1
    assert got["REFUTED"] == 1 and got["NOT CANDIDATE"] == 1 and got[""] == 1


def test_contains_in_strict(spark):
    c = _apply(spark, "contains")
    assert c[None] == 0 and c["candidate"] == 1 and c["NOT CANDIDATE"] == 1 and c["FP"] == 0
    i = _apply(spark, "in")
    assert i["candidate"] == 0 and i["CANDIDATE"] == 1 and i[None] == 0
    s = _apply(spark, "strict")
    assert s["candidate"] == 1 and s["FALSE POSITIVE"] == 0 and s["False Positive"] == 0
    assert s["FALSE_POSITIVE"] is None and s[None] is None and s["REFUTED"] is None


def test_replace_keeps_unmapped_text(spark):
    r = _apply(spark, "replace", "koi")
    assert r["candidate"] == "1" and r["FALSE_POSITIVE"] == "0"
    assert r[None] == "NAN" and r["REFUTED"] == "REFUTED"
    t = _apply(spark, "replace", "toi")
    assert t["FP"] == "0" and t["CFP"] == "CFP"
    df = spark.createDataFrame([(v,) for v in ["1", "0", "NAN", "APC"]], "label string")
    kept = sorted(r[0] for r in L.binary_filter(df).collect())
    assert kept == [0, 1]


def test_find_label_column(spark):
    df = spark.createDataFrame([(1, "a", "b")], "kepid long, koi_pdisposition string, koi_disposition string")
    assert L.find_label_column(df) == "koi_pdisposition"
    assert L.find_label_column(df, L.LABEL_PREFERENCE) == "koi_disposition"
    assert L.find_label_column(df.select("kepid")) is None
