"""Every stage of the pipeline against a brute-force version on its own input."""

import hashlib

import pytest

import corpus_pipeline as C
from corvid.llm import rule_ensemble
from tests.llm import test_rules_language as rules
from tests.llm import test_simhash as sim
from tests.llm import test_super_kmers as sub
from tests.llm import test_tokens as tok

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, f in C.STAGES:
        got = C.materialise(f(spark, docs, SMALL), "test-stage")
        out.append((name, docs, got))
        docs = got
    return {n: (a, b) for n, a, b in out}


def _texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(staged):
    for name, (a, b) in staged.items():
        assert name == "best-fit packing" or (b.columns == a.columns and b.dtypes == a.dtypes)


def test_classifier_stage(spark, staged):
    a, b = staged["quality classifier"]
    model = rule_ensemble.fit(a, spark.read.parquet(f"{SMALL}/labels.parquet"))
    want = {r.doc_id for r in rule_ensemble.score(a, model).filter("predicted = 1").collect()}
    assert {r.doc_id for r in b.collect()} == want and 0 < len(want) < a.count()
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    clean = a.join(labels.filter("quality = 1"), "doc_id")
    assert clean.join(b, "doc_id", "left_anti").count() <= 0.03 * clean.count()


def test_rules_stage(staged):
    a, b = staged["quality rules"]
    kept = _texts(b)
    for d, t in _texts(a).items():
        n, chars, symbols, _, rep = rules.brute(t)
        upper = sum(c.isupper() for c in t or "")
        bad = n < 50 or 100 * rep > 50 * n or 100 * symbols > 40 * n or 100 * upper > 60 * chars or chars > 30 * n or chars < 2 * n
        if bad:
            assert d not in kept
        elif d not in kept:
            lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
            assert 100 * (len(lines) - len(set(lines))) > 60 * len(lines)


def test_near_dedup_stage(staged):
    a, b = staged["SimHash near-dedup"]
    comp = sim.brute_components({d: sim.brute_fp(t) for d, t in _texts(a).items()})
    assert sorted(r.doc_id for r in b.collect()) == sorted(set(comp.values()))


def test_substring_stage(staged):
    a, b = staged["substring dedup"]
    old, new = _texts(a), _texts(b)
    for d, _, lost, sha in sub.brute(list(old.items()), 35):
        assert hashlib.sha256(b" ".join((new[d] or "").encode().split())).hexdigest() == sha
        assert lost or new[d] == old[d]
    assert all(r.n_chars == len(r.text) for r in b.collect())


def test_packing_stage(staged):
    a, b = staged["best-fit packing"]
    texts = _texts(a)
    ids = dict(zip(texts, tok._library(list(texts.values()))))
    tok._check_packing(b.collect(), {d: len(x) + 1 for d, x in ids.items()}, 4096)


def test_run_equals_its_stages(spark, staged):
    got = {(r.doc_id, r.piece, r.ids_crc32) for r in C.run(spark, SMALL).collect()}
    assert got == {(r.doc_id, r.piece, r.ids_crc32) for r in staged["best-fit packing"][1].collect()}


def test_stages_on_odd_rows(spark):
    long_text = " ".join(f"w{i}ord" for i in range(60))
    rows = [(1, long_text, "en", "s", 9, "x"), (1, long_text, "en", "s", 9, "x"), (2, None, None, None, None, "x"), (None, long_text + " end", None, "s", 1, "x"),
            (None, None, None, None, None, None), (3, "", "en", "s", 0, "x"), (4, "short", "en", "s", 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string")
    for name, f in C.STAGES[1:-1]:
        got = f(spark, docs, SMALL)
        assert got.columns == docs.columns and f(spark, docs.limit(0), SMALL).count() == 0
        if name == "quality rules":
            assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "1", "None"]
        if name == "SimHash near-dedup":
            assert sorted(str(r.doc_id) for r in got.collect())[:3] == ["1", "2", "4"]
            assert got.filter("doc_id = 1").count() == 1
        if name == "substring dedup":
            assert {r.text for r in got.filter("doc_id = 1").collect()} == {""}
    kept = C.STAGES[0][1](spark, docs.limit(0), SMALL)
    assert kept.count() == 0 and kept.columns == docs.columns
