"""Rule ledger against DuckDB and brute force; language identification on held-out rows."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from corvid.llm import ecoc_language as L
from corvid.llm import queries, rule_ledger

SMALL = "/root/testdata/sf0.001"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = Counter(grams)
    rep = {i + o for i, g in enumerate(grams) if seen[g] > 1 for o in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(rep))


TEXTS = [None, "", " \n\t ", "a", "a b", "a b c", "a a a a a", "a b c a b c", "a b c d a b c\nx\nx\n\n \nx", "x " * 5000,
         "é ü ###$$ <a> | b", "ÀÉ B", "l1\x0bl2\x0cl3\r\nl1\nl3\nl1", "one two three four " * 40, "𝒳 𝒴 𝒵 𝒳 𝒴 𝒵", "\x1c\x85 q \xa0"]


def test_ledger_equals_brute_force(spark):
    df = spark.createDataFrame([(i, t, 5, "w") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int, failed string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rule_ledger.judge(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_query_equals_brute_force_and_oracle(spark):
    import pyarrow.parquet as pq
    rows = queries.QUERIES["op6_rule_ledger"](spark, SMALL).collect()
    t = dict(zip(*[pq.read_table(f"{SMALL}/documents.parquet")[c].to_pylist() for c in ("doc_id", "text")]))
    for r in rows:
        want = brute(t[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    d = con.execute(queries.ORACLE["op6_rule_ledger"])
    names = [c[0] for c in d.description]
    assert sorted(tuple(r[n] for n in names) for r in rows) == sorted(d.fetchall())


def test_plan_is_native(spark):
    plan = queries.QUERIES["op6_rule_ledger"](spark, SMALL)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_policies_and_ablation(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (3,), (4,), (12,), (16,)], "failed long")
    got = {r.rule: (r.n_failed, r.n_alone, r.n_rejected) for r in rule_ledger.ablation(df, "v1").collect()}
    assert got == {"few_words": (2, 1, 5), "repeated_windows": (2, 1, 5), "symbols": (2, 1, 5), "duplicate_lines": (1, 0, 5)}
    assert df.filter(rule_ledger.passes("v1")).count() == 2 and df.filter(rule_ledger.passes("v2")).count() == 1


def test_clean_documents_are_kept(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    j = rule_ledger.judge(docs).join(labels, "doc_id").filter("NOT base_failed").toPandas()
    assert j[j.quality == 1].kept.mean() > 0.99
    assert j[j.quality == 0].kept.mean() < 0.3


def test_rule_edges(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "doc_id long, text string")
    assert [(r.doc_id, r.n_words, r.kept) for r in rule_ledger.judge(df).collect()] == [(None, 0, False)] * 2
    assert rule_ledger.judge(df.limit(0)).count() == 0


# ---- language ------------------------------------------------------------

@pytest.mark.parametrize("n", [2, 3, 4, 6, 9, 40])
def test_codewords_differ_in_many_bits(n):
    c = L.codebook(n)
    d = [(c[i] != c[j]).sum() for i in range(n) for j in range(i)]
    assert min(d) >= max(1, c.shape[1] // 5)


def test_grams_do_not_depend_on_slices(monkeypatch):
    text = "Abc dé, fgh 12 ij! " * 30
    whole = np.bincount(np.concatenate(list(L.grams(text))), minlength=L.BUCKETS)
    assert whole.sum() > 500
    monkeypatch.setattr(L, "SLICE", 100)
    parts = np.bincount(np.concatenate(list(L.grams(text))), minlength=L.BUCKETS)
    assert abs(whole - parts).sum() < 0.15 * whole.sum()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op7_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").toPandas()
    assert got.score.between(0, 1).all() and len(got) == 1000
    held = got[got.held_out & got.lang.notna()]
    assert len(held) > 150 and (held.lang == held.lang_pred).mean() > 0.97
    import zlib
    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2)).all()


def test_language_edges(spark):
    df = spark.createDataFrame([(1, "the cat and the dog", "en", 1), (2, "der hund und die katze", "de", 2), (None, "the", "en", 3),
                                (4, None, "en", 4), (5, "123 !?", None, 5), (6, "", "de", 6), (1, "the cat and the dog", "en", 1)],
                               "doc_id long, text string, lang string, score int")
    m = L.fit(df)
    got = {r.doc_id: r for r in L.identify(df, m).collect()}
    assert m.languages == ["de", "en"] and got[1].lang_pred == "en" and got[2].lang_pred == "de"
    assert got[4].lang_pred == got[5].lang_pred == got[6].lang_pred == "und" and got[None].lang_pred in ("en", "de")
    none = L.fit(df.limit(0))
    assert {r.lang_pred for r in L.identify(df, none).collect()} == {"und"}
    one = L.fit(df.filter("lang = 'en'"))
    assert {(r.lang_pred, r.score) for r in L.identify(df.filter("doc_id = 2"), one).collect()} == {("en", 1.0)}
