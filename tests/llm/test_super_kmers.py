"""Substring dedup against counting every window of every document."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from corvid.llm import queries, super_kmers

SMALL = "/root/testdata/sf0.001"


def brute(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def _rows(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    text = lambda k: [rng.choice(vocab) for _ in range(k)]
    shared = [text(rng.randrange(5, 60)) for _ in range(5)]
    rows = []
    for i in range(n):
        w = text(rng.randrange(0, 40))
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(shared)
            a = rng.randrange(len(p))
            at = rng.randrange(len(w) + 1)
            w[at:at] = p[a:a + rng.randrange(1, 50)]
        rows.append((i, " ".join(w)))
    same = " ".join(["a"] * 60)
    return rows + [(900, same), (901, "x " + same), (902, " ".join(["p", "q", "r"] * 30)), (903, None), (904, ""), (905, "one\ttwo"),
                   (906, "é \x85 z " * 20), (907, "é \x85 z " * 20), (907, "é \x85 z " * 20), (None, rows[3][1] + " tail"), (None, None)]


@pytest.mark.parametrize("seed,window,mini,hot", [(1, 10, 3, 4000), (2, 10, 3, 3), (3, 7, 1, 2), (4, 35, 8, 4000), (5, 5, 5, 4000)])
def test_against_brute_force(spark, seed, window, mini, hot, monkeypatch):
    monkeypatch.setattr(super_kmers.removals, "__defaults__", ("doc_id", "text", 35, mini, hot))
    rows = _rows(seed)
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, kept string, k int")
    got = sorted(map(tuple, super_kmers.dedup_report(df, window=window).collect()), key=str)
    assert got == brute(rows, window)


def test_query(spark):
    import pyarrow.parquet as pq
    t = pq.read_table(f"{SMALL}/documents.parquet")
    rows = list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))
    got = sorted(map(tuple, queries.QUERIES["op9_super_kmers"](spark, SMALL).collect()), key=str)
    want = brute(rows, 35)
    assert got == want and sum(r[2] for r in want) > 0


def test_without_repeats_keeps_columns(spark):
    rows = _rows(9)
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, _kept string, k int")
    got = super_kmers.without_repeats(df, window=10)
    assert got.columns == df.columns and got.count() == len(rows)
    want = {r[0]: r for r in brute(rows, 10)}
    for r in got.collect():
        if r.doc_id is not None and r.doc_id != 907:
            assert hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest() == want[r.doc_id][3]


def test_empty_table(spark):
    assert super_kmers.dedup_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_windows_of_a_super_kmer_share_its_minimiser():
    rng = random.Random(0)
    docs = [[b"w%d" % rng.randrange(30) for _ in range(n)] for n in (0, 3, 50, 200, 35, 34)]
    owner, start, n, least = super_kmers.cut(docs, 35, 8)
    assert {(o, s + i) for o, s, m in zip(owner, start, n) for i in range(m)} == {
        (o, i) for o, w in enumerate(docs) for i in range(len(w) - 34)}
    assert n.max() <= 28 and len(np.unique(least)) > 3
