"""Near duplicates against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash

from corvid.llm import queries, simhash
from corvid.llm.components import components

SMALL = "/root/testdata/sf0.001"


def brute_fp(text):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(
        str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if x]
    if not w:
        return 0
    sh = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance=4):
    ids = list(fps)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                ra, rb = sorted((find(a), find(b)))
                up[rb] = ra
    return {i: find(i) for i in ids}


def test_query(spark):
    import pyarrow.parquet as pq
    t = dict(zip(*[pq.read_table(f"{SMALL}/documents.parquet")[c].to_pylist() for c in ("doc_id", "text")]))
    fps = {d: brute_fp(x) for d, x in t.items()}
    comp = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op8_simhash"](spark, SMALL).collect()}
    assert got == {d: (f"{fps[d]:016x}", comp[d]) for d in t}


def _frame(spark, fps):
    return spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")


@pytest.mark.parametrize("groups,block", [(5, 4096), (6, 4096), (8, 4096), (6, 30), (5, 7)])
def test_links_lose_nothing(spark, groups, block):
    rng = random.Random(groups)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = set(base)
    for b in base:
        for _ in range(40):
            x = b
            for _ in range(rng.randrange(1, 7)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps |= {0} | {1 << i for i in range(64)}                   # one dense ball
    fps = sorted(fps)
    edges = simhash.links(_frame(spark, fps), 4, block=block, groups=groups)
    mask = (1 << 64) - 1
    got = {}
    rows = components(edges).collect()
    for r in rows:
        got.setdefault(r.root & mask, {r.root & mask}).add(r.node & mask)
    want = {}
    for k, v in brute_components({f: f for f in fps}).items():
        want.setdefault(v, set()).add(k)
    assert sorted(sorted(s) for s in got.values()) == sorted(sorted(s) for s in want.values() if len(s) > 1)


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**64, 2000, dtype=np.uint64), rng.integers(0, 2**64, 2000, dtype=np.uint64)
    ca, cb = simhash.segment_counts(a), simhash.segment_counts(b)
    exact = sum(np.abs((ca >> np.uint64(2 * s) & np.uint64(3)).astype(int) - (cb >> np.uint64(2 * s) & np.uint64(3)).astype(int))
                for s in range(32))
    assert (simhash.manhattan(ca, cb) == exact).all() and (exact <= np.bitwise_count(a ^ b)).all()


def test_edges(spark):
    rows = [(1, "Same Words Here Now Again", "z"), (2, "same words here now again", "z"), (3, None, "z"), (4, "", "z"), (5, " \n", "z"),
            (None, "same words here NOW again", "z"), (None, "another single text that stands alone", "z"), (9, "few words", "z"),
            (9, "few words", "z"), (10, "Few\twords", "z"), (11, "é É", "z"), (12, "é é", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert len(got) == len(rows)
    for d, f, c in got:
        if d in (3, 4, 5):
            assert (f, c) == ("0" * 16, 3)
        if d in (1, 2):
            assert c == 1
        if d in (9, 10):
            assert c == 9
    assert sorted((c for d, f, c in got if d is None), key=str) == [1, None]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(-50, 50)] + [(7, 7), (200, 300), (300, 200)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: -50 for i in range(-49, 51)} | {300: 200}
