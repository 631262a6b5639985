"""Archives against a brute-force reading of the pages table."""

import base64
import hashlib
import random

import pytest

from corvid.llm import queries, warc
from corvid.llm.common import materialise

SMALL = "/root/testdata/sf0.001"


def _expected(rows, least=0):
    top = {}
    for p, _, html in rows:
        if p is not None:
            top[html or ""] = max(top.get(html or "", p), p)
    out = []
    for p, _, html in rows:
        b = (html or "").encode()
        refers = top.get(html or "") if len(b) >= least else None
        refers = None if refers == p else refers
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(),
                    "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def _run(df, **kw):
    merged = materialise(warc.merge_index(warc.write_archives(df, **kw)), "t-index")
    got = warc.read_archives(merged).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return merged, sorted(map(tuple, got.collect()), key=str)


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, pos int, run string")


def test_pages_of_all_kinds(spark):
    rows = [(1, "http://a.b/x", "é" * 50), (2, None, "é" * 50), (3, "https://www.A.b/X?q=1#f", None), (4, "", ""),
            (5, "http://a.b/x", "one"), (7, "not a url [", "two\r\n\r\nWARC/1.1\r\n"), (7, "http://a.b:99999999/", "two\r\n\r\nWARC/1.1\r\n"),
            (None, "http://z/\r\nWARC-Type: x", "one"), (None, "u", "alone"), (9, "http://h/ü", "<html>" * 100_000)]
    merged, got = _run(_frame(spark, rows))
    assert got == _expected(rows)
    assert merged.count() == len(rows)


def test_small_payloads_stay_responses(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    assert _run(_frame(spark, rows), min_payload=5)[1] == _expected(rows, 5)


def test_empty_table(spark):
    assert _run(_frame(spark, []).limit(0))[1] == []


def test_histories_are_globally_ordered(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, f"http://h{rng.randrange(9)}.org/p{rng.randrange(5)}", "x" * rng.randrange(4)) for i in range(400)]
    monkeypatch.setattr(warc, "RUN_ROWS", 7)
    merged, got = _run(_frame(spark, rows))
    assert got == _expected(rows)
    t = sorted(merged.select("range", "place", "urlkey", "captured", "page_id").collect())
    keys = [(r.urlkey, r.captured, r.page_id) for r in t]
    assert keys == sorted(keys) and len(keys) == 400


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 8, 33])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(9))) for _ in range(k)]
    assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_query(spark):
    import pyarrow.parquet as pq
    t = pq.read_table(f"{SMALL}/pages.parquet").to_pylist()
    got = queries.QUERIES["op1_warc"](spark, SMALL).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=str) == _expected([(r["page_id"], r["url"], r["html"]) for r in t])


def test_damage_is_found():
    import zlib
    good = warc.record(1, "u", 0, b"payload", None)
    assert warc.parse(good)[:2] == (1, 7)
    bad = zlib.decompress(good, 31).replace(b"payload", b"pay10ad")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    with pytest.raises(ValueError):
        warc.parse(z.compress(bad) + z.flush())


def test_entries_of_one_key_spread_over_ranges(spark):
    rows = [(f"{r:06d}-0000-x", i, "com,a)/", 7, None, "http://a.com/", "response", "f", 10 * i, 10)
            for r in range(4) for i in range(1000)]
    rows += [("000009-0000-x", i, f"com,b)/{i:04d}", 7, i, None, "response", "g", i, 1) for i in range(1000)]
    got = warc.merge_index(spark.createDataFrame(rows, warc.INDEX_SCHEMA)).toPandas()
    assert got.groupby("range").size().max() < 2000 and len(got) == 5000
    got = got.sort_values(["range", "place"])
    assert list(zip(got.run, got.pos)) == [(r[0], r[1]) for r in rows]
