"""Token operators against the libraries themselves and exact round trips."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvid.llm import byte_bpe, packing, queries, simple8b, token_files
from corvid.llm.word_encoder import PieceTable, WordEncoder

SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n", "a", "  two  blanks ", "tab\there", "It's we'll they'RE", "Á ÉtÉ",
       "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "İstanbul ΣΣΣ", "x\x1cy z\x85w  q",
       "12345 6,7.8", "日本語 ال", "a" * 5000, "!!!??? ...a...b", "é́ ̈x", "​ z\xa0 \xa0y",
       "word*** <x> | it's''s", "\n\n a\n\nb \n", "v\vt f\fg\r\nh", "WORD Word, word; WORD!", "ÀÉ àé. ŁÓDŹ łódź", "ΑΣ ας ασ K k", "İ ı ſ ŉ Ÿ Ɓ Ⱥ µ ª × ÷ a× ÷b <| a<| <|x", "ﬁne ẞ Ǆ", "ab\0cd ef"]


def _docs(spark, texts, extra=True):
    rows = [(i, t, f"f{i}", 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, file string, start int")


@pytest.fixture(scope="module")
def texts():
    import pyarrow.parquet as pq
    return pq.read_table(f"{SMALL}/documents.parquet", columns=["text"])["text"].to_pylist() + ODD


def _library(texts):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return [lib.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_word_encoder_equals_library(texts):
    enc = WordEncoder(P.path("word_bpe_49k.json"), limit=50)
    got = [np.frombuffer(b, "<u4").tolist() for b in enc.encode(texts)]
    assert got == _library(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=30), max_size=5))
def test_word_encoder_any_text(xs):
    enc = test_word_encoder_any_text.__dict__.setdefault("enc", WordEncoder(P.path("word_bpe_49k.json")))
    assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(xs)] == [
        enc.lib.encode(x, add_special_tokens=False).ids for x in xs]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=400),
       st.sampled_from([1, 7, 64, 1024]))
def test_simple8b_round_trip(ids, block):
    words, offsets = simple8b.encode(np.array(ids, dtype=np.uint64), block)
    assert simple8b.decode(words, offsets, len(ids), block).tolist() == ids


def test_simple8b_long_runs_and_blocks_alone():
    rng = np.random.default_rng(1)
    ids = np.concatenate([np.zeros(3000), rng.integers(0, 50_000, 9000), np.ones(2500)]).astype(np.uint64)
    words, offsets = simple8b.encode(ids)
    assert len(words) < 9000 / 3 + 200
    for b in range(len(offsets) - 1):
        part = ids[b * 1024:(b + 1) * 1024]
        got = simple8b.decode(words[offsets[b]:offsets[b + 1]], offsets[b:b + 2] - offsets[b], len(part))
        assert (got == part).all()


def _expected_files(rows, end):
    out, start = [], 0
    for doc, ids in rows:
        ids = np.array(ids + [end], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files(spark, texts):
    got = token_files.read_tokens(token_files.write_tokens(_docs(spark, texts), P.path("word_bpe_49k.json"), end_id=2))
    assert sorted(map(tuple, got.collect())) == _expected_files(enumerate(_library(texts)), 2)


def test_token_files_empty_null_and_repeated(spark):
    empty = _docs(spark, []).limit(0)
    assert token_files.read_tokens(token_files.write_tokens(empty, P.path("word_bpe_49k.json"))).count() == 0
    df = spark.createDataFrame([(None, "b a"), (5, "x"), (5, "x"), (5, None), (None, None)], "doc_id long, text string")
    got = token_files.read_tokens(token_files.write_tokens(df, P.path("word_bpe_49k.json"))).collect()
    assert sum(r.n_tokens for r in got) == 3 + 1 + 5 and len(got) == 5
    spans = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    assert {r.start for r in got if r.doc_id is None} == {s for s, _ in spans[:2]}


def test_op2_query(spark):
    import pyarrow.parquet as pq
    t = pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).sort_by("doc_id")
    want = _expected_files(zip(t["doc_id"].to_pylist(), _library(t["text"].to_pylist())), 2)
    assert sorted(map(tuple, queries.QUERIES["op2_token_files"](spark, SMALL).collect())) == want


@pytest.fixture(scope="module")
def tik():
    import tiktoken
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_library(texts, tik):
    bpe = byte_bpe.coder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    more = texts + ["ab" * 20_000, "é" * 3000, "xyz123" * 999, "\r\n\r\n a \t b"]
    for t, got in zip(more, bpe.encode(more)):
        assert np.frombuffer(got, "<u4").tolist() == tik.encode_ordinary(t or "")
        assert bpe.decode(got) == (t or "").encode()


@settings(max_examples=60, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8", max_codepoint=0x2FFF), st.sampled_from(" \n\t'sAe1")), max_size=60))
def test_byte_bpe_any_text(tik, text):
    bpe = byte_bpe.coder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    assert np.frombuffer(bpe.encode([text])[0], "<u4").tolist() == tik.encode_ordinary(text)


def test_op3_query(spark, tik):
    import pyarrow.parquet as pq
    t = pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"])
    want = []
    for d, x in zip(t["doc_id"].to_pylist(), t["text"].to_pylist()):
        ids = np.array(tik.encode_ordinary(x or ""), "<u4").tobytes()
        want.append((d, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()))
    assert sorted(map(tuple, queries.QUERIES["op3_byte_bpe"](spark, SMALL).collect())) == sorted(want)


def test_byte_bpe_empty_table_and_nulls(spark):
    df = spark.createDataFrame([(None, None, "q")], "doc_id long, text string, ids string")
    r = byte_bpe.encode_decode(df, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, keep_ids=True).collect()[0]
    assert (r.doc_id, r.n_tokens, bytes(r.ids)) == (None, 0, b"")
    assert byte_bpe.encode_decode(df.limit(0), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def _check_packing(rows, lengths, seq_len):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert {d: sum(r.length for r in v) for d, v in by_doc.items()} == lengths
    for v in by_doc.values():
        v.sort(key=lambda r: r.piece)
        assert [r.piece for r in v] == list(range(len(v)))
        assert all(r.length == seq_len for r in v[:-1]) and [r.start for r in v] == [seq_len * i for i in range(len(v))]
    for v in by_seq.values():
        at = 0
        for r in sorted(v, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= seq_len
    return len(by_seq)


def test_packing(spark, texts):
    ids = _library(texts)
    rows = packing.pack(_docs(spark, texts), P.path("word_bpe_49k.json"), seq_len=512, open_bins=64).collect()
    n = _check_packing(rows, {i: len(x) + 1 for i, x in enumerate(ids)}, 512)
    for r in rows:
        part = np.array((ids[r.doc_id] + [1])[r.start:r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(part.tobytes())
    total = sum(len(x) + 1 for x in ids)
    assert n <= 1.05 * total / 512 + 2      # open_bins is small here


def test_packing_does_not_depend_on_the_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    counts = []
    for parts in (1, 60):
        rows = packing.pack(docs.repartition(parts), P.path("word_bpe_49k.json")).collect()
        lengths = {}
        for r in rows:
            lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
        counts.append(_check_packing(rows, lengths, 4096))
    bound = -(-sum(lengths.values()) // 4096)
    assert counts[0] <= 1.01 * bound + 1 and counts[1] <= 1.01 * bound + 2


def test_unfinished_bins_are_packed_into_one_another(spark):
    held = spark.createDataFrame([(1, 9), (2, 6), (3, 4), (4, 1), (5, 5), (6, 5), (7, 3)], "bin long, held long")
    got = {(r["bin"], r["into"], r["shift"]) for r in packing.merged(held, 10).collect()}
    # 9 + 1, 6 + 4, 5 + 5; 3 stays alone
    assert got == {(4, 1, 9), (3, 2, 6), (6, 5, 5)}
    # a group of another size only changes how well they fit
    assert packing.merged(held.limit(0), 10).count() == 0


def test_word_table_is_bounded_by_bytes():
    table = PieceTable(10_000)
    for i in range(200):
        known = table.fill({f"w{i}", f"w{i // 2}", "x" * 5000 + str(i)}, lambda k: k.encode())
        assert known["x" * 5000 + str(i)].endswith(str(i).encode()) and known[f"w{i // 2}"] == f"w{i // 2}".encode()
        assert sum(len(k) > 300 for d in (table.young, table.old) for k in d) <= 2
        assert table.size <= 11_000 and len(table.young) + len(table.old) < 200


def test_open_bins_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(x) for x in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)]
    # bin 1 (free 3) closed: it was the fullest when the third bin opened
    assert bins.closed == [1]
    assert bins.place(2) == (2, 8) and bins.place(4) == (0, 6) and bins.place(3) == (3, 0)


def test_packing_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "")], "doc_id long, text string")
    rows = packing.pack(df.coalesce(1), P.path("word_bpe_49k.json")).collect()
    assert sorted(r.offset for r in rows) == [0, 1, 2] and len({r.sequence_id for r in rows}) == 1
    assert packing.pack(df.limit(0), P.path("word_bpe_49k.json")).count() == 0
