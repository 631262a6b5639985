"""Cross-tokenizer alignment against whole-text encoding by both libraries."""

import hashlib
import json
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corvid.llm import queries, token_alignment
from corvid.llm.word_encoder import byte_alphabet

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def libs():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    back = {c: b for b, c in byte_alphabet().items()}
    entries = {i: bytes(back[c] for c in t) for t, i in json.load(open(A, encoding="utf-8"))["model"]["vocab"].items()}
    return a, entries, sentencepiece.SentencePieceProcessor(model_file=B)


def _tokens(libs, text):
    """Whole-text (a ids, a bytes, b ids, b bytes), or nothing."""
    a, entries, b = libs
    if not text:
        return [], [], [], []
    ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    ba = [entries[i] for i in ia]
    bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
    raw = (" " + text).encode()
    return (ia, ba, ib, bb) if b"".join(ba) == raw == b"".join(bb) else ([], [], [], [])


def _ends(tokens):
    out, n = [], 0
    for t in tokens:
        n += len(t)
        out.append(n)
    return out


def _brute(libs, texts):
    cut, pairs = [], Counter()
    for t in texts:
        ia, ba, ib, bb = _tokens(libs, t)
        ea, eb = _ends(ba), _ends(bb)
        links = [(x, y) for x, e in zip(ia, ea) for y, f in zip(ib, eb) if e == f] if len(ia) < 400 else \
            [(ia[ea.index(e)], ib[eb.index(e)]) for e in sorted(set(ea) & set(eb))]
        pairs.update(links)
        groups, i, j = [], 0, 0
        for e in sorted(set(ea) & set(eb)):
            x, y = ea.index(e) + 1, eb.index(e) + 1
            groups.append(",".join(map(str, ia[i:x])) + "|" + ",".join(map(str, ib[j:y])))
            i, j = x, y
        cut.append((len(ia), len(ib), links, groups))
    top = Counter()
    for (_, y), n in pairs.items():
        top[y] = max(top[y], n)
    return [(n_a, n_b, len(g), len(links), sum(pairs[p] == top[p[1]] for p in links), sum(pairs[p] for p in links),
             hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for n_a, n_b, links, g in cut]


def test_query_equals_brute_force(spark, libs):
    got = queries.QUERIES["op11_alignment"](spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = Counter((d.doc_id, *r) for d, r in zip(docs, _brute(libs, [d.text for d in docs])))
    assert Counter(tuple(r) for r in got) == want


def test_edges_and_repeats(spark, libs):
    texts = [None, "", " ", "  two  blanks ", "a \n  b\n\nc\td", "<|endoftext|> and <s> </s> <0x41> ▁ x", "same text", "same text",
             "same text", "tab\there   nbsp 　 wide", "word " * 30_000, "中文" * 3000, "é é ​ z", "\x00nul \x00", "!\x1c x \x1f y",
             "don't we'll 3,000.50 ###  x"]
    rows = [(i if i % 3 else None, t, "d", i, 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, n_a long, copies int")
    got = token_alignment.alignment_report(docs, A, B)
    want = Counter((r[0], *b) for r, b in zip(rows, _brute(libs, texts)))
    assert Counter(tuple(r) for r in got.collect()) == want
    empty = token_alignment.alignment_report(docs.limit(0), A, B)
    assert empty.count() == 0 and empty.columns == got.columns
    assert token_alignment.alignment_report(docs.filter("text IS NULL"), A, B).select("n_links", "groups_sha256").distinct().collect() == [(0, "")]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t'!.-ab1  ́中\x1c\x85​")), st.characters(exclude_categories=["Cs"])),
               max_size=60))
def test_segments_are_exact(libs, text):
    got = token_alignment.aligner(A, B).texts([text])[0]
    want = _brute(libs, [text])[0]
    assert (got[0], got[1], got[2], got[5]) == (want[0], want[1], want[2], want[6]) or not text
    assert int(got[4].sum()) == want[3] or not text


def test_possible_pairs_are_suffixes():
    both = token_alignment.aligner(A, B)
    assert 100_000 < len(both.pairs) < 1_000_000
    for p in both.pairs[::5000].tolist():
        x, y = both.a_bytes[p >> 32], both.b_bytes[p & 0xFFFFFFFF]
        assert x.endswith(y) or y.endswith(x)
