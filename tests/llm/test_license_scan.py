"""License scans against every block compared with every template."""

import random
import re
from collections import Counter

from corvid.llm import license_scan as ls

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, score string, labels int, t long"


def _words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _plain(rows, templates, phrases, threshold, block):
    out = []
    for doc, text in rows:
        w = _words(text)
        base = [(i, b) for p, b in phrases.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        blocks = [set(w[a:a + block]) for a in range(0, max(len(w), 1), block // 2)]
        shares = [(len(set(_words(t)) & s) / len(set(_words(t))), b) for s in blocks for b, t in templates]
        met = [x for x in shares if x[0] >= threshold - 1e-9]
        names = {b for _, b in base}
        places = [i for i, _ in base]
        out.append((doc, len(w), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(names)),
                    ",".join(sorted(names | {b for _, b in met})), 1.0 if base else max((s for s, _ in met), default=0.0), len(met)))
    return Counter(out)


def _check(spark, rows, templates=ls.TEMPLATES, phrases=ls.PHRASES, threshold=0.8, block=64):
    df = spark.createDataFrame([(d, t, "s", 3, 4) for d, t in rows], SCHEMA).repartition(3)
    got = ls.scan(df, templates, phrases, threshold, block)
    assert Counter(tuple(r) for r in got.collect()) == _plain(rows, templates, phrases, threshold, block)
    return {r.doc_id: r for r in got.collect()}


def test_notices_and_edges(spark):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    filler = "lorem ipsum dolor été 中文 " * 40
    rows = [(1, None), (2, ""), (3, "..., !?"), (4, "Released under the MIT License."), (5, "CC BY-NC, cc by nc\ncc-by-nc"),
            (6, gpl), (7, filler + gpl + filler), (8, gpl.replace("GNU", "gnu").replace("This work", "That text")),
            (9, "Licensed under the Apache License, Version 2.0."), (9, "Licensed under the Apache License, Version 2.0."),
            (None, "under the MIT\tlicense under the mit license"), (10, " ".join(t for _, t in ls.TEMPLATES)),
            (11, ("under the mit license " + filler) * 100), (12, "UNDER THE MIT LICENSES"), (13, "İunder the mit license"),
            (14, filler * 300 + ls.TEMPLATES[5][1])]
    r = _check(spark, rows)
    assert r[6].labels == "gpl-3" and r[6].base_labels == "" and r[7].labels == "gpl-3" and r[14].labels == "bsd"
    assert r[5].n_base == 3 and r[5].first_word == 0 and r[5].last_word == 6 and r[11].n_base == 100
    assert ls.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_random_blocks_against_brute_force(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(25)]
    for threshold, block in ((0.8, 16), (0.5, 8), (1.0, 16)):
        templates = [(f"l{i % 4}", " ".join(rnd.choices(words, k=rnd.randint(1, block // 2 + 1)))) for i in range(9)]
        rows = [(i, " ".join(rnd.choices(words + ["x"] * 15, k=rnd.randint(0, 90)))) for i in range(120)]
        _check(spark, rows, templates, {"w1 w2": "p", "w1 w1": "q"}, threshold, block)


def test_order_of_words_changes_no_result(spark):
    """Any frequencies give the same pairs: they only decide what is probed."""
    rnd = random.Random(4)
    vocabulary = {w for _, t in ls.TEMPLATES for w in ls.words_of(t.encode())}
    text = ls.words_of(" ".join(t for _, t in ls.TEMPLATES).encode())
    found = set()
    for _ in range(5):
        index = ls.TemplateIndex(ls.TEMPLATES, {w: rnd.randint(0, 100) for w in vocabulary}, 0.8, 64)
        found.add(tuple(sorted(index.join(index.ranks(text)))))
    assert len(found) == 1
