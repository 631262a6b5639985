"""License scans (operator 13): an exact set-similarity join of text blocks with
license templates.

Every text is cut into half-overlapping blocks of BLOCK words.  A block meets a
template when at least ``threshold`` of the template's distinct words are in it.
Words outside all templates can be in no overlap and are dropped, so the join
works on the template vocabulary, ordered by its frequency in the whole corpus,
the rarest first.  With ``need`` the smallest overlap that meets the threshold,
a block and a template can only join if

* the block has at least ``need`` words of the vocabulary (length filter),
* they share a word among the first ``len - need + 1`` of both (prefix filter),
* the first shared word leaves enough words after it on both sides (positional
  filter).

Templates are a parameter, so their index has a bound that does not depend on
the data; it goes to every task, and blocks never leave theirs.  Two passes over
the texts (frequencies, join), no shuffle of rows and no hot group.

Edge cases: a null text counts as empty; empty texts have no words, no labels
and score 0; null and repeated doc_ids are rows like any other; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import small_batches

BLOCK = 64                 # words of a block; the next one starts after half of them
THRESHOLD = 0.8

#: Phrases whose words must stand consecutively, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Passages of public license notices and their labels.  A passage
#: has at most BLOCK / 2 + 1 words, so that each copy of it lies in one block.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial "
            "portions of the Software"),
    ("mit", "Released under the terms of the MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with "
                 "the License"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                 "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
             "Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
            "to this work"),
    ("reserved", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any "
                 "form or by any means without the prior written permission of the publisher"),
]

#: Bytes of words stay (A-Z as a-z), all others part words.
_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32
                    for b in range(256))

SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double, n_blocks long")


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text in lower-case A-Z."""
    return text.translate(_WORD_BYTES).split() if text else []


def least_overlap(size: int, threshold: float) -> int:
    """The smallest number of ``size`` words that is a share of ``threshold`` or more."""
    return max(1, ceil(threshold * size - 1e-9))


class TemplateIndex:
    """Templates as ascending word ranks (rarest first) with their prefixes."""

    def __init__(self, templates: list[tuple[str, str]], counts: dict[bytes, int], threshold: float, block: int):
        sets = []
        for label, text in templates:
            words = words_of(text.encode("utf-8"))
            if not words or len(words) > block // 2 + 1:
                raise ValueError("a template has 1 to block / 2 + 1 words")
            sets.append((label, set(words)))
        order = sorted(set().union(*[s for _, s in sets]), key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(order)}
        self.block = block
        self.templates = [(label, frozenset(self.rank[w] for w in s), least_overlap(len(s), threshold)) for label, s in sets]
        #: word -> [(template, place of the word in it)] for the words of each prefix
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for t, (_, ranks, need) in enumerate(self.templates):
            for i, r in enumerate(sorted(ranks)[:len(ranks) - need + 1]):
                self.prefix.setdefault(r, []).append((t, i))
        self.probe = np.zeros(len(order) + 1, bool)
        self.probe[list(self.prefix)] = True

    def ranks(self, words: list[bytes]) -> np.ndarray:
        get, none = self.rank.get, len(self.rank)
        return np.fromiter((get(w, none) for w in words), np.int32, len(words))

    def join(self, ranks: np.ndarray) -> list[tuple[int, int, int]]:
        """(block, template, overlap) of all pairs that meet the threshold."""
        at = np.nonzero(ranks < len(self.rank))[0]
        if not len(at) or not self.probe[ranks[at]].any():
            return []
        half, width = self.block // 2, len(self.rank)
        first = at // half
        keys = np.concatenate([first, first[first > 0] - 1]) * width + np.concatenate([ranks[at], ranks[at[first > 0]]])
        keys = np.unique(keys)
        blocks, held = keys // width, keys % width
        starts = np.nonzero(np.append(True, blocks[1:] != blocks[:-1]))[0]
        ends = np.append(starts[1:], len(keys))
        has_probe = np.add.reduceat(self.probe[held], starts)
        out = []
        for s, e in zip(starts[has_probe > 0].tolist(), ends[has_probe > 0].tolist()):
            mine = held[s:e].tolist()
            out += [(int(blocks[s]), t, n) for t, n in self._meet(mine)]
        return out

    def _meet(self, mine: list[int]) -> list[tuple[int, int]]:
        seen, out, whole = set(), [], None
        for j, r in enumerate(mine):
            for t, i in self.prefix.get(r, ()):
                if t in seen:
                    continue
                seen.add(t)                     # its first shared word decides
                _, ranks, need = self.templates[t]
                if len(mine) < need or j > len(mine) - need:
                    continue
                if 1 + min(len(ranks) - i, len(mine) - j) - 1 < need:
                    continue
                whole = whole or set(mine)
                n = len(whole & ranks)
                if n >= need:
                    out.append((t, n))
        return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("t"))


def word_counts(docs: DataFrame, vocabulary: set[bytes], id_col: str = "doc_id", text_col: str = "text") -> dict[bytes, int]:
    """How often each word of the vocabulary occurs in all texts."""
    order = sorted(vocabulary)
    at = {w: i for i, w in enumerate(order)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, get, none = np.zeros(len(order) + 1, np.int64), at.get, len(order)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                words = words_of(t)
                total += np.bincount(np.fromiter((get(w, none) for w in words), np.int32, len(words)), minlength=none + 1)
        some = np.nonzero(total[:-1])[0]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["w", "n"])

    sums = _texts(docs, id_col, text_col).select("t").mapInArrow(run, "w int, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return {order[r["w"]]: r["n"] for r in sums.collect()}       # at most the vocabulary


def _phrase_places(words: list[bytes], phrases: list[tuple[bytes, int]]) -> list[tuple[int, int]]:
    """(first word, phrase) of all places."""
    joined = b" " + b" ".join(words) + b" "
    out = []
    for p, (phrase, _) in enumerate(phrases):
        at, word, seen = joined.find(phrase), 0, 0
        while at >= 0:
            word += joined.count(b" ", seen, at)
            seen = at
            out.append((word, p))
            at = joined.find(phrase, at + 1)
    return out


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None,
         threshold: float = THRESHOLD, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: places of the phrases, the labels of phrases and of templates
    that a block of it meets, and how many (block, template) pairs these are.

    The score is 1 where a phrase stands, else the highest share of a template
    that a block holds, of the pairs that meet the threshold (none: 0)."""
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    vocabulary = {w for _, text in templates for w in words_of(text.encode("utf-8"))}
    index = TemplateIndex(templates, word_counts(docs, vocabulary, id_col, text_col), threshold, block) if templates else None
    sought = [(b" " + b" ".join(words_of(p.encode("utf-8"))) + b" ", label) for p, label in phrases.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(t)
                base = _phrase_places(words, sought)
                met = index.join(index.ranks(words)) if index and words else []
                base_labels = {sought[p][1] for _, p in base}
                labels = base_labels | {index.templates[m][0] for _, m, _ in met}
                score = 1.0 if base else max((n / len(index.templates[m][1]) for _, m, n in met), default=0.0)
                places = [w for w, _ in base]
                out.append((doc, len(words), len(base), min(places, default=None), max(places, default=None),
                            ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, len(met)))
            cols = list(zip(*out)) if out else [[] for _ in range(9)]
            kinds = [*[pa.int64()] * 5, pa.string(), pa.string(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             [c.split()[0] for c in SCHEMA.split(", ")])

    return _texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def oracle(templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None,
           threshold: float = THRESHOLD, block: int = BLOCK) -> str:
    """DuckDB SQL of ``scan`` over the table documents: every block is compared
    with every template."""
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    entries = []
    for t, (label, text) in enumerate(templates):
        held = {w.decode() for w in words_of(text.encode("utf-8"))}
        entries += [f"({t}, '{label}', '{w}', {len(held)}, {least_overlap(len(held), threshold)})" for w in sorted(held)]
    sought = []
    for p, (text, label) in enumerate(phrases.items()):
        words = [w.decode() for w in words_of(text.encode("utf-8"))]
        sought.append(f"({p}, '{label}', [{', '.join(repr(w) for w in words)}])")
    half = block // 2
    return f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
templates(t, label, word, size, need) AS (VALUES {', '.join(entries)}),
phrases(p, label, ws) AS (VALUES {', '.join(sought)}),
words AS MATERIALIZED (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS k FROM d),
places AS (
  SELECT d.r, words.k, p.label
  FROM words JOIN phrases p ON words.word = p.ws[1]
  JOIN d ON d.r = words.r
  WHERE d.w[words.k + 1 : words.k + len(p.ws)] = p.ws),
base AS (SELECT r, count(*) AS n_base, min(k) AS first_word, max(k) AS last_word FROM places GROUP BY r),
known AS (SELECT r, word, k // {half} AS b FROM words WHERE word IN (SELECT word FROM templates)),
blocks AS (SELECT r, b, word FROM known UNION SELECT r, b - 1, word FROM known WHERE b > 0),
met AS (
  SELECT r, b, t, any_value(label) AS label, count(*) / any_value(size) AS share
  FROM blocks JOIN templates USING (word) GROUP BY r, b, t HAVING count(*) >= any_value(need)),
top AS (SELECT r, max(share) AS share, count(*) AS n_blocks FROM met GROUP BY r),
base_names AS (SELECT r, string_agg(label, ',' ORDER BY label) AS l FROM (SELECT DISTINCT r, label FROM places) GROUP BY r),
names AS (SELECT r, string_agg(label, ',' ORDER BY label) AS l
          FROM (SELECT r, label FROM places UNION SELECT r, label FROM met) GROUP BY r)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_names.l, '') AS base_labels, coalesce(names.l, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score,
       coalesce(n_blocks, 0) AS n_blocks
FROM d LEFT JOIN base USING (r) LEFT JOIN base_names USING (r) LEFT JOIN names USING (r) LEFT JOIN top USING (r)
"""
