"""Cross-tokenizer alignment (operator 11) over exact-text classes.

Texts are shuffled by full text (partial counts first, so copies collapse before
the shuffle), and each distinct text is tokenised by both tokenizers and aligned
once.  Counts of linked id pairs are weighted by the number of copies, and the
measures go back to the doc_ids by a digest of the text.

Inside a task a text falls into segments, each a run of blanks with what
follows it.  Neither tokenizer has a token over a segment's edge: the byte-level
pattern always cuts between a word and a blank, and no piece has a blank behind
another character (checked when the vocabulary is loaded).  So each distinct
segment of a batch is encoded and aligned once, and short ones stay in a table
that is bounded by bytes.  If a segment's token bytes differ from its own, so do
the text's, which then has no tokens.

Two tokens whose byte ranges end together are such that the shorter one is a
suffix of the longer.  The two vocabularies therefore fix the possible pairs (a
few hundred thousand, whatever the corpus), and the count of every pair is an
array of that size, which each task may hold.

Edge cases: null and empty texts have no tokens: zeros and an empty
groups_sha256; null and repeated doc_ids are rows like any other; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import materialise, small_batches, text_of
from corvid.llm.word_encoder import byte_alphabet

#: A blank behind a character that no definition counts as white space.
_EDGE = re.compile("(?<=[^\\s\x1c-\x1f\x85\xa0᠎​﻿])(?= )")
TABLE_BYTES = 96 << 20     # of one worker's segment table
SHORT = 64                 # characters of a segment that the table keeps


class Aligner:
    """Both tokenizers, their token bytes and the pairs that can be linked."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        with open(a_path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        back = {c: b for b, c in byte_alphabet().items()}
        self.a_bytes = {i: bytes(map(back.__getitem__, t)) for t, i in vocabulary.items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(x != "▁" and y == "▁" for p in pieces for x, y in zip(p, p[1:])):
            raise ValueError("a piece of the second vocabulary has a blank behind another character")
        self.b_bytes = {i: self._piece_bytes(i, p) for i, p in enumerate(pieces)}
        self.blank = [self.b.piece_to_id("▁")]
        #: decimal ids with the sign behind them: "," inside a group's half, "|" and ";" at its end
        self.shown = pa.array([f"{i}{sign}".encode() for n, end in ((max(self.a_bytes) + 1, "|"), (len(pieces), ";"))
                               for i in range(n) for sign in (",", end)], pa.binary())
        self.shown_b = 2 * (max(self.a_bytes) + 1)
        self.a_len = self._lengths(self.a_bytes)
        self.b_len = self._lengths(self.b_bytes)
        #: a << 32 | b of all pairs that can be linked, ascending
        self.pairs = self._possible()
        self.table: dict[str, tuple] = {}
        self.held = 0

    def _piece_bytes(self, i: int, piece: str) -> bytes:
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode("utf-8")

    @staticmethod
    def _lengths(tokens: dict[int, bytes]) -> np.ndarray:
        out = np.zeros(max(tokens) + 1, np.int64)
        for i, t in tokens.items():
            out[i] = len(t)
        return out

    def _possible(self) -> np.ndarray:
        of_a: dict[bytes, list[int]] = {}
        of_b: dict[bytes, list[int]] = {}
        for i, t in self.a_bytes.items():
            of_a.setdefault(t, []).append(i)
        for i, t in self.b_bytes.items():
            of_b.setdefault(t, []).append(i)
        found = set()
        for i, t in self.a_bytes.items():
            for k in range(len(t)):
                found.update(i << 32 | j for j in of_b.get(t[k:], ()))
        for j, t in self.b_bytes.items():
            for k in range(len(t)):
                found.update(i << 32 | j for i in of_a.get(t[k:], ()))
        return np.array(sorted(found), np.int64)

    def _flat(self, raw: list[bytes], ids: list[list[int]], tokens: dict[int, bytes], length: np.ndarray) -> tuple:
        """(all ids, how many each, which segments have token bytes that are their own)."""
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int64, n.sum())
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        whole = b"".join(map(tokens.__getitem__, flat.tolist())) == b"".join(raw)
        if whole and (np.add.reduceat(length[flat], np.cumsum(n) - n) == size).all():
            return flat, n, np.ones(len(raw), bool)
        return flat, n, np.array([b"".join(map(tokens.__getitem__, i)) == r for i, r in zip(ids, raw)])

    def _align(self, some: list[str]) -> list[tuple | None]:
        """(n_a, n_b, n_groups, packed places of the pairs, groups) of segments,
        all at once: as both tokenizers give back every byte, the ends of their
        tokens in the joined segments are those in each."""
        a = [e.ids for e in self.a.encode_batch_fast(some, add_special_tokens=False)]
        # the library adds the blank again, but not to an empty text
        b = [x or self.blank for x in self.b.encode([t[1:] for t in some], num_threads=1)]
        raw = [t.encode("utf-8") for t in some]
        a_ids, n_a, sound = self._flat(raw, a, self.a_bytes, self.a_len)
        b_ids, n_b, sound_b = self._flat(raw, b, self.b_bytes, self.b_len)
        sound &= sound_b
        if not sound.all():
            kept = iter(self._align([t for t, x in zip(some, sound) if x]) if sound.any() else [])
            return [next(kept) if x else None for x in sound]
        ends_a, ends_b = np.cumsum(self.a_len[a_ids]), np.cumsum(self.b_len[b_ids])
        at = np.searchsorted(ends_b, ends_a)
        last_a = ends_b[at] == ends_a
        last_b = np.zeros(len(b_ids), bool)
        last_b[at[last_a]] = True
        of_a, of_b = np.nonzero(last_a)[0], np.nonzero(last_b)[0]
        places = np.searchsorted(self.pairs, a_ids[of_a] << 32 | b_ids[of_b]).astype(np.int32).tobytes()
        n_groups = np.bincount(np.repeat(np.arange(len(some)), n_a)[of_a], minlength=len(some))
        ends = np.cumsum(n_groups) * 4
        # ids and signs in text order: each group's first ids, then its second ones
        group_a = np.cumsum(last_a) - last_a
        group_b = np.cumsum(last_b) - last_b
        order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
        shown = np.concatenate([a_ids * 2 + last_a, self.shown_b + b_ids * 2 + last_b])[order]
        edges = np.concatenate([[0], np.cumsum(n_a + n_b)]).astype(np.int32)
        groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges), self.shown.take(pa.array(shown))), b"")
        return list(zip(n_a.tolist(), n_b.tolist(), n_groups.tolist(),
                        [places[x:y] for x, y in zip([0, *ends.tolist()], ends.tolist())], groups.to_pylist()))

    def segments(self, texts: list[str]) -> list[tuple | None]:
        """Alignments of distinct segments; each starts with a blank."""
        table = self.table
        new = [t for t in texts if t not in table]
        made = {}
        for at in range(0, len(new), 20_000):
            some = new[at:at + 20_000]
            made |= zip(some, self._align(some))
        out = [made[t] if t in made else table[t] for t in texts]
        for t, x in made.items():
            if len(t) <= SHORT:
                self.held += 400 + 4 * len(t) + (len(x[3]) + len(x[4]) if x else 0)
                table[t] = x
        if self.held > TABLE_BYTES:
            self.table, self.held = {}, 0
        return out

    def texts(self, texts: list[str]) -> list[tuple]:
        """(n_a, n_b, n_groups, places of pairs, how often each, sha256 of the groups) of texts."""
        cut = [_EDGE.split(" " + t) for t in texts]
        code: dict[str, int] = {}
        for c in cut:
            for s in c:
                code.setdefault(s, len(code))
        none = (0, 0, 0, b"", b"")
        known = self.segments(list(code))
        odd = {i for i, x in enumerate(known) if x is None}
        n_a, n_b, n_groups, places, groups = zip(*[x or none for x in known])
        counts = np.array([n_a, n_b, n_groups])
        out = []
        for c in cut:
            at = list(map(code.__getitem__, c))
            if odd and not odd.isdisjoint(at):
                out.append((0, 0, 0, np.zeros(0, np.int32), np.zeros(0, np.int32), ""))
                continue
            pair, often = np.unique(np.frombuffer(b"".join([places[i] for i in at]), np.int32), return_counts=True)
            # each segment's groups end with the sign that parts groups
            sha = hashlib.sha256(b"".join([groups[i] for i in at])[:-1]).hexdigest()
            out.append((*counts[:, at].sum(axis=1).tolist(), pair, often.astype(np.int32), sha))
        return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner per pair of files and Python worker."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def _lists(values: list[np.ndarray], kind) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else [], kind))


ALIGNED = ("digest string, copies long, n_a long, n_b long, n_groups long, groups_sha256 string, "
           "places array<int>, often array<int>")


def align_texts(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """One written row per distinct text that is not empty: its digest, copies,
    token and group counts, and its linked pairs (places in ``Aligner.pairs``)."""
    small_batches(docs.sparkSession)
    classes = docs.select(text_of(text_col).alias("t")).filter("t <> ''").groupBy("t").agg(F.count(F.lit(1)).alias("copies")) \
        .select(F.sha2("t", 256).alias("digest"), "copies", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_path, b_path)
        for batch in batches:
            if len(batch):
                n_a, n_b, n_groups, at, often, sha = zip(*both.texts(batch.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(n_groups, pa.int64()),
                     pa.array(sha, pa.string()), _lists(list(at), pa.int32()), _lists(list(often), pa.int32())],
                    [c.split()[0] for c in ALIGNED.split(", ")])

    return materialise(classes.mapInArrow(run, ALIGNED), "aligned-texts")


def pair_counts(aligned: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(place, n): links of each id pair over all documents, copies included."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(aligner(a_path, b_path).pairs), np.int64)
        for batch in batches:
            copies = batch.column(0).to_numpy()
            places, often = batch.column(1), batch.column(2)
            size = np.diff(places.offsets.to_numpy())
            np.add.at(total, places.flatten().to_numpy(), often.flatten().to_numpy() * np.repeat(copies, size))
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["place", "n"])

    return aligned.select("copies", "places", "often").mapInArrow(run, "place int, n long") \
        .groupBy("place").agg(F.sum("n").alias("n"))


def alignment_report(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its tokens, groups and links, and how usual its links are."""
    aligned = align_texts(docs, a_path, b_path, text_col)
    counts = pair_counts(aligned, a_path, b_path).toPandas()        # at most the pairs that the vocabularies admit
    place, n = counts["place"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = aligner(a_path, b_path).pairs
        total = np.zeros(len(pairs), np.int64)
        total[place] = n
        b_ids = pairs & 0xFFFFFFFF
        top = np.zeros(int(b_ids.max()) + 1 if len(b_ids) else 0, np.int64)
        np.maximum.at(top, b_ids, total)
        best = total == top[b_ids]
        for batch in batches:
            places, often = batch.column("places"), batch.column("often").flatten().to_numpy().astype(np.int64)
            at = places.flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(np.diff(places.offsets.to_numpy()))])
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (often, often * best[at], often * total[at])]
            links, good, count = [pa.array(s[ends[1:]] - s[ends[:-1]]) for s in sums]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("n_a"), batch.column("n_b"), batch.column("n_groups"),
                                              links, good, count, batch.column("groups_sha256")],
                                             ["digest", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    measures = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    rows = aligned.select("digest", "n_a", "n_b", "n_groups", "groups_sha256", "places", "often") \
        .mapInArrow(run, "digest string, " + ", ".join(f"{m} long" for m in measures) + ", groups_sha256 string")
    # written first: adaptive execution can split a hot text only where both
    # sides of the join come straight from a shuffle
    rows = materialise(rows, "text-measures")
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(text_of(text_col), 256).alias("digest"))
    return ids.join(rows, "digest", "left").select(
        "doc_id", *[F.coalesce(m, F.lit(0).cast("long")).alias(m) for m in measures],
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
