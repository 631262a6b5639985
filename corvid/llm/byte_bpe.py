"""Byte-level BPE (operator 3) with a hierarchical-bitmap rank queue.

Pre-tokens are linked lists of byte positions.  Every mergeable neighbour pair
lies in the bucket of its merge rank; three levels of 64-bit words mark the
buckets in use, so the next rank is three find-first-set steps away whatever
the length of the pre-token.  Entries whose pair has changed meanwhile are
skipped when met.  A pre-token of n bytes costs O(n) queue steps, also one of
millions of bytes without a blank.  Pre-tokens that a worker has not met yet
share one run of the queue, with gaps between them.

Edge cases: a null or empty text has no ids; null doc_ids stay null; repeated
rows are coded each for itself; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import small_batches
from corvid.llm.word_encoder import TABLE_BYTES, PieceTable

#: White space other than blank and line feed (Unicode's White_Space).
_ODD_SPACE = re.compile("[\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


#: Stands between the pre-tokens of a run; UTF-8 has no such byte.
_GAP = 0xFF

#: Bytes of new pre-tokens in one run of the queue (a longer one runs alone);
#: lists of this length stay in a core's cache.
RUN_BYTES = 1 << 13


class RankQueue:
    """Positions by merge rank: a heap per rank, and three levels of 64-bit
    words that mark the ranks in use."""

    def __init__(self, ranks: int):
        self.buckets: list[list[int]] = [[] for _ in range(ranks)]
        self.low = [0] * (ranks // 64 + 1)
        self.mid = [0] * (ranks // 4096 + 1)
        self.top = 0

    def mark(self, rank: int) -> None:
        a, b = rank >> 6, rank >> 12
        self.low[a] |= 1 << (rank & 63)
        self.mid[b] |= 1 << (a & 63)
        self.top |= 1 << b

    def push(self, rank: int, pos: int) -> None:
        held = self.buckets[rank]
        if not held:
            self.mark(rank)
        heappush(held, pos)

    def first(self) -> int:
        """The lowest rank in use, found by three find-first-set steps."""
        b = (self.top & -self.top).bit_length() - 1
        m = self.mid[b]
        a = (b << 6) | ((m & -m).bit_length() - 1)
        w = self.low[a]
        return (a << 6) | ((w & -w).bit_length() - 1)

    def clear(self, rank: int) -> None:
        a, b = rank >> 6, rank >> 12
        self.low[a] &= ~(1 << (rank & 63))
        if not self.low[a]:
            self.mid[b] &= ~(1 << (a & 63))
            if not self.mid[b]:
                self.top &= ~(1 << b)


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = TABLE_BYTES):
        import regex
        self.ranks = ranks
        # what holds the gap byte is in no text: without it no pair reaches over a gap
        self.joins = {t: r for t, r in ranks.items() if len(t) == 1 or _GAP not in t}
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.of_byte[_GAP] = -2
        self.of_pair = np.full(1 << 16, -1, np.int64)
        for token, rank in self.joins.items():
            if len(token) == 2:
                self.of_pair[token[0] << 8 | token[1]] = rank
        self.queue = RankQueue(max(ranks.values()) + 1)
        # \s means Unicode's White_Space to the library that the pattern is written for
        pattern = pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
        self.find = regex.compile(pattern).findall
        self.words = PieceTable(limit)
        self.tokens = PieceTable(limit)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    def _start(self, raw: bytes) -> tuple[list[int], list[int]]:
        """Queue every mergeable pair of neighbour bytes; the rank of the pair
        that starts at each position (-1: none) and the id of each byte."""
        code = np.frombuffer(raw, np.uint8).astype(np.int64)
        now = np.append(self.of_pair[code[:-1] << 8 | code[1:]], -1)
        at = np.flatnonzero(now >= 0)
        at = at[np.argsort(now[at], kind="stable")]
        ranks, starts = np.unique(now[at], return_index=True)
        ends = np.append(starts[1:], len(at)).tolist()
        at = at.tolist()
        for rank, a, b in zip(ranks.tolist(), starts.tolist(), ends):
            self.queue.mark(rank)
            self.queue.buckets[rank] = at[a:b]       # ascending, so a heap
        return now.tolist(), self.of_byte[code].tolist()

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pre-tokens that are no tokens themselves.  They lie in
        one list with gaps between them and share the queue: the next rank is
        the lowest of all, its positions are met from left to right, and a pair
        of a lower rank that a merge has made comes first."""
        raw = b"\xff" + b"\xff".join(pieces) + b"\xff"
        now, ids = self._start(raw)
        places = list(range(len(raw) + 1))
        after, before = places[1:], [-1] + places[:-2]
        queue, rank_of = self.queue, self.joins.get
        buckets, mark = queue.buckets, queue.mark
        while queue.top:
            rank = queue.first()
            held, lower = buckets[rank], False
            while held and not lower:
                i = heappop(held)
                if now[i] != rank:                   # the entry is stale
                    continue
                j = after[i]
                k = after[j]
                now[j] = ids[j] = -1
                ids[i] = rank
                after[i] = k
                before[k] = i
                p = before[i]
                now[i] = r = rank_of(raw[i:after[k]], -1)
                if r >= 0:
                    lower = r < rank
                    if not buckets[r]:
                        mark(r)
                    heappush(buckets[r], i)
                now[p] = r = rank_of(raw[p:k], -1)
                if r >= 0:
                    lower = lower or r < rank
                    if not buckets[r]:
                        mark(r)
                    heappush(buckets[r], p)
            if not held:
                queue.clear(rank)
        left = np.array(ids, np.int64)
        left = left[left != -1]
        gaps = (np.flatnonzero(left == -2) * 4).tolist()
        packed = left.astype("<u4").tobytes()
        return [packed[a + 4:b] for a, b in zip(gaps, gaps[1:])]

    def _tokens(self, tokens: list[str]) -> Iterator[tuple[str, bytes]]:
        """Packed ids of the pattern's matches, in runs of bounded size."""
        run: list[tuple[str, bytes]] = []
        size = 0
        for token in tokens:
            raw = token.encode("utf-8")
            whole = self.ranks.get(raw)
            if whole is not None:
                yield token, whole.to_bytes(4, "little")
                continue
            if run and size + len(raw) > RUN_BYTES:
                yield from zip((t for t, _ in run), self.merge([r for _, r in run]))
                run, size = [], 0
            run.append((token, raw))
            size += len(raw)
        if run:
            yield from zip((t for t, _ in run), self.merge([r for _, r in run]))

    def _by_pattern(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        found = [self.find(t) for t in texts]
        known = self.tokens.fill_all(set().union(*found), self._tokens)
        for text, tokens in zip(texts, found):
            yield text, b"".join(map(known.__getitem__, tokens))

    @staticmethod
    def _pieces(text: str) -> list[str] | None:
        """The text cut before every blank, if no match of the pattern can
        reach over such a cut: a lone blank belongs to the word after it.
        None where white space meets white space or other kinds occur."""
        if ("  " in text or " \n" in text or "\n " in text or "\0" in text or text[-1] in " \n"
                or _ODD_SPACE.search(text)):
            return None
        return text.replace(" ", "\0 ").split("\0")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed little-endian unsigned 32-bit ids of whole texts."""
        cut = [self._pieces(t) if t else [] for t in texts]
        known = self.words.fill_all(set().union(*[c for c in cut if c]), self._by_pattern)
        whole = dict(self._by_pattern([t for t, c in zip(texts, cut) if c is None]))
        return [whole[t] if c is None else b"".join(map(known.__getitem__, c)) for t, c in zip(texts, cut)]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_CODERS: dict[tuple[str, str], ByteBpe] = {}


def coder(path: str, pattern: str) -> ByteBpe:
    """One coder per vocabulary file and Python worker."""
    if (path, pattern) not in _CODERS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _CODERS[path, pattern] = ByteBpe(ranks, pattern)
    return _CODERS[path, pattern]


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id",
                  text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode every whole text, decode the ids again, and report both digests;
    ``keep_ids`` adds the ids themselves (``ids binary``)."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary, pattern)
        for batch in batches:
            packed = bpe.encode(batch.column(1).to_pylist())
            cols = [batch.column(0), pa.array([len(p) // 4 for p in packed], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(p)).hexdigest() for p in packed], pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(packed, pa.binary())] if keep_ids else []), names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
                    + ", ids binary" * keep_ids)
