"""Whole-text encoding with the tokenizers library, one distinct word at a time.

The vocabularies used here drop white space and never merge across it, so the
ids of a text are the ids of its blank-separated pieces in order.  Arrow splits
a batch of texts, numbers its distinct pieces and cuts them into lower-case word
and signs; each Python worker keeps bounded tables from word to packed ids and
calls the library for words that it has not met.  Arrow then puts the ids of all
pieces in text order, so a repeated word costs no Python inside a batch.
"""

from __future__ import annotations

import os
import struct
import sys
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A piece of letters, perhaps with signs after it.  These letters (ASCII, Latin-1
#: and Latin Extended-A without the dotted capital I) are in composed form, and
#: each has one lower-case letter of the same set.
_WORD_AND_SIGNS = "^(?P<word>[A-Za-zÀ-ÖØ-öø-įı-ſ]*)(?P<signs>[[:punct:]]*)$"

_ID = attrgetter("id")

#: Memory of a generation of a word table, and the longest key that outlasts its
#: batch: a text without blanks is one piece, and is encoded whole each time.
TABLE_BYTES = 64 << 20
SLOT_BYTES = 100
LONGEST_KEY = 256


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies: bytes
    that print stand for themselves, the others take code points from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class PieceTable:
    """A dict of bounded memory in two generations: when the young one holds
    ``limit`` bytes it becomes the old one, and what is used again moves back.
    Keys over LONGEST_KEY leave with the next batch."""

    def __init__(self, limit: int = TABLE_BYTES):
        self.limit = limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0
        self.passing: list[str] = []

    def _keep(self, k: str, v: bytes) -> None:
        self.young[k] = v
        if len(k) > LONGEST_KEY:
            self.passing.append(k)
        else:
            self.size += sys.getsizeof(k) + sys.getsizeof(v) + SLOT_BYTES

    def fill_all(self, keys: set[str], make_all) -> dict[str, bytes]:
        """Make sure that all keys are in the young generation; return it.
        ``make_all`` gives (key, value) of a list of keys."""
        for k in self.passing:
            del self.young[k]
        self.passing = []
        if self.size > self.limit:
            self.old, self.young, self.size = self.young, {}, 0
        missing = keys.difference(self.young)   # (of the dict: its key view would be walked)
        new = missing.difference(self.old)
        for k in missing - new:
            self._keep(k, self.old[k])
        for k, v in make_all(list(new)):
            self._keep(k, v)
        return self.young

    def fill(self, keys: set[str], make) -> dict[str, bytes]:
        return self.fill_all(keys, lambda new: ((k, make(k)) for k in new))


class WordEncoder:
    """Packed little-endian unsigned 32-bit ids of whole texts.

    Equal to ``Tokenizer.encode(text, add_special_tokens=False)`` for a
    tokenizer that lower-cases, drops white space and splits letters from
    digits and signs (``public_tokenizers.path("word_bpe_49k.json")``)."""

    def __init__(self, path: str, limit: int = TABLE_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        self.model = self.lib.model
        self.alphabet = byte_alphabet()
        self.words = PieceTable(limit)
        self.others = PieceTable(limit)

    def _by_library(self, piece: str) -> bytes:
        ids = self.lib.encode(piece, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, low: str) -> bytes:
        """A word of letters goes to the library's BPE model directly."""
        if not low.isascii():
            low = "".join(map(self.alphabet.__getitem__, low.encode("utf-8")))
        ids = list(map(_ID, self.model.tokenize(low))) if low else []
        return struct.pack(f"<{len(ids)}I", *ids)

    @staticmethod
    def _look_up(pieces: pa.Array, table: PieceTable, make) -> pa.Array:
        """Packed ids of pieces; 64-bit offsets, as they may outgrow the text."""
        keys = pieces.to_numpy(zero_copy_only=False).tolist()
        known = table.fill(set(keys), make)
        return pa.array(list(map(known.__getitem__, keys)), pa.large_binary())

    def _packed(self, pieces: pa.Array) -> pa.Array:
        """Packed ids of distinct pieces: letters end where signs begin, so word
        and signs are looked up each for itself; a piece of any other shape
        takes the library's full path."""
        parts = pc.extract_regex(pieces, _WORD_AND_SIGNS)
        words = pc.utf8_lower(pc.struct_field(parts, 0)).dictionary_encode()
        signs = pc.struct_field(parts, 1).dictionary_encode()
        packed = pc.binary_join_element_wise(
            self._look_up(words.dictionary, self.words, self._word).take(words.indices),
            self._look_up(signs.dictionary, self.others, self._by_library).take(signs.indices),
            pa.scalar(b"", pa.large_binary()))
        odd = pc.is_null(parts)
        return pc.replace_with_mask(packed, odd, self._look_up(pieces.filter(odd), self.others, self._by_library))

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        if not len(coded):
            return [b""] * len(texts)
        _, offsets, data = self._packed(coded.dictionary).take(coded.indices).buffers()
        at = np.frombuffer(offsets, np.int64)[split.offsets.to_numpy()].tolist()
        data = memoryview(data) if data else b""
        return [bytes(data[a:b]) for a, b in zip(at, at[1:])]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
