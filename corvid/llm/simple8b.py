"""Simple-8b word-aligned coding of ids in NumPy.

A 64-bit word holds a 4-bit selector and up to 60 bits of payload; the selector
says how many ids the word packs and how wide each is.  Selector 0 is the
escape: the next word is one raw id of 61 to 64 bits.  Ids are coded in blocks
of a fixed count with a word offset for each, so any block can be decoded
alone, and all words of one selector are (un)packed by one array operation.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024

#: Fixed values of the format: (ids in a word, bits of each) for selectors 1 to 15.
PACKS = ((120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7),
         (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))

_COUNT = np.array([1] + [c for c, _ in PACKS], dtype=np.int64)
_PAD = 120
_POWERS = 1 << np.arange(64, dtype=np.uint64)


def _window_max(bits: np.ndarray, count: int, doubled: dict[int, np.ndarray]) -> np.ndarray:
    """Largest of each ``count`` neighbours, from maxima over powers of two."""
    half = 1 << (count.bit_length() - 1)
    k = max(doubled)
    while k < half:
        a = doubled[k]
        b = a.copy()
        np.maximum(a[:, :-k], a[:, k:], out=b[:, :-k])
        doubled[2 * k] = b
        k *= 2
    top, rest = doubled[half], count - half
    if not rest:
        return top
    out = top.copy()
    np.maximum(top[:, :-rest], top[:, rest:], out=out[:, :-rest])
    return out


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block and the end) of unsigned ids."""
    ids = np.asarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    rows = -(-n // block)
    wide = block + _PAD
    vals = np.zeros((rows, wide), np.uint64)
    flat = np.zeros(rows * block, np.uint64)
    flat[:n] = ids
    vals[:, :block] = flat.reshape(rows, block)
    bits = np.searchsorted(_POWERS, vals, side="right").astype(np.uint8)
    best = np.zeros((rows, wide), np.uint8)
    doubled = {1: bits}
    for code in range(15, 0, -1):       # larger counts overwrite smaller ones
        count, width = PACKS[code - 1]
        np.copyto(best, np.uint8(code), where=_window_max(bits, count, doubled) <= width)
    length = np.full(rows, block, np.int64)
    length[-1] = n - (rows - 1) * block
    at = np.zeros(rows, np.int64)
    row = np.arange(rows)
    starts, owners = [], []
    while len(row):                     # one word of every unfinished block a round
        here = at[row]
        starts.append(row * wide + here)
        owners.append(row)
        at[row] = here + _COUNT[best[row, here]]
        row = row[at[row] < length[row]]
    start, owner = np.concatenate(starts), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    start, owner = start[order], owner[order]
    code = best.ravel()[start]
    place = np.cumsum(1 + (code == 0)) - 1          # an escape takes two words
    words = np.zeros(int(place[-1]) + 1, np.uint64)
    flat = vals.ravel()
    for c in np.unique(code):
        mine = np.nonzero(code == c)[0]
        if c == 0:
            words[place[mine]] = flat[start[mine]]  # raw id; its header stays zero
            continue
        count, width = PACKS[c - 1]
        word = np.full(len(mine), np.uint64(int(c) << 60), np.uint64)
        if width:
            for j in range(count):
                word |= flat[start[mine] + j] << np.uint64(j * width)
        words[place[mine]] = word
    per_block = np.bincount(owner, weights=1 + (code == 0), minlength=rows).astype(np.int64)
    return words, np.concatenate([[0], np.cumsum(per_block)])


def decode(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` ids of consecutive blocks; offsets count from ``words[0]``."""
    if not n:
        return np.zeros(0, np.uint64)
    words = np.asarray(words, dtype=np.uint64)
    rows = len(offsets) - 1
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    code = (words >> np.uint64(60)).astype(np.int64)
    head = np.ones(len(words), bool)
    for p in np.nonzero(code == 0)[0]:              # escapes only
        if head[p]:
            head[p + 1] = False
    heads = np.nonzero(head)[0]
    code, owner = code[heads], owner[heads]
    count = _COUNT[code]
    end = np.cumsum(count)
    first = np.searchsorted(owner, np.arange(rows))
    place = end - count
    place = place - place[first][owner]
    wide = block + _PAD
    out = np.zeros(rows * wide, np.uint64)
    base = owner * wide + place
    for c in np.unique(code):
        mine = np.nonzero(code == c)[0]
        if c == 0:
            out[base[mine]] = words[heads[mine] + 1]
            continue
        many, width = PACKS[c - 1]
        if width:
            word, mask = words[heads[mine]], np.uint64((1 << width) - 1)
            for j in range(many):
                out[base[mine] + j] = (word >> np.uint64(j * width)) & mask
    return out.reshape(rows, wide)[:, :block].ravel()[:n]
