"""Best-fit packing (operator 10): bounded-space online best fit.

Every partition packs its own documents in one pass.  A fixed number of bins is
open; the free spaces that open bins have form a bitset, so the tightest bin
that still takes a piece is the lowest set bit at or above the piece's length.
When one bin too many is open, the fullest closes first.

Bins that are still open at a partition's end would make the number of sequences
depend on the number of files.  Those with more than 1/SLACK of their space free
are taken apart (each piece is a bin of its own again; of more than KEPT pieces,
the bin stays whole), and pieces and (open bin, tokens in it) are written as one
slim table.  The open bins, longest first, are packed into one another by the same
best fit, in groups of about GROUP bins; a join gives their pieces the new sequence
and place.  Texts are not moved, and a lost task is redone alike.

Edge cases: a null or empty text is one piece that holds the end id alone; a
null doc_id is kept as null; repeated rows are packed each for itself; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import materialise, small_batches
from corvid.llm.word_encoder import encoder

#: Rows of the first pass; ``held`` is set for open bins, all else but ``bin`` for pieces.
FIRST = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, held long"
FIRST_TYPES = (pa.int64(), pa.int32(), *[pa.int64()] * 6)

GROUP = 32_768             # unfinished bins that one task packs into one another
SLACK = 32
KEPT = 64                  # pieces of an open bin that a task holds back


class OpenBins:
    """At most ``most`` open bins of ``size`` tokens, found by free space."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.by_free: dict[int, list[int]] = {}
        self.bits = 0
        self.open = 0
        self.made = 0
        self.closed: list[int] = []         # bins that take no more, until the caller clears it

    def _put(self, free: int, bin_id: int) -> None:
        self.by_free.setdefault(free, []).append(bin_id)
        self.bits |= 1 << free
        self.open += 1

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        bin_id = held.pop()
        if not held:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.open -= 1
        return bin_id

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of 1 to ``size`` tokens."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_id = self._take(free)
        else:
            free, bin_id = self.size, self.made
            self.made += 1
        if free > length:
            if self.open >= self.most:
                self.closed.append(self._take((self.bits & -self.bits).bit_length() - 1))   # the fullest closes
            self._put(free - length, bin_id)
        else:
            self.closed.append(bin_id)
        return bin_id, self.size - free

    def unfinished(self) -> Iterator[tuple[int, int]]:
        """(bin, tokens in it) of the open bins."""
        for free, held in self.by_free.items():
            for bin_id in held:
                yield bin_id, self.size - free


def _rows(rows: list[tuple], schema: str, types: tuple) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                      [c.split()[0] for c in schema.split(", ")])


def merged(unfinished: DataFrame, seq_len: int, group: int = GROUP) -> DataFrame:
    """(bin, into, shift) of each bin of (bin, held) that another one takes: its
    pieces follow in sequence ``into``, ``shift`` tokens after its start."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, first = OpenBins(seq_len, group), {}
        for batch in batches:
            out = []
            for bin_id, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                place, shift = bins.place(held)
                into = first.setdefault(place, bin_id)
                if into != bin_id:
                    out.append((bin_id, into, shift))
            bins.closed.clear()
            yield _rows(out, "bin long, into long, shift long", (pa.int64(),) * 3)

    groups = max(1, -(-unfinished.count() // group))
    return unfinished.repartition(groups, "bin").sortWithinPartitions(F.desc("held"), "bin") \
        .mapInArrow(run, "bin long, into long, shift long")


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         end_id: int = 1, seq_len: int = 4096, open_bins: int = 1024) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    Documents are closed by ``end_id`` and cut only when longer than
    ``seq_len``.  ``open_bins`` bounds the space of a task; a bin's number is the
    partition's number and a count, and a sequence is named by its first bin."""
    small_batches(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        bins = OpenBins(seq_len, open_bins)
        base = TaskContext.get().partitionId() << 40
        kept: dict[int, list[tuple]] = {}       # rows of open bins
        whole: set[int] = set()                 # open bins some of whose rows are out
        for batch in batches:
            out: list[tuple] = []
            ids = batch.column(0).to_pylist()
            for doc, packed in zip(ids, enc.encode(batch.column(1))):
                packed += end
                n = len(packed) // 4
                for piece, start in enumerate(range(0, n, seq_len)):
                    length = min(seq_len, n - start)
                    bin_id, offset = bins.place(length)
                    crc = zlib.crc32(packed[4 * start:4 * (start + length)])
                    rows = kept.setdefault(bin_id, [])
                    rows.append((doc, piece, start, length, crc, base + bin_id, offset, None))
                    if len(rows) == KEPT:
                        out += kept.pop(bin_id)
                        whole.add(bin_id)
                    for closed in bins.closed:
                        out += kept.pop(closed, ())
                        whole.discard(closed)
                    bins.closed.clear()
            yield _rows(out, FIRST, FIRST_TYPES)
        out = []
        for bin_id, held in bins.unfinished():
            rows = kept.pop(bin_id, [])
            if bin_id in whole or (seq_len - held) * SLACK <= seq_len:
                out += [*rows, (None,) * 5 + (base + bin_id, None, held)]
            else:
                for row in rows:
                    out += [(*row[:5], base + bins.made, 0, None), (None,) * 5 + (base + bins.made, None, row[3])]
                    bins.made += 1
        yield _rows(out, FIRST, FIRST_TYPES)

    first = materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"),
                                    F.col(text_col).cast("string").alias("text")).mapInArrow(run, FIRST),
                        "packing-first")
    unfinished = first.filter(F.col("held").isNotNull()).select("bin", "held")
    pieces = first.filter(F.col("held").isNull())
    return pieces.join(merged(unfinished, seq_len), "bin", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("into", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
