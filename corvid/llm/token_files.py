"""Token-ID output (operator 2): Simple-8b token files in document order.

Texts are range-partitioned by doc_id, sorted inside each partition and
tokenized there; every task streams its ids into one file of Simple-8b blocks
in the shared folder and returns its index rows (document, file, place).  The
committed index names only files of tasks that finished, so a retried task
leaves at most an unnamed file behind.  Places over the whole corpus are the
running sum of one total per file.  Reading decodes only the blocks that the
asked documents touch.

File: MAGIC, code words, word offset of every block and the end (unsigned 64
bit), then a trailer (ids, block length, blocks, MAGIC).  All little-endian.

Edge cases: a null or empty text has the end id alone; null doc_ids come first
and stay null; equal doc_ids are ordered by text; an empty table writes no ids;
other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvid.llm import simple8b
from corvid.llm.common import materialise, shared_path, shuffle_parts, small_batches
from corvid.llm.word_encoder import encoder

MAGIC = b"S8BTOK01"
_TRAILER = struct.Struct("<QIQ8s")
FLUSH_IDS = 512 * simple8b.BLOCK

INDEX_SCHEMA = "doc_id long, file string, part int, first long, n_tokens long"


class TokenFileWriter:
    """Streams ids into one file; holds at most about FLUSH_IDS of them."""

    def __init__(self, uri: str):
        store, path = pafs.FileSystem.from_uri(uri)
        self.out = store.open_output_stream(path)
        self.out.write(MAGIC)
        self.held: list[bytes] = []
        self.held_ids = self.ids = 0
        self.offsets = [np.zeros(1, np.int64)]

    def add(self, packed: bytes) -> int:
        first = self.ids
        self.held.append(packed)
        self.held_ids += len(packed) // 4
        self.ids += len(packed) // 4
        if self.held_ids >= FLUSH_IDS:
            self._flush(whole_blocks=True)
        return first

    def _flush(self, whole_blocks: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        keep = len(ids) // simple8b.BLOCK * simple8b.BLOCK if whole_blocks else len(ids)
        for at in range(0, keep, FLUSH_IDS):            # a very long text in steps
            words, offsets = simple8b.encode(ids[at:min(at + FLUSH_IDS, keep)])
            self.out.write(words.astype("<u8").tobytes())
            self.offsets.append(self.offsets[-1][-1] + offsets[1:])
        self.held = [ids[keep:].tobytes()]
        self.held_ids = len(ids) - keep

    def close(self) -> None:
        self._flush(whole_blocks=False)
        offsets = np.concatenate(self.offsets)
        self.out.write(offsets.astype("<u8").tobytes())
        self.out.write(_TRAILER.pack(self.ids, simple8b.BLOCK, len(offsets) - 1, MAGIC))
        self.out.close()


class TokenFileReader:
    def __init__(self, uri: str):
        store, path = pafs.FileSystem.from_uri(uri)
        self.source = store.open_input_file(path)
        size = self.source.size()
        self.ids, self.block, blocks, magic = _TRAILER.unpack(
            self.source.read_at(_TRAILER.size, size - _TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        n = 8 * (blocks + 1)
        self.offsets = np.frombuffer(self.source.read_at(n, size - _TRAILER.size - n), "<u8").astype(np.int64)

    def read(self, first: int, n: int) -> np.ndarray:
        """Ids ``first`` to ``first + n``, decoding only their blocks."""
        if not n:
            return np.zeros(0, np.uint64)
        lo, hi = first // self.block, -(-(first + n) // self.block)
        start, end = int(self.offsets[lo]), int(self.offsets[hi])
        words = np.frombuffer(self.source.read_at(8 * (end - start), len(MAGIC) + 8 * start), "<u8")
        upto = min(hi * self.block, self.ids) - lo * self.block
        ids = simple8b.decode(words, self.offsets[lo:hi + 1] - start, upto, self.block)
        return ids[first - lo * self.block:][:n]


def write_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write the token files; return the committed index (doc_id, file, part,
    first id in the file, ids)."""
    spark = docs.sparkSession
    small_batches(spark)
    root = folder or shared_path(spark, "tokens")
    if "://" not in root:
        root = root.replace("file:", "", 1) if root.startswith("file:") else root
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        part = TaskContext.get().partitionId()
        uri, out = f"{root}/part-{part:06d}-{uuid.uuid4().hex}.s8b", None
        store, path = pafs.FileSystem.from_uri(root)
        store.create_dir(path, recursive=True)
        for batch in batches:
            out = out or TokenFileWriter(uri)
            first, count = [], []
            for packed in enc.encode(batch.column(1)):
                first.append(out.add(packed + end))
                count.append(len(packed) // 4 + 1)
            n = len(first)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([uri] * n, pa.string()), pa.array([part] * n, pa.int32()),
                 pa.array(first, pa.int64()), pa.array(count, pa.int64())],
                ["doc_id", "file", "part", "first", "n_tokens"])
        if out:
            out.close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # equal ids (repeated rows) may be many: the text's hash lets them spread
    # over several partitions and still be in order
    rows = rows.withColumn("h", F.xxhash64("text"))
    order = ["doc_id", "h", "text"]
    rows = rows.repartitionByRange(shuffle_parts(spark), "doc_id", "h").sortWithinPartitions(*order)
    return materialise(rows.select("doc_id", "text").mapInArrow(run, INDEX_SCHEMA), "token-index")


def read_tokens(index: DataFrame) -> DataFrame:
    """Read the files back: per document its place in the whole corpus, length
    and crc32 of the decoded ids."""
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    before = totals.select("part", (F.sum("t").over(Window.orderBy("part")) - F.col("t")).alias("before"))
    # one row per written file, so this side is as small as the list of tasks
    placed = index.join(F.broadcast(before), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, name = None, None
        for batch in batches:
            files, first = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            count, crc = batch.column(3).to_pylist(), [0] * batch.num_rows
            i = 0
            while i < len(files):
                j = i
                while j + 1 < len(files) and files[j + 1] == files[i] and first[j + 1] == first[j] + count[j]:
                    j += 1
                if name != files[i]:
                    reader, name = TokenFileReader(files[i]), files[i]
                data = reader.read(first[i], first[j] + count[j] - first[i]).astype("<u4")
                for k in range(i, j + 1):
                    at = first[k] - first[i]
                    crc[k] = zlib.crc32(data[at:at + count[k]].tobytes())
                i = j + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(4), batch.column(3), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.select("doc_id", "file", "first", "n_tokens", (F.col("first") + F.col("before")).alias("start")) \
        .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
