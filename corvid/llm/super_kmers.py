"""Substring dedup (operator 9) by super-k-mer partitioning.

A window is ``window`` consecutive words of one document.  Its minimiser is the
smallest hash among its runs of MINI words, the leftmost if equal, so it depends
on the window's words alone.  Consecutive windows with one minimiser form a
super-k-mer, which goes to the minimiser's bucket as one packed string; sorting
the windows cut from a bucket's strings counts them exactly.

Only super-k-mers whose minimiser occurs more than once travel as strings: slim
rows (minimiser, document, place) are counted first, with partial sums before
the shuffle, and texts without a repeated minimiser are left alone.  A
minimiser of more than HOT super-k-mers (a passage in a third of all documents)
is not sent to one bucket: its windows travel one by one and are counted by
grouping on the window itself, again with partial sums.  Joins of such keys
have one row per key on the other side, which adaptive execution splits.

Edge cases: a null or empty text has no words; documents shorter than a window
lose nothing; repeated rows (equal doc_id and text) are repeats of each other,
so all their windows go; null doc_ids are treated like any other id; other
columns are ignored, or kept by ``without_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import byte_words, materialise, shuffle_parts, small_batches

MINI = 8                   # words of a minimiser
HOT = 4000                 # super-k-mers of one minimiser that share a bucket
SLICE_WORDS = 1 << 22      # words of several documents that are worked on at once
_POS = np.uint64((1 << 24) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cut(docs: list[list[bytes]], window: int, mini: int) -> tuple[np.ndarray, ...]:
    """Super-k-mers of documents: (document, first word, windows, minimiser)."""
    size = np.array([len(w) for w in docs], np.int64)
    n = int(size.sum())
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none.astype(np.uint64)
    h = np.fromiter((xxhash.xxh64_intdigest(x) for w in docs for x in w), np.uint64, n)
    runs = np.zeros(n - mini + 1, np.uint64)
    for j in range(mini):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + h[j:n - mini + 1 + j]
    runs = _mix(runs)
    at = np.arange(len(runs), dtype=np.uint64)
    key = (runs & ~_POS) | (at & _POS)              # equal hashes: the leftmost wins
    width, half = window - mini + 1, 1
    least = key
    while 2 * half <= width:
        least = np.minimum(least[:-half], least[half:])
        half *= 2
    windows = n - window + 1
    least = np.minimum(least[:windows], least[width - half:width - half + windows])
    place = at[:windows] + ((least - at[:windows]) & _POS)
    first = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(docs)), size)
    whole = owner[:windows] == owner[window - 1:]
    new = whole.copy()
    new[1:] &= ~whole[:-1] | (place[1:] != place[:-1])
    start = np.nonzero(new)[0]
    ends = np.nonzero(whole & ~np.append(whole[1:] & ~new[1:], False))[0]
    return owner[start], start - first[owner[start]], ends - start + 1, runs[place[start].astype(np.int64)]


def _slices(texts: list[str | None]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Words of consecutive documents, about SLICE_WORDS at a time."""
    held, n, first = [], 0, 0
    for i, t in enumerate(texts):
        held.append(byte_words(t))
        n += len(held[-1])
        if n >= SLICE_WORDS:
            yield first, held
            held, n, first = [], 0, i + 1
    if held:
        yield first, held


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, k, text): k is the id, null as the smallest long; rid a hash of
    id and text that stands for the row in slim tables."""
    k = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.xxhash64(k, text).alias("rid"), k.alias("k"), text.alias("text"))


def _count_bucket(packed: list[bytes], window: int) -> list[int]:
    """Per string of one bucket the bits of its windows that occur elsewhere."""
    flags = [0] * len(packed)
    if all(p == packed[0] for p in packed[1:]):
        return [-1] * len(packed) if len(packed) > 1 else flags
    rows = []
    for s, p in enumerate(packed):
        cuts = [0]
        at = p.find(b" ")
        while at >= 0:
            cuts.append(at + 1)
            at = p.find(b" ", at + 1)
        cuts.append(len(p) + 1)
        rows += [(p[cuts[i]:cuts[i + window] - 1], s, i) for i in range(len(cuts) - window)]
    rows.sort()
    for a, b in zip(rows, rows[1:]):
        if a[0] == b[0]:
            flags[a[1]] |= 1 << a[2]
            flags[b[1]] |= 1 << b[2]
    return flags


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35,
             mini: int = MINI, hot: int = HOT) -> DataFrame:
    """(rid, k, n_removed, kept) of the documents that lose words; kept is the
    words that stay, joined by blanks."""
    if not 1 <= mini <= window or window - mini + 1 > 62:
        raise ValueError("a minimiser lies in a window, in at most 62 places")
    spark = docs.sparkSession
    small_batches(spark)
    rows = _keyed(docs, id_col, text_col)

    def slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column(0).to_numpy(zero_copy_only=False)
            for first, words in _slices(batch.column(1).to_pylist()):
                owner, start, n, least = cut(words, window, mini)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(least.view(np.int64)), pa.array(rid[first + owner]), pa.array(start << 8 | n)],
                    ["mini", "rid", "pos"])

    places = rows.select("rid", "text").mapInArrow(slim, "mini long, rid long, pos long")
    # written first: adaptive execution can split a hot minimiser only where both
    # sides of the join come straight from a shuffle
    counts = materialise(places.groupBy("mini").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
                         .select("mini", (F.col("c") > hot).alias("hot")), "repeated-minimisers")
    wanted = places.join(counts, "mini").groupBy("rid") \
        .agg(F.collect_set(F.struct("pos", "mini", "hot")).alias("marks"))
    touched = materialise(rows.join(wanted, "rid"), "repeat-candidates")

    schema = "rid long, k long, start int, n int, mini long, hot boolean, p1 long, p2 long, packed binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rid, k, text, marks in zip(*(c.to_pylist() for c in batch.columns)):
                words = byte_words(text)
                for m in marks:
                    start, n = m["pos"] >> 8, m["pos"] & 255
                    if start + n + window - 1 > len(words):
                        continue                    # of another row with the same hash
                    for s, many in ([(start + i, 1) for i in range(n)] if m["hot"] else [(start, n)]):
                        p = b" ".join(words[s:s + many + window - 1])
                        d = xxhash.xxh3_128_digest(p)
                        out.append((rid, k, s, many, m["mini"], m["hot"], int.from_bytes(d[:8], "little", signed=True),
                                    int.from_bytes(d[8:], "little", signed=True), p))
                if len(out) > 20_000:
                    yield _record(out)
                    out = []
            if out:
                yield _record(out)

    def _record(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                          ["rid", "k", "start", "n", "mini", "hot", "p1", "p2", "packed"])

    packed = touched.select("rid", "k", "text", "marks").mapInArrow(pack, schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close(out: list[tuple]) -> None:
            if len(held) > 1:
                for (p1, p2, _), f in zip(held, _count_bucket([x[2] for x in held], window)):
                    if f:
                        out.append((p1, p2, f))

        def emit(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["p1", "p2", "flags"])

        for batch in batches:
            out: list[tuple] = []
            for mini_, p1, p2, p in zip(*(c.to_pylist() for c in batch.columns)):
                if mini_ != now:
                    close(out)
                    now, held = mini_, []
                held.append((p1, p2, p))
            if out:
                yield emit(out)
        out = []
        close(out)
        if out:
            yield emit(out)

    cold = packed.filter("NOT hot").select("mini", "p1", "p2", "packed") \
        .repartition(shuffle_parts(spark), "mini").sortWithinPartitions("mini") \
        .mapInArrow(count, "p1 long, p2 long, flags long")
    single = packed.filter("hot").groupBy("packed", "p1", "p2").agg(F.count(F.lit(1)).alias("c")) \
        .filter("c > 1").select("p1", "p2", F.lit(1).cast("long").alias("flags"))
    flags = materialise(cold.unionByName(single).groupBy("p1", "p2").agg(F.bit_or("flags").alias("flags")), "repeated-windows")
    marked = packed.select("rid", "k", "start", "n", "p1", "p2").join(flags, ["p1", "p2"]) \
        .groupBy("rid", "k").agg(F.collect_set(F.struct("start", "n", "flags")).alias("runs"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, k, text, runs = (c.to_pylist() for c in batch.columns)
            lost, kept = [], []
            for t, marks in zip(text, runs):
                words = byte_words(t)
                edge = np.zeros(len(words) + 1, np.int64)
                for m in marks:
                    starts = [m["start"] + i for i in range(m["n"]) if m["flags"] >> i & 1]
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, np.array(starts, np.int64) + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                lost.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode("utf-8"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lost, pa.int64()),
                                              pa.array(kept, pa.string())], ["rid", "k", "n_removed", "kept"])

    # equal rows (same id and text) are one row here
    return touched.select("rid", "k", "text").dropDuplicates(["rid", "k"]).join(marked, ["rid", "k"]) \
        .select("rid", "k", "text", "runs").mapInArrow(remove, "rid long, k long, n_removed long, kept string")


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """Per document its words, the words removed and the digest of what stays."""
    spark = docs.sparkSession
    small_batches(spark)
    lost = removals(docs, id_col, text_col, window).select("rid", "k", "n_removed", F.sha2("kept", 256).alias("sha"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha = [], []
            for t in batch.column(3).to_pylist():
                w = byte_words(t)
                n.append(len(w))
                sha.append(hashlib.sha256(b" ".join(w)).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(sha, pa.string())],
                                             ["doc_id", "rid", "k", "n_words", "full"])

    ids = _keyed(docs, id_col, text_col)
    base = ids.select(F.when(F.col("k") != -(1 << 63), F.col("k")).alias("doc_id"), "rid", "k", "text") \
        .mapInArrow(whole, "doc_id long, rid long, k long, n_words long, full string")
    return base.join(lost, ["rid", "k"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("sha", "full").alias("kept_sha256"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35,
                    length_col: str | None = None) -> DataFrame:
    """docs with the repeated words taken out of the texts that have them (and
    ``length_col``, if named, set to their new length); other texts and all
    other columns stay as they are."""
    lost = removals(docs, id_col, text_col, window).select("rid", "k", "kept")
    k = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(k, text).alias("rid"), k.alias("k")).join(lost, ["rid", "k"], "left")
    new = {text_col: F.col("kept"), length_col: F.length("kept").cast("long")}
    return rows.select(*[(F.coalesce(new[c], F.col("row")[c]) if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


def oracle(window: int = 35) -> str:
    """DuckDB SQL of ``dedup_report`` over the table documents: every window is spelled out."""
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id,
                     regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
word AS (SELECT rid, unnest(words) AS word, unnest(range(len(words))) AS pos, len(words) AS n FROM docs),
spelled AS (SELECT rid, pos, word, CASE WHEN pos + {window} <= n THEN string_agg(word, ' ') OVER (
                PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING) END AS spelling FROM word),
counted AS (SELECT rid, pos, word, spelling IS NOT NULL AND count(*) OVER (PARTITION BY spelling) > 1 AS again FROM spelled),
covered AS (SELECT rid, pos, word, bool_or(again) OVER (
                PARTITION BY rid ORDER BY pos ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) AS gone FROM counted),
kept AS (SELECT rid, count(*) FILTER (WHERE gone) AS n_removed,
                string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM covered GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (rid)"""
