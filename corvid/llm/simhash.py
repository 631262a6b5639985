"""SimHash near-dedup (operator 8) by segment popcounts.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments.
Two fingerprints that differ in d bits have counts at a Manhattan distance of
at most d, so distance over the segments is a lower bound that loses nothing.
The segments form G groups; a distance of at most d leaves at least G - d groups
of equal counts, so every choice of G - d groups is a grid whose cells (the
counts of those groups) bring each linked pair together in at least one cell.
Inside a cell the full Manhattan bound, then the exact bit distance decide.

Only distinct fingerprints are compared, and links become star edges per cell,
so exact copies and large groups of near copies stay linear in the output.  A
cell of more than BLOCK fingerprints is cut into blocks that meet pairwise, each
pair of blocks being one group, so no task holds more than two blocks and no
pair is lost.  G follows from the number of distinct fingerprints: it only
trades grids against cell sizes, the links found are the same for any G.

Edge cases: a text without words has the fingerprint zero; texts with fewer
words than a shingle are one shingle; null doc_ids get a fingerprint and the
component of its group but never name a component (a component of null ids
alone has a null id); repeated rows are copies of each other; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import materialise, shuffle_parts, small_batches
from corvid.llm.components import components

SEED = 42
SEGMENTS = 32
BLOCK = 4096
CELL_WORK = 256            # wanted candidates per fingerprint, for the choice of G
_LOW = np.uint64(0x5555555555555555)
_ONE = np.uint64(1)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash of the word shingles (A-Z lower-cased)."""
    w = text.encode("utf-8").lower().split() if text else []
    if not w:
        return 0
    if len(w) < shingle:
        parts = iter([b" ".join(w)])
        n = 1
    else:
        parts = map(b" ".join, zip(*(w[i:] for i in range(shingle))))
        n = len(w) - shingle + 1
    h = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(h[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, h, fp): h tells texts of one id apart; fp holds the
    fingerprint's bits as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fp.view(np.int64))], ["doc_id", "h", "fp"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text")) \
        .mapInArrow(run, "doc_id long, h long, fp long")


def segment_counts(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, two bits each, in one word."""
    return (fp & _LOW) + ((fp >> _ONE) & _LOW)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed segment counts: fields are 0, 1 or 2, so
    a difference of two is the xor 10 and a difference of one is 01 or 11."""
    x = a ^ b
    low, high = x & _LOW, (x >> _ONE) & _LOW
    return 2 * np.bitwise_count(high & ~low) + np.bitwise_count(low)


def groups_for(distinct: int, distance: int) -> int:
    """Number of segment groups that keeps cells small for so many fingerprints
    (two random segments have equal counts in 3 of 8 cases)."""
    g = distance + 1
    while g < min(2 * distance, SEGMENTS) and distinct * comb(g, distance) * 0.375 ** (SEGMENTS * (g - distance) / g) > CELL_WORK:
        g += 1
    return g


def _masks(groups: int, distance: int) -> list[np.uint64]:
    cuts = [SEGMENTS * i // groups for i in range(groups + 1)]
    each = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(cuts, cuts[1:])]
    return [np.uint64(sum(c)) for c in combinations(each, groups - distance)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    ok = manhattan(segment_counts(a), segment_counts(b)) <= distance     # the lower bound
    ok[ok] = np.bitwise_count(a[ok] ^ b[ok]) <= distance                 # the exact check
    return ok


def _forest(fp: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Star edges of the linked sets among the fingerprints of one large cell."""
    left = np.sort(np.unique(fp.view(np.int64)).view(np.uint64))
    out = []
    while len(left):
        root, rest, front = left[0], left[1:], left[:1]
        while len(front) and len(rest):
            hit = np.zeros(len(rest), bool)
            for f in front:
                open_ = np.nonzero(~hit)[0]
                hit[open_[_near(rest[open_], np.full(len(open_), f), distance)]] = True
            front, rest = rest[hit], rest[~hit]
            if len(front):
                out.append((np.full(len(front), root), front))
        left = rest
    return out


def _link(cell: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges inside runs of equal cells."""
    cut = np.nonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))[0]
    size = np.diff(np.append(cut, len(cell)))
    found = []
    for s, n in zip(cut[size > 64], size[size > 64]):
        found += _forest(fp[s:s + n], distance)
    small = np.repeat((size > 1) & (size <= 64), size)
    cell, fp = cell[small], fp[small]
    for d in range(1, 64):
        at = np.nonzero(cell[d:] == cell[:-d])[0] if len(cell) > d else []
        if not len(at):
            break
        ok = _near(fp[at], fp[at + d], distance)
        found.append((fp[at[ok]], fp[at[ok] + d]))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def links(distinct: DataFrame, distance: int = 4, block: int = BLOCK, groups: int | None = None) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints exactly as all pairs
    within ``distance`` bits do."""
    spark = distinct.sparkSession
    masks = _masks(groups or groups_for(distinct.count(), distance), distance)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            counts = segment_counts(fp.view(np.uint64))
            for i, m in enumerate(masks):
                key = _mix((counts & m) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(i + 1))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0)], ["cell", "fp"])

    keyed = distinct.select("fp").mapInArrow(cells, "cell long, fp long")
    hot = materialise(keyed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block), "large-cells")
    own = F.pmod(F.xxhash64("fp"), F.col("k"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))
    dealt = keyed.join(hot, "cell", "left").withColumn("k", F.coalesce(F.ceil(F.col("n") / block), F.lit(1).cast("long"))) \
        .withColumn("own", own).withColumn("other", other) \
        .select(F.when(F.col("k") == 1, F.col("cell")).otherwise(
            F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))).alias("cell"), "fp")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def batch_of(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            cell = np.concatenate([cell, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(cell) < 50_000:
                continue
            open_from = np.searchsorted(cell, cell[-1])          # the last cell may go on
            if open_from:
                yield batch_of(*_link(cell[:open_from], fp[:open_from], distance))
                cell, fp = cell[open_from:], fp[open_from:]
        if len(cell):
            yield batch_of(*_link(cell, fp, distance))

    return dealt.repartition(shuffle_parts(spark), "cell").sortWithinPartitions("cell") \
        .mapInArrow(link, "a long, b long").filter("a <> b")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                distance: int = 4, prints: DataFrame | None = None) -> DataFrame:
    """(fp, component_id, group): for every distinct fingerprint the smallest
    doc_id of its component and the component's own fingerprint."""
    prints = prints if prints is not None else materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    root = components(links(distinct, distance))
    rooted = distinct.join(root, F.col("fp") == F.col("node"), "left") \
        .select("fp", "first", F.coalesce("root", "fp").alias("group"))
    # written first, so that adaptive execution can split a large component
    least = materialise(rooted.groupBy("group").agg(F.min("first").alias("component_id")), "component-ids")
    return rooted.select("fp", "group").join(least, "group").select("fp", "component_id", "group")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    distance: int = 4) -> DataFrame:
    """One row per document: fingerprint in hexadecimal and component."""
    prints = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    groups = near_groups(docs, id_col, text_col, shingle, distance, prints)
    return prints.join(groups, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                distance: int = 4) -> DataFrame:
    """The rows of docs whose id is the smallest of their component, one row
    per component, with all columns."""
    prints = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    groups = near_groups(docs, id_col, text_col, shingle, distance, prints)
    # ids before null; of rows that share the smallest id the smallest text hash
    keep = prints.join(groups, "fp").groupBy("group").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("m")) \
        .select(F.coalesce("m.doc_id", F.lit(-(1 << 63))).alias("k"), F.col("m.h").alias("h"))
    k = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.struct("*").alias("row"), k.alias("k"), F.xxhash64(F.col(text_col).cast("string")).alias("h"))
    return rows.join(keep, ["k", "h"], "left_semi").dropDuplicates(["k", "h"]).select("row.*")
