"""Approximate nearest neighbours (operator 5) by a hash-prefix forest.

Every tree holds all vectors sorted by a 64-bit hash string of random
hyperplane signs.  A query descends in every tree to the rows that share its
longest prefix and then ascends in all trees at once, one bit a step, until the
rows found under the shorter prefix are enough; these are compared exactly.
Rows and queries are hashed by their direction from the mean, which shifts every
score of one query by the same amount.  The direction says nothing of the norm,
so rows of like norms form a band with a forest of its own, and every band
answers every query.

How many rows are enough is measured on the data: SAMPLE queries (the smallest
hashes of their ids) are also searched by brute force, and the band that loses
most of their neighbours per row is widened, from LEAST rows a tree in doubling
steps to MOST, until they have a recall of RECALL on average and of FLOOR in all
but a twentieth of them.  These are numbers of rows, not shares, so the work of a
query follows from how the vectors cluster and not from how many there are.  A
band that misses the recall at MOST, or whose trees would compare more than twice
its rows, is searched from the root of a single tree, which is exact.

The sorted arrays are partitioned by (tree, first bits), as many bits as give
parts of 4 to 8 times MOST rows; a part that clustered vectors make larger is cut
into blocks that each of its queries visits, so no task holds more than about
BLOCK rows.  The first pass moves hashes only and yields, per query and tree, how
many rows share each prefix length; the sums fix the level per query.  The second
pass compares inside the parts and returns only each part's best rows.  A query
that finds too few rows in its own parts of a band ascends to the root, too.

Equal vectors are one class with its smallest ids (k + 1 of them can matter), so
copies cost one row, and equal queries are searched once.

Isotropic vectors (no clusters to find) of many dimensions end with every row
compared with every query; clustered vectors need a small share of the rows.

Edge cases: vectors that are null, zero or hold null or non-finite components take
no part, nor do null ids; vectors of one length are searched among themselves, as
there is no inner product between lengths; an id that repeats with other vectors is
several rows, each a candidate and (divisible ids) a query, and the same row given
twice is one; with fewer candidates than k all are returned; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvid.llm.common import materialise

TREES = 24
LEAST, MOST = 8, 4096      # rows asked of a tree: the first and the last of the doubling steps
SMALL = 6144               # norms of bands of fewer rows are not told apart
BANDS = 8                  # forests for rows of like norms; the last takes all shorter rows
SAMPLE = 128               # queries searched by brute force as well
RECALL, FLOOR = 0.95, 0.75
BLOCK = 8192
LEVELS = 24                # prefix lengths beyond the parts' own that are counted
OUT = "query_id long, rank int, vec_id long, score double"


def planes(dim: int, trees: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, trees * 64))


def hashes(vectors: np.ndarray, p: np.ndarray) -> np.ndarray:
    """(rows, trees) hash strings."""
    signs = (vectors @ p > 0).reshape(len(vectors), p.shape[1] // 64, 8, 8)
    return np.ascontiguousarray(np.packbits(signs, axis=3)[:, :, ::-1, 0]).view(np.uint64)[:, :, 0]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return np.asarray(column.flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _prefix(h: np.ndarray, bits: int) -> np.ndarray:
    return h >> np.uint64(64 - bits) if bits else np.zeros_like(h)


def _centre(classes: DataFrame, dim: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim)
        for batch in batches:
            if len(batch):
                total += _matrix(batch.column(0)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(total)], ["i", "x"])

    sums = classes.select("v").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    return np.array([r["x"] for r in sorted(sums)])


def _octave(square: np.ndarray) -> np.ndarray:
    """Whole part of the binary logarithm of squared norms, plus one; 0 has the least."""
    return np.where(square > 0, np.frexp(square)[1], -2000)


def _bands(classes: DataFrame, centre: np.ndarray, small: int) -> list[tuple[int, int]]:
    """(lowest octave, rows) per band, the longest rows first.

    A band spans norms that differ by at most twice, or has at most ``small`` rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                square = ((_matrix(batch.column(0)) - centre) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(_octave(square), pa.int32())], ["o"])

    found = classes.select("v").mapInArrow(run, "o int").groupBy("o") \
        .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("o")).collect()
    out: list[list] = []                       # highest octave, lowest, rows
    for r in found:
        if out and (len(out) == BANDS or out[-1][0] - r["o"] < 2 or out[-1][2] + r["n"] <= small):
            out[-1][1:3] = r["o"], out[-1][2] + r["n"]
        else:
            out.append([r["o"], r["o"], r["n"]])
    return [(low, n) for _, low, n in out]


def _widths(missed, sizes: list[int], steps: list[list[int | None]], total: np.ndarray) -> list[int | None]:
    """Per band the rows that are enough (None: the whole band).  ``missed(b, enough)``
    gives the neighbours that each sample query loses in band ``b``, of ``total``."""
    at = [0] * len(sizes)
    lost = [missed(b, steps[b][0]) for b in range(len(sizes))]
    asked = total > 0
    while True:
        recall = 1 - sum(lost)[asked] / total[asked]
        if not len(recall) or (recall.mean() >= RECALL and np.quantile(recall, 0.05) >= FLOOR):
            return [steps[b][i] for b, i in enumerate(at)]
        b = max(range(len(sizes)), key=lambda x: lost[x].sum() / sizes[x])
        at[b] += 1
        lost[b] = missed(b, steps[b][at[b]])


def clean(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v): the rows that take part, equal rows once."""
    v = F.col("v")
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")) \
        .filter(F.col("vec_id").isNotNull() & v.isNotNull()) \
        .filter(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))) \
        .filter(F.exists(v, lambda x: x != 0.0)) \
        .withColumn("v", F.transform(v, lambda x: x + 0.0)).distinct()       # -0.0 and 0.0 are one value


def _measured(classes: DataFrame, distinct: DataFrame, sums: DataFrame, k: int, steps: list, held: list[int],
              part_bits: list[int], trees: int, hash_of, band_of, centre: np.ndarray) -> list[int | None]:
    """Per band the rows that are enough, by the brute-force neighbours of SAMPLE queries."""
    sample = distinct.orderBy(F.xxhash64("qid"), "qid").limit(SAMPLE).collect()
    if not sample:
        return [step[-1] for step in steps]
    qid, q = np.array([r["qid"] for r in sample]), np.array([r["v"] for r in sample])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each task's k nearest rows of every sample query."""
        best = [(np.zeros(0), np.zeros((0, q.shape[1])), np.zeros(0, np.int64)) for _ in qid]
        for batch in batches:
            if not len(batch):
                continue
            cid, v = batch.column(0).to_numpy(), _matrix(batch.column(1))
            dots = q @ v.T
            for i, (score, rows, ids) in enumerate(best):
                # the query's own vector is no neighbour
                some = np.argpartition(-dots[i], k)[:k + 1] if len(v) > k + 1 else np.arange(len(v))
                some = some[(v[some] != q[i]).any(axis=1)]
                score, rows, ids = np.append(score, dots[i][some]), np.vstack([rows, v[some]]), np.append(ids, cid[some])
                top = np.lexsort((ids, -score))[:k]
                best[i] = score[top], rows[top], ids[top]
        score, rows, ids = (np.concatenate(x) for x in zip(*best))
        v = rows - centre
        square = (v * v).sum(axis=1)
        h = hash_of(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(qid)), [len(b[0]) for b in best]).astype(np.int32)), pa.array(ids), pa.array(score),
             pa.array(band_of(square).astype(np.int32)),
             pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1, dtype=np.int32) * trees), pa.array(h.view(np.int64).ravel()))],
            ["i", "cid", "score", "band", "h"])

    nearest = Window.partitionBy("i").orderBy(F.desc("score"), "cid")
    truth = classes.select("cid", "v").mapInArrow(run, "i int, cid long, score double, band int, h array<long>") \
        .withColumn("r", F.row_number().over(nearest)).filter(F.col("r") <= k).select("i", "band", "h").collect()
    of, band = np.array([r["i"] for r in truth], int), np.array([r["band"] for r in truth], int)
    theirs = np.array([r["h"] for r in truth], np.int64).reshape(-1, trees).view(np.uint64)
    apart = theirs ^ hash_of(q - centre)[of]
    shared = np.zeros(len(truth), int)         # longest prefix that any tree shares
    for bits in range(1, 65):
        shared[(_prefix(apart, bits) == 0).any(axis=1)] = bits
    found = np.zeros((len(held), len(qid), LEVELS + 1), np.int64)
    for r in sums.join(F.broadcast(distinct.sparkSession.createDataFrame([(int(x),) for x in qid], "id long")), "id").collect():
        found[r["band"], np.nonzero(qid == r["id"])[0][0]] = r["s"]

    def missed(b: int, enough: int | None) -> np.ndarray:
        if enough is None:
            return np.zeros(len(qid), int)
        level = (found[b] >= enough).sum(axis=1) - 1
        whole = (level < 0) | (found[b][np.arange(len(qid)), level] >= 2 * held[b])
        lost = (band == b) & ~whole[of] & (shared < part_bits[b] + level[of])
        return np.bincount(of[lost], minlength=len(qid))

    return _widths(missed, held, steps, np.bincount(of, minlength=len(qid)))


def search(rows: DataFrame, queries: DataFrame, k: int = 20, trees: int = TREES, least: int = LEAST, most: int = MOST,
           block: int = BLOCK, seed: int = 11, report: list | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): rows and queries are ``clean`` tables; a query
    is no candidate of its own.  ``report`` gets a dict per vector length: rows,
    queries, the mean number of rows compared per query (repeats included) and the
    share of (query, band) pairs that ascended to the root."""
    lengths = [r["d"] for r in rows.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]
    found = [_search(*(x.filter(F.size("v") == d) for x in (rows, queries)), d, k, trees, least, most, block, seed, report)
             for d in lengths]
    if not found:
        return rows.sparkSession.createDataFrame([], OUT)
    return reduce(DataFrame.unionAll, found)


def _search(rows: DataFrame, queries: DataFrame, dim: int, k: int, trees: int, least: int, most: int, block: int,
            seed: int, report: list | None) -> DataFrame:
    spark = rows.sparkSession
    first_ids = Window.partitionBy("v").orderBy("vec_id")
    # the sort makes the numbers of the classes ascend with their smallest ids
    classes = rows.withColumn("r", F.row_number().over(first_ids)).filter(F.col("r") <= k + 1) \
        .groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")) \
        .orderBy(F.get("ids", F.lit(0)), "v").select(F.monotonically_increasing_id().alias("cid"), "ids", "v")
    classes = materialise(classes, "vector-classes")
    distinct = materialise(queries.select("v").distinct().select(F.monotonically_increasing_id().alias("qid"), "v"), "query-classes")
    n = classes.count()
    centre = _centre(classes, dim) / n
    bands = _bands(classes, centre, SMALL)
    lows = np.array([-low for low, _ in bands])
    held = [size for _, size in bands]
    # parts of 4 to 8 times the largest number of rows that a tree is asked for
    part_bits = [max(0, int(math.log2(max(1.0, size / most))) - 2) for size in held]
    # per band the rows that all trees together shall give; None: the root
    steps = [[trees * e for e in (least << i for i in range(32)) if e <= most and trees * e < 2 * size] + [None] for size in held]
    seeded = planes(dim, trees, seed)

    def band_of(square: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(lows, -_octave(square)), len(lows) - 1)

    # tree t of band b has the number b * trees + t
    def hashed(kind: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                v = _matrix(batch.column(1)) - centre
                h = hashes(v, seeded)
                band = band_of((v * v).sum(axis=1))
                for b in range(len(bands)):
                    mine = np.nonzero(band == b)[0] if kind == "rows" else np.arange(len(v))
                    for t in range(trees if len(steps[b]) > 1 else 0):
                        mh = h[mine, t]
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(mine)), pa.array([b * trees + t] * len(mine), pa.int32()),
                             pa.array(mh.view(np.int64)), pa.array(_prefix(mh, part_bits[b]).view(np.int64))],
                            ["id", "tree", "h", "part"])
        return run

    slim = "id long, tree int, h long, part long"
    row_hash = classes.select("cid", "v").mapInArrow(hashed("rows"), slim)
    query_hash = distinct.select("qid", "v").mapInArrow(hashed("queries"), slim)
    parts = materialise(row_hash.groupBy("tree", "part").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks")), "forest-parts")
    row_hash = row_hash.join(parts, ["tree", "part"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    visits = query_hash.join(parts, ["tree", "part"]).select("id", "tree", "h", "part", every_block)

    def counts(left: pa.Table, right: pa.Table) -> pa.Table:
        rows_h = np.sort(left["h"].to_numpy().view(np.uint64))
        h = right["h"].to_numpy().view(np.uint64)
        found = np.zeros((len(h), LEVELS + 1), np.int64)
        band = left["tree"][0].as_py() // trees if len(left) else 0
        for level in range(LEVELS + 1):
            bits = min(64, part_bits[band] + level)
            mine, theirs = _prefix(h, bits), _prefix(rows_h, bits)
            found[:, level] = np.searchsorted(theirs, mine, "right") - np.searchsorted(theirs, mine, "left")
        flat = pa.array(found.ravel())
        return pa.table({"id": right["id"], "band": pa.array([band] * len(h), pa.int32()), "found": pa.ListArray.from_arrays(
            pa.array(np.arange(len(h) + 1, dtype=np.int32) * (LEVELS + 1)), flat)})

    where = ["tree", "part", "block"]
    found = row_hash.select(*where, "h").groupBy(*where).cogroup(visits.select(*where, "id", "h").groupBy(*where)) \
        .applyInArrow(counts, "id long, band int, found array<long>")
    sums = materialise(found.groupBy("id", "band").agg(F.array(*[F.sum(F.get("found", F.lit(i))) for i in range(LEVELS + 1)]).alias("s")),
                       "prefix-counts")
    enough = _measured(classes, distinct, sums, k, steps, held, part_bits, trees, lambda v: hashes(v, seeded), band_of, centre)
    # one row per band, at most BANDS
    wanted = spark.createDataFrame([(b, enough[b], held[b], part_bits[b], -(-held[b] // block)) for b in range(len(bands))],
                                   "band int, enough long, held long, part_bits int, root_blocks long")
    # the longest prefix under which all trees together give enough; -1: the
    # root, also where the trees would compare more than twice the band's rows
    level = F.size(F.filter("s", lambda x: x >= F.col("enough"))) - 1
    level = F.when(F.col("enough").isNull() | F.col("s").isNull() | (F.get("s", level) >= 2 * F.col("held")), -1).otherwise(level)
    levels = distinct.crossJoin(F.broadcast(wanted)) \
        .join(sums.select(F.col("id").alias("qid"), "band", "s"), ["qid", "band"], "left") \
        .withColumn("level", level).withColumn("compared", F.when(F.col("level") < 0, F.col("held")).otherwise(F.get("s", F.col("level"))))
    levels = materialise(levels.select("qid", "v", "band", "part_bits", "root_blocks", "level", "compared"), "query-levels")
    if report is not None:
        seen = levels.agg(F.sum("compared"), F.countDistinct("qid"), F.avg((F.col("level") < 0).cast("int"))).collect()[0]
        report.append({"length": dim, "rows": n, "queries": seen[1], "compared": (seen[0] or 0) / max(1, seen[1]), "root": seen[2] or 0.0})
    near = visits.withColumn("band", F.floor(F.col("tree") / trees).cast("int")) \
        .join(levels.filter("level >= 0").withColumnRenamed("qid", "id"), ["id", "band"]) \
        .select(*where, F.col("id").alias("qid"), "h", "v", (F.col("level") + F.col("part_bits")).alias("bits"))
    # a band's root has the number -1 - band
    root = levels.filter("level < 0").select(
        (-1 - F.col("band")).alias("tree"), F.lit(0).cast("long").alias("part"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("root_blocks") - 1)).alias("block"), "qid",
        F.lit(0).cast("long").alias("h"), "v", F.lit(0).alias("bits"))

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                band = band_of(((_matrix(batch.column(1)) - centre) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(band.astype(np.int32))], ["cid", "v", "band"])

    whole = classes.select("cid", "v").mapInArrow(rooted, "cid long, v array<double>, band int") \
        .join(F.broadcast(wanted), "band").join(F.broadcast(levels.filter("level < 0").select("band").distinct()), "band", "left_semi") \
        .select((-1 - F.col("band")).alias("tree"), F.lit(0).cast("long").alias("part"),
                F.pmod(F.xxhash64("cid"), F.col("root_blocks")).alias("block"), "cid", F.lit(0).cast("long").alias("h"), "v")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"qid": pa.array([], pa.int64()), "cid": pa.array([], pa.int64()),
                             "score": pa.array([], pa.float64()), "own": pa.array([], pa.bool_())})
        rows_h = left["h"].to_numpy().view(np.uint64)
        order = np.argsort(rows_h, kind="stable")
        rows_h, cid, v = rows_h[order], left["cid"].to_numpy()[order], _matrix(left["v"])[order]
        qid, q, bits = right["qid"].to_numpy(), _matrix(right["v"]), right["bits"].to_numpy()
        h = right["h"].to_numpy().view(np.uint64)
        got: list[tuple] = []
        prefix = np.array([int(x) >> (64 - int(b)) if b else 0 for x, b in zip(h, bits)], np.uint64)
        for b in np.unique(bits):
            theirs = _prefix(rows_h, int(b))
            of_b = np.nonzero(bits == b)[0]
            for p in np.unique(prefix[of_b]):
                mine = of_b[prefix[of_b] == p]
                lo, hi = np.searchsorted(theirs, p, "left"), np.searchsorted(theirs, p, "right")
                if lo == hi:
                    continue
                for at in range(0, len(mine), 512):
                    some = mine[at:at + 512]
                    dots = q[some] @ v[lo:hi].T
                    if hi - lo > k + 1:
                        edge = np.partition(dots, hi - lo - k - 1, axis=1)[:, hi - lo - k - 1]
                    else:
                        edge = np.full(len(some), -np.inf)
                    for i, row in enumerate(some):
                        # ties at the edge all stay until the scores are exact
                        c = np.nonzero(dots[i] >= edge[i] - 1e-9 * (1 + abs(edge[i])))[0] + lo if np.isfinite(edge[i]) else np.arange(lo, hi)
                        s = (v[c] * q[row]).sum(axis=1)
                        best = np.lexsort((cid[c], -s))[:k + 1]
                        got.append((np.full(len(best), qid[row]), cid[c][best], s[best], (v[c[best]] == q[row]).all(axis=1)))
        if not got:
            return compare(left.slice(0, 0), right)
        return pa.table(dict(zip(("qid", "cid", "score", "own"), map(np.concatenate, zip(*got)))))

    visited = [b * trees + t for b in range(len(bands)) if enough[b] is not None for t in range(trees)]
    forest = row_hash.filter(F.col("tree").isin(visited)).join(classes.select("cid", "v"), F.col("id") == F.col("cid")).select(*where, "cid", "h", "v")
    pairs = forest.unionByName(whole).groupBy(*where).cogroup(near.unionByName(root).groupBy(*where)) \
        .applyInArrow(compare, "qid long, cid long, score double, own boolean")
    nearest = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    best = pairs.groupBy("qid", "cid").agg(F.max("score").alias("score"), F.max("own").alias("own")) \
        .withColumn("r", F.row_number().over(nearest)).filter(F.col("r") <= k + 1)
    members = best.join(classes.select("cid", "ids"), "cid").select("qid", "score", "own", F.explode("ids").alias("vec_id")) \
        .withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id", "own"))).filter(F.col("r") <= k + 1)
    asked = queries.join(distinct, "v").select(F.col("vec_id").alias("query_id"), "qid")
    return asked.join(members, "qid").filter("NOT own OR vec_id <> query_id") \
        .withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "qid").orderBy(F.desc("score"), "vec_id"))) \
        .filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(embeddings: DataFrame, every: int = 20, k: int = 20, **kw) -> DataFrame:
    """Neighbours of the rows whose id is divisible by ``every``, among all rows."""
    rows = materialise(clean(embeddings), "vectors")
    return search(rows, rows.filter(F.col("vec_id") % every == 0), k, **kw)
