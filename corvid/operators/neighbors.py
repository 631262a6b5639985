"""Nearest neighbours (C2), SMOTE (F10) and the k-nearest vote.

Exact k-NN (``knn_exact``) is a blocked search: queries and candidates are
hashed into blocks of at most ``block_rows`` rows (default: BLOCK_BYTES of
vector); every (query block, candidate block) pair is one ``applyInPandas`` group
(bounded size whatever the data).  Inside, both sides are cut into tiles of near
rows.  A tile of queries skips tiles of candidates that lie farther off than the
k-th neighbour found so far of each of its queries; of the others, a matrix
product finds the few pairs that may matter, and only these are measured
exactly.  Per query, the partial results are merged by a window whose partition
holds at most nb x k rows.  A row is copied once per block of the other side.
Vectors with structure or few dimensions skip most tiles; without structure
(the driver's embeddings are random unit vectors: 5-NN label agreement is at
chance level) an exact answer needs all n_q x n_c pairs.

Many rows of few numbers (CELL_DIMS) are searched by cells instead: a k-d tree of a
bounded sample cuts the space into cells of about CELL_ROWS candidates.  A query's own
cell gives a distance within which its k neighbours lie, and it is sent only to cells
whose rows' box is as near as that.  Cells with more rows than that (copies) are dealt to
several groups.

Approximate k-NN (``knn_lsh``) hashes by random hyperplanes (several tables)
and runs the same block search inside every (table, bucket): all pairs of a
bucket's query blocks and candidate blocks, so no neighbour of the bucket is
lost however small the blocks are.

Ties are broken by candidate id everywhere, so results are deterministic.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from corvid.functions.hashing import md5_number, md5_unit, seeded_md5
from corvid.operators.ranking import class_rank

BLOCK_ROWS = 2048      # of the approximate search
BLOCK_BYTES = 32 << 20  # vectors of a block of the exact search
_Q_CHUNK = 64          # 64 x 2048 x 64 doubles = 67 MB per distance chunk
_Q_TILE, _C_TILE = 64, 64
_FIRST_ROWS, _NEXT_ROWS = 512, 1024     # candidates that a tile of queries is compared with at once
CELL_ROWS = 1 << 17    # candidates of a cell
CELL_DIMS = 12
CELL_SAMPLE = 1 << 16  # candidates that the cells are cut by
CELL_QUERIES = 1 << 22  # queries that can come to a cell at most, and to a group


def _vec(features: list[str] | str):
    if isinstance(features, str):      # an array column (e.g. embeddings)
        return F.transform(F.col(features), lambda x: x.cast("double"))
    return F.array(*[F.col(c).cast("double") for c in features])


def _id_type(df: DataFrame, id_col: str) -> str:
    """Whole numbers stay numbers (long); any other id is compared as text."""
    return "long" if isinstance(df.schema[id_col].dataType, IntegralType) else "string"


def _ids(rows: pd.DataFrame) -> np.ndarray:
    ids = rows["_id"].to_numpy()
    return ids.astype(str) if ids.dtype == object else ids


def _tiles(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows in tiles of at most ``size`` near rows: halves along the widest side."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        part = x[rows]
        order = np.argpartition(part[:, np.ptp(part, axis=0).argmax()], len(rows) // 2)
        todo += [rows[order[len(rows) // 2:]], rows[order[:len(rows) // 2]]]
    return out


def _tiled_topk(Q: np.ndarray, qid: np.ndarray, C: np.ndarray, cid: np.ndarray, k: int, exclude_self: bool,
                within: np.ndarray | None = None):
    """(query row, candidate row, distance) of each query's k nearest by (distance, id),
    of those not farther than ``within``; all components finite."""
    dim = Q.shape[1]
    Q0, C0 = Q, C
    mid = C.mean(axis=0)
    Q, C = Q - mid, C - mid                    # for the products only
    q2, c2 = (Q * Q).sum(axis=1), (C * C).sum(axis=1)
    # what rounding can add to a squared distance from products, and to the shift by mid
    far = np.abs(mid).max() + np.sqrt(max(q2.max(), c2.max()))
    slack = 64 * (dim + 8) * np.finfo(float).eps * (dim * far * far + 1e-300)
    tiles = _tiles(C, _C_TILE)
    order = np.concatenate(tiles)              # from here on a tile is a slice
    ends = np.cumsum([len(t) for t in tiles])
    C, C0, cid = C[order], C0[order], cid[order]
    start = ends - [len(t) for t in tiles]
    low, high = (np.ascontiguousarray(f.reduceat(C, start, axis=0).T) for f in (np.minimum, np.maximum))
    product = np.column_stack([-2.0 * C, c2[order]])        # times (q, 1): squared distance less that of q
    out = []
    for rows in _tiles(Q, _Q_TILE):
        q = np.column_stack([Q[rows], np.ones(len(rows))])
        own = q2[rows]
        gap = np.maximum(0.0, np.maximum(low - Q[rows].max(axis=0)[:, None], Q[rows].min(axis=0)[:, None] - high))
        away = (gap * gap).sum(axis=0)
        # squared distance of the k-th so far
        bound = np.full(len(rows), np.inf) if within is None else within[rows] ** 2 * (1 + 1e-12)
        widest = bound.max()
        bi, bc, bd = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        near_first, at = np.argsort(away, kind="stable"), 0
        reach, sizes = away[near_first] * (1 - 1e-9) - slack, ends - start
        upto = np.cumsum(sizes[near_first])
        while at < len(reach) and reach[at] <= widest:
            until = min(int(np.searchsorted(reach, widest, "right")),
                        int(np.searchsorted(upto, (upto[at - 1] if at else 0) + (_NEXT_ROWS if at else _FIRST_ROWS))) + 1)
            some, at = near_first[at:until], until
            n = sizes[some]
            j = np.arange(n.sum()) + np.repeat(start[some] - (np.cumsum(n) - n), n)
            near, limit = q @ np.take(product, j, axis=0).T, bound + (slack - own)
            if widest == np.inf:
                if exclude_self:
                    near[qid[rows][:, None] == cid[j][None, :]] = np.inf
                if len(j) >= k:
                    limit = np.minimum(limit, np.partition(near, k - 1, axis=1)[:, k - 1] + 2 * slack)
            i, found = np.divmod(np.flatnonzero(near <= limit[:, None]), len(j))
            j = j[found]
            if exclude_self:
                other = qid[rows[i]] != cid[j]
                i, j = i[other], j[other]
            if not len(i):
                continue
            d = np.sqrt(((Q0[rows[i]] - C0[j]) ** 2).sum(axis=1))
            bi, bc, bd = np.concatenate([bi, i]), np.concatenate([bc, j]), np.concatenate([bd, d])
            by = np.lexsort((cid[bc], bd, bi))
            bi, bc, bd = bi[by], bc[by], bd[by]
            place = np.arange(len(bi)) - np.searchsorted(bi, bi)
            keep = place < k
            bi, bc, bd, place = bi[keep], bc[keep], bd[keep], place[keep]
            last = place == k - 1
            bound[bi[last]] = np.minimum(bound[bi[last]], bd[last] ** 2 * (1 + 1e-12))
            widest = bound.max()
        out.append((rows[bi], order[bc], bd))
    return [np.concatenate(x) for x in zip(*out)]


def _block_topk(k: int, exclude_self: bool, text_ids: bool = False):
    id_dtype = "object" if text_ids else "int64"

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        q = pdf[pdf["_role"] == 0]
        c = pdf[pdf["_role"] == 1]
        cols = {"_g": [], "qid": [], "nid": [], "dist": []}
        if len(q) and len(c):
            g = pdf["_g"].iloc[0]
            C = np.stack(c["_v"].to_numpy()).astype(np.float64)
            cid = _ids(c)
            kk = min(k, len(c))
            Q = np.stack(q["_v"].to_numpy()).astype(np.float64)
            # beyond that, squares overflow or rounding counts; missing components compare as ever
            if C.shape[1] and max(np.abs(Q).max(), np.abs(C).max()) < 1e100:
                qid = _ids(q)
                i, j, d = _tiled_topk(Q, qid, C, cid, kk, exclude_self)
                return pd.DataFrame({"_g": pd.Series([g] * len(i), dtype="object"), "qid": pd.Series(qid[i].tolist(), dtype=id_dtype),
                                     "nid": pd.Series(cid[j].tolist(), dtype=id_dtype), "dist": pd.Series(d, dtype="float64")})
            for s in range(0, len(q), _Q_CHUNK):
                qs = q.iloc[s:s + _Q_CHUNK]
                # so many candidates at once as one chunk of distances holds: any number of blocks' rows
                d = np.concatenate([np.sqrt(((Q[s:s + _Q_CHUNK, None, :] - C[None, e:e + 2048, :]) ** 2).sum(axis=2))
                                    for e in range(0, len(C), 2048)], axis=1)
                qid = _ids(qs)
                if exclude_self:
                    d[qid[:, None] == cid[None, :]] = np.inf
                for i in range(len(qs)):
                    row = d[i]
                    # k smallest by (distance, id); partition first, then exact order
                    cand = np.argpartition(row, kk - 1)[:kk] if kk < len(row) else np.arange(len(row))
                    edge = row[cand].max()
                    cand = np.nonzero(row <= edge)[0]
                    order = np.lexsort((cid[cand], row[cand]))[:kk]
                    sel = cand[order]
                    sel = sel[np.isfinite(row[sel])]
                    cols["_g"] += [g] * len(sel)
                    cols["qid"] += [qid[i].item()] * len(sel)
                    cols["nid"] += cid[sel].tolist()
                    cols["dist"] += row[sel].tolist()
        return pd.DataFrame({"_g": pd.Series(cols["_g"], dtype="object"),
                             "qid": pd.Series(cols["qid"], dtype=id_dtype),
                             "nid": pd.Series(cols["nid"], dtype=id_dtype),
                             "dist": pd.Series(cols["dist"], dtype="float64")})
    return fn


def _merge_topk(parts: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("_g", "qid").orderBy("dist", "nid")
    return (parts.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k))


def _blocks(n: int, block_rows: int) -> int:
    return max(1, int(math.ceil(n / float(block_rows))))


# --- cells -----------------------------------------------------------------------------------------
def _cut(sample: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """A k-d tree over a sample, by heap place: the axis and the largest number on the left of each node."""
    axis, cut, parts = np.zeros(cells, int), np.zeros(cells), {1: sample}
    for node in range(1, cells):
        x = parts.pop(node)
        if len(x):
            axis[node] = j = int(np.ptp(x, axis=0).argmax())
            cut[node] = np.partition(x[:, j], (len(x) - 1) // 2)[(len(x) - 1) // 2]
        right = x[:, axis[node]] > cut[node]
        parts[2 * node], parts[2 * node + 1] = x[~right], x[right]
    return axis, cut


def _cell(x: np.ndarray, axis: np.ndarray, cut: np.ndarray) -> np.ndarray:
    node, rows = np.ones(len(x), int), np.arange(len(x))
    for _ in range(len(axis).bit_length() - 1):
        node = 2 * node + (x[rows, axis[node]] > cut[node])
    return node - len(axis)


def _reached(Q: np.ndarray, bound: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, cell) for all cells whose box is not farther than a query's bound."""
    out = []
    for rows in _tiles(Q, _Q_TILE):
        q, far = Q[rows], bound[rows]
        gap = np.maximum(0.0, np.maximum(low - q.max(axis=0), q.min(axis=0) - high))
        cells = np.flatnonzero(np.sqrt((gap * gap).sum(axis=1)) * (1 - 1e-9) <= far.max())
        gap = np.maximum(0.0, np.maximum(low[cells] - q[:, None, :], q[:, None, :] - high[cells]))
        i, j = np.nonzero(np.sqrt((gap * gap).sum(axis=2)) * (1 - 1e-9) <= far[:, None])
        out.append((rows[i], cells[j]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _by_cells(q: DataFrame, c: DataFrame, dims: int, k: int, exclude_self: bool, kind: str, nq: int, nc: int) -> DataFrame:
    """(qid, nid, dist) with each query's k nearest among them, from rows (_id, _x0, ...) of finite numbers."""
    xs = [f"_x{i}" for i in range(dims)]
    # cells enough for all tasks that run at once, and partitions enough that few get several
    cells = 1 << max(1, math.ceil(math.log2(max(nc / CELL_ROWS, 4 * q.sparkSession.sparkContext.defaultParallelism))))
    q, c = (d.select("_id", *xs, F.xxhash64("_id").alias("_h")) for d in (q, c))
    some = c.where(F.pmod(F.col("_h"), F.lit(max(1, nc // CELL_SAMPLE))) == 0).select(*xs).limit(4 * CELL_SAMPLE).collect()
    axis, cut = _cut(np.array([tuple(r) for r in some]).reshape(-1, dims), cells)

    def numbers(b) -> np.ndarray:
        return np.stack([b[x].to_numpy(zero_copy_only=False) if isinstance(b, pa.RecordBatch) else b[x].to_numpy() for x in xs], axis=1)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("_cell", pa.array(_cell(numbers(b), axis, cut).astype(np.int32)))
    named = f"_id {kind}, " + ", ".join(f"{x} double" for x in xs) + ", _h long, _cell int"
    q, c = q.mapInArrow(placed, named), c.mapInArrow(placed, named)
    boxes = c.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), *[f(x).alias(f"{f.__name__}{x}") for x in xs for f in (F.min, F.max)]).collect()
    counts, low, high = np.zeros(cells, int), np.full((cells, dims), np.inf), np.full((cells, dims), np.inf)     # no rows: out of reach
    for r in boxes:
        counts[r["_cell"]] = r["n"]
        low[r["_cell"]], high[r["_cell"]] = [r[f"min{x}"] for x in xs], [r[f"max{x}"] for x in xs]
    asked = np.zeros(cells, int)
    for r in q.groupBy("_cell").count().collect():
        asked[r["_cell"]] = r["count"]
    parts = np.maximum(1, -(-counts // (2 * CELL_ROWS)))       # groups that a cell's candidates are dealt to
    own = np.maximum(1, -(-asked // (2 * CELL_ROWS)))          # and its own queries, first
    most = -(-nq // CELL_QUERIES)                              # and all queries that may come to it

    def rows_of(b, cell, sub, part, role, at, bound=None) -> pa.RecordBatch:
        cols = [pa.array(np.asarray(x, np.int32)) for x in (cell, sub, part, np.full(len(at), role))]
        bound = np.full(len(at), np.inf) if bound is None else bound
        return pa.RecordBatch.from_arrays([*cols, b["_id"].take(pa.array(at)), *[b[x].take(pa.array(at)) for x in xs], pa.array(bound)], names)
    names = ["_cell", "_sub", "_part", "_role", "_id", *xs, "_far"]
    schema = f"_cell int, _sub int, _part int, _role int, _id {kind}, " + ", ".join(f"{x} double" for x in xs) + ", _far double"

    def dealt(copies: np.ndarray | None, role: int, first: bool):
        """Rows of a cell to one of its groups, or to all of them (``copies``)."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell, h = b["_cell"].to_numpy(), b["_h"].to_numpy()
                if role == 0:
                    yield rows_of(b, cell, np.mod(h, own[cell]), np.zeros(len(cell), int), 0, np.arange(len(cell)))
                    continue
                part = np.mod(h, parts[cell])
                at = np.flatnonzero(part == 0) if first else np.arange(len(cell))
                at = np.repeat(at, copies[cell[at]])
                sub = np.arange(len(at)) - np.searchsorted(at, at)
                yield rows_of(b, cell[at], sub, part[at], 1, at)
        return run

    def sides(group: pa.Table) -> tuple:
        role = group["_role"].to_numpy()
        return tuple((group["_id"].to_numpy()[role == r], numbers(group)[role == r]) for r in (0, 1))

    def ids_of(ids: np.ndarray) -> pa.Array:
        return pa.array(ids if kind == "long" else ids.tolist(), pa.int64() if kind == "long" else pa.string())

    def text(ids: np.ndarray) -> np.ndarray:
        return ids.astype(str) if ids.dtype == object else ids

    def bounded(group: pa.Table) -> pa.Table:
        """Every query of a cell, with the distance of the k-th nearest found, once for each group that it goes on to."""
        (qid, Q), (cid, C) = sides(group)
        far = np.full(len(qid), np.inf)
        if len(qid) and len(cid):
            i, _, d = _tiled_topk(Q, text(qid), C, text(cid), min(k, len(cid)), exclude_self)
            place = np.bincount(i, minlength=len(qid))
            np.maximum.at(reach := np.zeros(len(qid)), i, d)
            far = np.where(place >= k, reach, np.inf)
        i, cell = _reached(Q, far, low, high) if len(qid) else (np.zeros(0, int), np.zeros(0, int))
        keep = counts[cell] > 0
        i, cell = i[keep], cell[keep]
        times = parts[cell]
        i, cell = np.repeat(i, times), np.repeat(cell, times)
        part = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
        sub = np.mod(group["_h"].to_numpy()[group["_role"].to_numpy() == 0], most)[i]
        return pa.table([pa.array(np.asarray(x, np.int32)) for x in (cell, sub, part, np.zeros(len(i)))]
                        + [ids_of(qid[i]), *[pa.array(Q[i, n]) for n in range(dims)], pa.array(far[i])], names)

    def searched(group: pa.Table) -> pa.Table:
        (qid, Q), (cid, C) = sides(group)
        i, j, d = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        if len(qid) and len(cid):
            i, j, d = _tiled_topk(Q, text(qid), C, text(cid), min(k, len(cid)), exclude_self, group["_far"].to_numpy()[group["_role"].to_numpy() == 0])
        return pa.table({"_g": pa.array(np.full(len(i), "")), "qid": ids_of(qid[i]), "nid": ids_of(cid[j]), "dist": pa.array(d)})

    first = q.mapInArrow(dealt(None, 0, True), schema).unionByName(c.mapInArrow(dealt(own, 1, True), schema))
    on = first.withColumn("_h", F.xxhash64("_id")).repartition(2 * cells, "_cell", "_sub").groupBy("_cell", "_sub").applyInArrow(bounded, schema)
    then = on.unionByName(c.mapInArrow(dealt(np.full(cells, most), 1, False), schema))
    return then.repartition(2 * cells, "_cell", "_sub", "_part").groupBy("_cell", "_sub", "_part").applyInArrow(searched, f"_g string, qid {kind}, nid {kind}, dist double")


def knn_exact(queries: DataFrame, candidates: DataFrame, features, k: int = 5, id_col: str = "id",
              group_col: str | None = None, exclude_self: bool = True,
              block_rows: int | None = None) -> DataFrame:
    """Exact k nearest candidates (Euclidean) for every query, optionally
    only within the same ``group_col`` value.  Returns
    (group?, qid, nid, dist, rank)."""
    g = F.col(group_col).cast("string") if group_col else F.lit("")
    kind = _id_type(queries, id_col)
    q = queries.select(g.alias("_g"), F.col(id_col).cast(kind).alias("_id"), _vec(features).alias("_v"))
    c = candidates.select(g.alias("_g"), F.col(id_col).cast(kind).alias("_id"), _vec(features).alias("_v"))
    if block_rows is None and group_col is None and not isinstance(features, str) and 0 < len(features) <= CELL_DIMS:
        sound = [F.abs(F.col(f"_x{i}")) < 1e100 for i in range(len(features))]     # nor null, nor NaN
        q2, c2 = (d.select(F.col(id_col).cast(kind).alias("_id"), *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)])
                  for d in (queries, candidates))
        (nq, odd_q), (nc, odd_c) = (d.agg(F.count(F.lit(1)), F.count_if(~F.coalesce(reduce(and_, sound), F.lit(False)) | F.col("_id").isNull())).first()
                                    for d in (q2, c2))
        if nc > 2 * CELL_ROWS and nq and not odd_q and not odd_c:
            return _merge_topk(_by_cells(q2, c2, len(features), k, exclude_self, kind, nq, nc), k).drop("_g")
    # block counts per group: one small aggregate (bounded by the group list)
    nq = {r[0]: r[1] for r in q.groupBy("_g").count().collect()}
    nc = {r[0]: r[1] for r in c.groupBy("_g").count().collect()}

    if block_rows is None:
        first = c.select(F.size("_v")).first() if isinstance(features, str) else [len(features)]
        block_rows = max(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, first[0] if first else 1)))
    # fewer pairs of blocks than tasks that run at once: more blocks of queries, of 256 rows at least
    pairs = sum(_blocks(n, block_rows) * _blocks(nc.get(g_, 0), block_rows) for g_, n in nq.items())
    more = -(-3 * queries.sparkSession.sparkContext.defaultParallelism // max(1, pairs))
    blocks = {id(nc): {g_: _blocks(n, block_rows) for g_, n in nc.items()},
              id(nq): {g_: max(_blocks(n, block_rows), min(_blocks(n, block_rows) * more, n // 256)) for g_, n in nq.items()}}

    def nb_col(counts):
        expr = F.lit(1)
        for key_, n in blocks[id(counts)].items():
            expr = F.when(F.col("_g") == key_, F.lit(n)).otherwise(expr)
        return expr
    h = lambda: F.pmod(F.xxhash64("_id"), F.lit(1 << 30))
    q = q.withColumn("_qb", h() % nb_col(nq)).withColumn("_nbc", nb_col(nc))
    c = c.withColumn("_cb", h() % nb_col(nc)).withColumn("_nbq", nb_col(nq))
    qx = q.select("_g", "_id", "_v", "_qb", F.explode(F.sequence(F.lit(0), F.col("_nbc") - 1)).alias("_cb"),
                  F.lit(0).alias("_role"))
    cx = c.select("_g", "_id", "_v", F.explode(F.sequence(F.lit(0), F.col("_nbq") - 1)).alias("_qb"), "_cb",
                  F.lit(1).alias("_role"))
    both = qx.unionByName(cx)
    parts = both.groupBy("_g", "_qb", "_cb").applyInPandas(
        _block_topk(k, exclude_self, kind == "string"), f"_g string, qid {kind}, nid {kind}, dist double")
    out = _merge_topk(parts, k)
    if group_col:
        return out.withColumnRenamed("_g", group_col)
    return out.drop("_g")


def lsh_planes(dim: int, n_tables: int = 4, n_bits: int = 6, seed: int = 42) -> np.ndarray:
    """Normals of the random hyperplanes, (table, bit, dimension)."""
    return np.random.default_rng(seed).standard_normal((n_tables, n_bits, dim))


def knn_lsh(df: DataFrame, features, k: int = 5, id_col: str = "id", n_tables: int = 4, n_bits: int = 6,
            seed: int = 42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Approximate self k-NN: candidates are all rows sharing a
    random-hyperplane bucket in at least one of ``n_tables`` tables.  A bucket
    larger than ``block_rows`` is searched block against block, so groups are
    bounded and the result does not depend on ``block_rows``.  ``n_bits`` sets
    the bucket size: about log2(rows / rows wanted per bucket)."""
    kind = _id_type(df, id_col)
    base = df.select(F.col(id_col).cast(kind).alias("id"), _vec(features).alias("_v"))
    dim = len(base.select("_v").first()[0])
    planes = lsh_planes(dim, n_tables, n_bits, seed)
    tables = []
    for t in range(n_tables):
        code = F.lit(0)
        for b in range(n_bits):
            dot = F.aggregate(F.zip_with(F.col("_v"), F.array(*[F.lit(float(x)) for x in planes[t, b]]),
                                         lambda a, w: a * w), F.lit(0.0), lambda acc, x: acc + x)
            code = code + F.when(dot >= 0, F.lit(1 << b)).otherwise(F.lit(0))
        tables.append(base.withColumn("_bucket", F.concat(F.lit(f"{t}:"), code.cast("string"))))
    hashed = tables[0]
    for t in tables[1:]:
        hashed = hashed.unionByName(t)
    sizes = hashed.groupBy("_bucket").count()
    hashed = (hashed.join(F.broadcast(sizes), "_bucket")       # one row per bucket: bounded by 2^bits x tables
              .withColumn("_nb", F.ceil(F.col("count") / block_rows).cast("long"))
              .withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_nb")))
              .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nb") - 1))))

    def grp(qb, cb):
        return F.concat_ws("/", "_bucket", F.col(qb).cast("string"), F.col(cb).cast("string")).alias("_g")
    q = hashed.select(grp("_own", "_other"), F.col("id").alias("_id"), "_v", F.lit(0).alias("_role"))
    c = hashed.select(grp("_other", "_own"), F.col("id").alias("_id"), "_v", F.lit(1).alias("_role"))
    parts = q.unionByName(c).groupBy("_g").applyInPandas(
        _block_topk(k, True, kind == "string"), f"_g string, qid {kind}, nid {kind}, dist double")
    dedup = parts.select("qid", "nid", "dist").dropDuplicates(["qid", "nid"]).withColumn("_g", F.lit(""))
    return _merge_topk(dedup, k).drop("_g")


def knn_classify(train: DataFrame, test: DataFrame, features, k: int = 5, id_col: str = "id",
                 label: str = "label", block_rows: int | None = None) -> DataFrame:
    """Majority class of the k nearest training rows (ties to the
    smaller class); the positive share is the mean neighbour label."""
    nn = knn_exact(test, train, features, k, id_col, None, False, block_rows)
    lab = train.select(F.col(id_col).cast(_id_type(train, id_col)).alias("nid"), F.col(label).alias("_lab"))
    votes = nn.join(lab, "nid").groupBy("qid", "_lab").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("qid").orderBy(F.desc("n"), "_lab")        # at most k rows per query
    best = votes.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
    return best.select(F.col("qid").alias(id_col), F.col("_lab").alias("prediction"),
                       (F.col("n") / F.lit(float(k))).alias("share"))


def smote(df: DataFrame, features: list[str], label: str = "label", id_col: str = "id", k: int = 5,
          seed=42, block_rows: int | None = None, return_synthetic_only: bool = False,
          neighbours: str = "exact", scales: dict | None = None) -> DataFrame:
    """grow the minority class to the majority size with points
    x + u * (neighbour - x), the neighbour one of x's k nearest minority rows.

    Draw j (1..D) takes base rank md5(seed|b|j) mod m + 1, neighbour rank
    md5(seed|n|j) mod k + 1 and u = md5(seed|u|j) / 2^32.  Draw numbers are
    generated by the minority rows themselves (no task makes all draws) and
    resolved by equi-joins on unique keys.  ``scales`` ({feature: (mean,
    deviation)}) standardizes the features for the neighbour search only; the
    points are made from the rows as they are.  Features must not be null."""
    from corvid.operators.prep import apply_scale
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}   # one row per class
    if len(counts) != 2:
        raise ValueError(f"SMOTE needs exactly two classes in {label!r}, found {len(counts)}")
    minority = min(counts, key=lambda c: (counts[c], c))
    m, big = counts[minority], max(counts.values())
    need = big - m
    if need <= 0 or m < 2:
        return df
    kk = min(k, m - 1)
    kind = _id_type(df, id_col)
    mino = df.where(F.col(label) == minority)
    ranked = class_rank(mino.withColumn("_k", seeded_md5(seed, id_col)), label, "_k", id_col, "_r").drop("_k")
    # the first rows make all draws where these are fewer than the rows
    draws = (ranked.where(F.col("_r") <= need)
             .select(F.explode(F.sequence(F.col("_r"), F.greatest(F.col("_r"), F.lit(need).cast("long")), F.lit(m).cast("long")))
                     .alias("draw"))
             .withColumn("_base_r", md5_number(seeded_md5(seed, F.lit("b"), "draw")) % m + 1)
             .withColumn("_nh", md5_number(seeded_md5(seed, F.lit("n"), "draw")))
             .withColumn("_u", md5_unit(seeded_md5(seed, F.lit("u"), "draw"))))
    # exact search is O(m^2) distance work inside the minority class; for a
    # very large minority the LSH search (bounded candidate groups) is offered
    space = mino if scales is None else apply_scale(mino, scales)
    drawn = space.join(ranked.join(draws.select(F.col("_base_r").alias("_r")).distinct(), "_r").select(id_col).distinct(),
                       id_col, "left_semi")             # others need no neighbours
    nn = (knn_exact(drawn, space, features, kk, id_col, None, True, block_rows) if neighbours == "exact"
          else knn_lsh(space, features, kk, id_col, block_rows=block_rows or BLOCK_ROWS))
    base = ranked.select(F.col("_r").alias("_base_r"), F.col(id_col).cast(kind).alias("base_id"),
                         *[F.col(c).cast("double").alias(f"_b_{c}") for c in features])
    nbr = mino.select(F.col(id_col).cast(kind).alias("nbr_id"),
                      *[F.col(c).cast("double").alias(f"_n_{c}") for c in features])
    # neighbour rank = md5 mod (neighbours found) + 1; the exact search always
    # finds kk, an approximate one may find fewer (none: the base itself)
    found = nn.groupBy(F.col("qid").alias("base_id")).agg(F.count(F.lit(1)).alias("_nn"))
    syn = (draws.join(base, "_base_r")
           .join(found, "base_id", "left")
           .withColumn("_nrank", F.when(F.col("_nn") > 0, F.col("_nh") % F.col("_nn") + 1))
           .join(nn.select(F.col("qid").alias("base_id"), F.col("rank").alias("_nrank"),
                           F.col("nid").alias("nbr_id")), ["base_id", "_nrank"], "left")
           .withColumn("nbr_id", F.coalesce("nbr_id", "base_id"))
           .join(nbr, "nbr_id"))
    syn = syn.select("draw", "base_id", "nbr_id",
                     *[(F.col(f"_b_{c}") + F.col("_u") * (F.col(f"_n_{c}") - F.col(f"_b_{c}"))).alias(c)
                       for c in features],
                     F.lit(minority).cast(df.schema[label].dataType).alias(label))
    if return_synthetic_only:
        return syn
    synth_rows = syn.select((-F.col("draw")).cast(df.schema[id_col].dataType).alias(id_col),
                            *features, label)
    return df.select(id_col, *features, label).unionByName(synth_rows)
