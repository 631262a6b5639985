"""Random forests on packed bins (J1, J12, J13): rows are dealt to trees, not passes
to levels.

Features are filled and cut once into bins (32, as in ``pyspark.ml``); rows lie packed
in blocks.  How often a tree draws a row follows from a hash of the row and the tree,
the features that a node may split by from a hash of the node, so a forest does not
depend on how rows are laid out.  While a node has more than LOCAL rows (or the trees
are at most SHALLOW levels deep), a level of all trees is one Spark aggregate of class
counts per (node, feature, bin).  Then every block sends its rows to the groups (tree,
node), and a group, of at most about LOCAL rows, grows the rest of its subtree in memory.

Splits have the largest gain in weighted Gini impurity.  The trees stay in a parquet
folder of the shared storage: the driver sees their upper levels and the sums of gain.
Scoring reads them one after another beside its rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.operators.boosting import _clean, _edges, binned
from corvid.session import scratch_dir

LOCAL = 1 << 20            # rows of a group that grows a subtree
SHALLOW = 6                # levels that are always grown by aggregates
BLOCK = 1 << 16            # rows of a block
CHUNK = 1 << 14            # rows that are worked on at once, so that they stay in the processor's cache
GROUP = 1 << 16            # rows of nodes that are grown together
FEW_ROWS = 32              # rows of a node below which they are sorted instead of counted in all bins
ONES = 1 << 26             # a count of draws and, times this, of those of class 1 in one number
PARTS = float(1 << 40)     # whole parts of a leaf's share
PACKED = "bins binary, y binary, mark binary"
NODES = "tree int, part int, feature binary, cut binary, down binary, value binary"
KINDS = {"feature": np.int16, "cut": np.uint8, "down": np.int32, "value": np.float64}


@dataclass
class Params:
    trees: int = 100
    depth: int = 5
    min_rows: int = 1
    subset: str = "auto"
    bootstrap: bool = True
    bins: int = 32
    seed: int = 42

    def columns(self, n: int) -> int:
        """How many of ``n`` features a node may split by, as ``pyspark.ml`` counts."""
        if self.subset == "all" or (self.subset == "auto" and self.trees == 1):
            return n
        share = {"auto": n ** 0.5, "sqrt": n ** 0.5, "onethird": n / 3.0, "log2": np.log2(max(n, 2))}
        k = share[self.subset] if self.subset in share else float(self.subset) * n if "." in self.subset else int(self.subset)
        return int(min(n, max(1, np.ceil(k))))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well mixed bits of 64 bits."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 16)]))
# by the first 16 bits of 53: the draws, or 255 where the others decide
_FIRST = np.array([np.searchsorted(_POISSON, x, "right") for x in (np.arange(1 << 16) / (1 << 16), (np.arange(1, 1 + (1 << 16)) * 2.0 ** 37 - 1) * 2.0 ** -53)])
_FIRST = np.where(_FIRST[0] == _FIRST[1], _FIRST[0], 255).astype(np.uint8)


def draws(mark: np.ndarray, tree: int, p: Params) -> np.ndarray:
    """How often a tree draws the rows with these hashes: Poisson of mean 1."""
    if not p.bootstrap:
        return np.ones(len(mark), np.uint8)
    own, out = _mixed(np.array([p.seed * 1_000_003 + tree]))[0], np.empty(len(mark), np.uint8)
    for lo in range(0, len(mark), CHUNK):
        u = _mixed(mark[lo:lo + CHUNK] ^ own)
        out[lo:lo + CHUNK] = w = _FIRST[u >> np.uint64(48)]
        rest = np.flatnonzero(w == 255)
        out[lo + rest] = np.searchsorted(_POISSON, (u[rest] >> np.uint64(11)) * 2.0 ** -53, "right")
    return out


def allowed(tree: int, heap: np.ndarray, n_features: int, p: Params) -> np.ndarray:
    """(nodes, columns) features that nodes (by their places in a binary heap) may split by."""
    k = p.columns(n_features)
    if k == n_features:
        return np.tile(np.arange(k), (len(heap), 1))
    base = _mixed(np.asarray(heap, np.int64).astype(np.uint64) ^ _mixed(np.array([p.seed * 7_000_003 + tree]))[0])
    keys = _mixed(base[:, None] + np.arange(n_features, dtype=np.uint64))
    return np.sort(np.argsort(keys, axis=1, kind="stable")[:, :k], axis=1)


def counts(bins: np.ndarray, y: np.ndarray, w: np.ndarray, at: np.ndarray, may: np.ndarray, n_bins: int) -> np.ndarray:
    """(node, column, bin, class) draws of the rows (rows, features) at nodes ``at``
    (-1: at none)."""
    some = np.flatnonzero((w > 0) & (at >= 0))
    held = _held(bins.reshape(-1), some * bins.shape[1], at[some], _both(y[some], w[some]), may, n_bins).transpose(2, 0, 1)
    ones = np.floor(held / ONES)
    return np.stack([held - ones * (ONES + 1), ones], axis=3)


def _both(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Draws of rows and, times ONES, those of class 1."""
    return np.where(y > 0, float(ONES + 1), 1.0) * w


def _at(x: np.ndarray, places: np.ndarray) -> np.ndarray:
    """``x[places]``, faster where all places are there."""
    return np.take(x, places, mode="clip")


def _held(flat: np.ndarray, row: np.ndarray, at: np.ndarray, v: np.ndarray, may: np.ndarray, n_bins: int) -> np.ndarray:
    """(column, bin, node) sums of ``v`` of rows that begin at places ``row`` of ``flat``."""
    n, k = may.shape
    out, columns = np.zeros((k, n_bins, n)), np.ascontiguousarray(may.T)
    for lo in range(0, len(at), CHUNK):
        here, begin, x = at[lo:lo + CHUNK], row[lo:lo + CHUNK], v[lo:lo + CHUNK]
        for s in range(k):
            cell = _at(flat, begin + _at(columns[s], here)) * np.int64(n) + here
            out[s] += np.bincount(cell, x, n * n_bins).reshape(n_bins, n)
    return out


def best(cells: np.ndarray, may: np.ndarray, weights: tuple[float, float], min_rows: int) -> tuple[np.ndarray, ...]:
    """Per node: feature (-1: no split), cut, gain, draws per class on the left and in all."""
    n, k, b, _ = cells.shape
    total, rest = cells[:, 0].sum(axis=1), np.zeros(n, int)
    if b < 2:
        return rest - 1, rest, rest * 0.0, total * 0.0, total
    left = cells.cumsum(axis=2)[:, :, :-1]
    right = total[:, None, None] - left

    def good(c: np.ndarray) -> np.ndarray:
        a, z = c[..., 0] * weights[0], c[..., 1] * weights[1]
        return (a * a + z * z) / np.maximum(a + z, 1e-300)
    few = max(min_rows, 1)
    enough = (left.sum(axis=3) >= few) & (right.sum(axis=3) >= few)
    gain = np.where(enough, good(left) + good(right) - good(total)[:, None, None], -np.inf).reshape(n, -1)
    top = gain.argmax(axis=1)
    gain, column, cut = gain[np.arange(n), top], top // (b - 1), top % (b - 1)
    some = gain > 1e-9 * (total @ np.array(weights))
    feature = np.where(some, may[np.arange(n), column], -1)
    return feature, np.where(some, cut, 0), np.where(some, gain, 0.0), left[np.arange(n), column, cut], total


def _share(c: np.ndarray, weights: tuple[float, float]) -> np.ndarray:
    """Share of class 1 in whole parts, so that the sum of all trees has no order."""
    a, z = c[..., 0] * weights[0], c[..., 1] * weights[1]
    return np.rint(z / np.maximum(a + z, 1e-300) * PARTS) / PARTS


def _gains(left: np.ndarray, total: np.ndarray, weights: tuple[float, float], few: int) -> np.ndarray:
    """``best``'s gains of splits, from draws and ones in one number."""
    def apart(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ones = np.floor(x * (1.0 / ONES))
        return x - ones * ONES, ones

    def good(n: np.ndarray, ones: np.ndarray) -> np.ndarray:
        a, z = (n - ones) * weights[0], ones * weights[1]
        n = a + z
        a *= a
        z *= z
        a += z
        a /= n
        return a
    (n, one), (all_, ones) = apart(left), apart(total)
    m = all_ - n
    with np.errstate(invalid="ignore", divide="ignore"):       # sides without rows
        gain = good(n, one) + good(m, ones - one)
        gain -= good(all_, ones)
    gain[~((n >= few) & (m >= few))] = -np.inf
    return gain


def _counted(flat: np.ndarray, row: np.ndarray, at: np.ndarray, v: np.ndarray, total: np.ndarray, may: np.ndarray, n_bins: int,
             weights: tuple[float, float], few: int) -> tuple[np.ndarray, ...]:
    """Per node column, cut, gain and the left side's sum of the best split, from counts in all bins."""
    n, b = len(may), n_bins
    left = np.ascontiguousarray(_held(flat, row, at, v, may, b).cumsum(axis=1)[:, :-1]).reshape(-1, n)
    gain = np.ascontiguousarray(_gains(left, total, weights, few).T)
    top, nodes = gain.argmax(axis=1), np.arange(n)
    return top // (b - 1), top % (b - 1), gain[nodes, top], left[top, nodes]


def _sorted(flat: np.ndarray, row: np.ndarray, at: np.ndarray, v: np.ndarray, total: np.ndarray, may: np.ndarray,
            weights: tuple[float, float], few: int) -> tuple[np.ndarray, ...]:
    """The same from sorted rows, for nodes of few rows each."""
    n, k = may.shape
    low = at * k
    drawn = (v % ONES).astype(np.int64) | (v >= ONES).astype(np.int64) << 8
    keys = np.concatenate([(low + s) << 17 | _at(flat, row + _at(may[:, s], at)).astype(np.int64) << 9 | drawn for s in range(k)])
    keys.sort()
    sums = np.cumsum((keys & 255) * (1.0 + ONES * (keys >> 8 & 1)))
    cells = keys >> 9
    ends = np.append(np.flatnonzero(cells[1:] != cells[:-1]), len(cells) - 1)      # one for each bin with rows
    cells, sums = cells[ends], sums[ends]
    node = (cells >> 8) // k
    # a segment is a column of a node; the sum of all segments before it is taken off
    whole = np.cumsum(np.repeat(total, k))
    left = sums - (whole - np.repeat(total, k))[cells >> 8]
    gain = _gains(left, total[node], weights, few)
    first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    best_ = np.maximum.reduceat(gain, first)
    tops = np.flatnonzero(gain == best_[node])
    tops = tops[np.append(True, node[tops[1:]] != node[tops[:-1]])]
    return (cells[tops] >> 8) - np.arange(n) * k, cells[tops] & 255, best_, left[tops]


def grown(bins: np.ndarray, y: np.ndarray, w: np.ndarray, tree: int, heap: int, depth: int, n_bins: int,
          weights: tuple[float, float], p: Params) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The subtree of a node over its rows (rows, features), at most ``depth`` levels
    below it, and the sums of gain per feature.

    Nodes are grown level by level, in groups whose rows stay in the processor's cache."""
    k, few, gains, made = bins.shape[1], max(p.min_rows, 1), np.zeros(bins.shape[1]), 1
    parts: list[tuple[np.ndarray, ...]] = []           # place, feature, cut, left child, draws and ones
    v = _both(y, w)

    def mixed(total: np.ndarray) -> np.ndarray:
        ones = np.floor(total / ONES)
        return (ones > 0) & (total - ones * ONES > ones)

    root = np.array([v.sum()])
    parts.append((np.zeros(1, int), np.full(1, -1), np.zeros(1, int), np.zeros(1, int), root))
    todo = [(np.ascontiguousarray(bins).reshape(-1), np.arange(len(v)) * k, np.zeros(len(v), np.int64), v, np.zeros(1, int),
             np.array([heap], np.int64), root, depth)] if depth and n_bins > 1 and mixed(root)[0] else []
    while todo:
        flat, row, at, v, place, heaps, total, levels = todo.pop()     # nodes, all of both classes
        n = len(place)
        if len(row) > GROUP and n > 1 and (n >= 8 or len(row) <= n * GROUP):
            order = np.argsort(at.astype(np.uint16) if n < 1 << 16 else at, kind="stable")
            row, at, v = row[order], at[order], v[order]
            ends = np.searchsorted(at, np.arange(n), "right")
            lo = 0
            while lo < n:
                begin = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, begin + GROUP, "right")))
                some = slice(begin, ends[hi - 1])
                own = np.take(flat.reshape(-1, k), row[some] // k, axis=0).reshape(-1)
                todo.append((own, np.arange(len(own) // k) * k, at[some] - lo, v[some], place[lo:hi], heaps[lo:hi], total[lo:hi], levels))
                lo = hi
            continue
        may = allowed(tree, heaps, k, p)
        size = np.bincount(at, minlength=n)
        large = size >= FEW_ROWS
        if large.all():
            column, cut, gain, left = _counted(flat, row, at, v, total, may, n_bins, weights, few)
        elif not large.any():
            column, cut, gain, left = _sorted(flat, row, at, v, total, may, weights, few)
        else:
            column, cut, gain, left = np.empty(n, int), np.empty(n, int), np.empty(n), np.empty(n)
            slot = np.where(large, np.cumsum(large), np.cumsum(~large)) - 1
            of = large[at]
            for side, find in ((large, lambda *a: _counted(*a, n_bins, weights, few)), (~large, lambda *a: _sorted(*a, weights, few))):
                rows = np.flatnonzero(of if side is large else ~of)
                column[side], cut[side], gain[side], left[side] = find(flat, row[rows], slot[at[rows]], v[rows], total[side], may[side])
        ones = np.floor(total / ONES)
        split = np.flatnonzero(gain > 1e-9 * ((total - ones * (ONES + 1)) * weights[0] + ones * weights[1]))
        if not len(split):
            continue
        feature, cut, left = may[split, column[split]], cut[split], left[split]
        np.add.at(gains, feature, gain[split])
        down = made + 2 * np.arange(len(split))
        made += 2 * len(split)
        parts.append((place[split], feature, cut, down, total[split]))
        sums = np.stack([left, total[split] - left], axis=1).ravel()
        children = (down[:, None] + np.arange(2)).ravel()
        parts.append((children, np.full(len(sums), -1), np.zeros(len(sums), int), np.zeros(len(sums), int), sums))
        go_on = np.flatnonzero(mixed(sums)) if levels > 1 else np.zeros(0, int)      # others are leaves
        if not len(go_on):
            continue
        child = np.full(2 * n, -1)
        child[2 * np.repeat(split, 2)[go_on] + (go_on & 1)] = np.arange(len(go_on))
        by, over = np.zeros(n, np.int64), np.full(n, 255, np.uint8)
        by[split], over[split] = feature, cut
        nexts = [_at(child, 2 * a + (_at(flat, r + _at(by, a)) > _at(over, a)))
                 for a, r in ((at[lo:lo + CHUNK], row[lo:lo + CHUNK]) for lo in range(0, len(at), CHUNK))]
        at = np.concatenate(nexts)
        stay = np.flatnonzero(at >= 0)
        heaps = (2 * heaps[split][:, None] + np.arange(2)).ravel()[go_on]
        todo.append((flat, row[stay], at[stay], v[stay], children[go_on], heaps, sums[go_on], levels - 1))
    out = {c: np.empty(made, kind) for c, kind in KINDS.items()}
    for at, feature, cut, down, total in parts:            # a node that is split comes later than itself as a leaf
        ones = np.floor(total / ONES)
        share = _share(np.stack([total - ones * (ONES + 1), ones], axis=1), weights)
        for c, x in (("feature", feature), ("cut", cut), ("down", down), ("value", share)):
            out[c][at] = x
    return out, gains


def walked(feature: np.ndarray, cut: np.ndarray, down: np.ndarray, bins: np.ndarray, steps: int = 4) -> np.ndarray:
    """The node that each row (rows, features) comes to; after so many ``steps`` each,
    rows that have come to a leaf are set aside."""
    n, k = bins.shape
    out, inner = np.zeros(n, np.int64), feature >= 0
    if not n or not inner.any():
        return out
    # left child, feature and cut in one number; a leaf leads to itself
    node = np.where(inner, down.astype(np.int64) << 24 | feature.astype(np.int64) << 8 | cut.astype(np.int64),
                    np.arange(len(feature), dtype=np.int64) << 24 | 255)
    flat = np.ascontiguousarray(bins).reshape(-1)
    for lo in range(0, n, CHUNK):
        row = np.arange(lo, min(lo + CHUNK, n)) * k
        now, rows = np.zeros(len(row), np.int64), None
        while len(row):
            for _ in range(steps):
                x = _at(node, now)
                now = (x >> 24) + (_at(flat, row + (x >> 8 & 0xFFFF)) > (x & 255).astype(np.uint8))
            going = np.flatnonzero(_at(inner, now))
            if rows is None:
                out[lo:lo + len(row)], rows = now, going + lo
            else:
                out[rows] = now
                rows = rows[going]
            row, now = row[going], now[going]
    return out


# --- upper levels ----------------------------------------------------------------------------------
class Top:
    """The upper levels of a tree; nodes still to be grown are its frontier."""

    def __init__(self, heap: int = 1):
        self.feature, self.cut, self.down, self.heap, self.value = [-1], [0], [0], [heap], [0.0]
        self.frontier = [0]

    def arrays(self) -> tuple[np.ndarray, ...]:
        return np.array(self.feature), np.array(self.cut), np.array(self.down)


def _blocks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(rows, features) bins, classes, hashes of every packed block."""
    for b in batches:
        for r in b.to_pylist():
            yield (np.frombuffer(r["bins"], np.uint8).reshape(-1, k), np.frombuffer(r["y"], np.uint8), np.frombuffer(r["mark"], np.uint64))


def _levels(packed: DataFrame, k: int, n_bins: int, rows: int, weights: tuple[float, float], p: Params,
            tasks: int) -> tuple[dict[int, Top], np.ndarray]:
    """Upper levels of all trees, a Spark aggregate each, and their sums of gain per tree and feature."""
    tops, gains = {t: Top() for t in range(p.trees)}, np.zeros((p.trees, k))
    asked = {t: [0] for t in tops} if rows > LOCAL or p.depth <= SHALLOW else {}
    for level in range(p.depth):
        asked = {t: nodes for t, nodes in asked.items() if nodes}
        if not asked:
            break
        now = {t: (tops[t].arrays(), np.array([tops[t].heap[i] for i in nodes]), np.array(nodes)) for t, nodes in asked.items()}

        heaps_of = {t: x[1] for t, x in now.items()}

        def summed(batches: Iterator[pa.RecordBatch], now=now, level=level) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for bins, y, mark in _blocks(batches, k):
                for t, (top, heaps, nodes) in now.items():
                    slot = np.full(len(top[0]), -1)
                    slot[nodes] = np.arange(len(nodes))
                    cells = counts(bins, y, draws(mark, t, p), slot[walked(*top, bins, max(level, 1))], allowed(t, heaps, k, p), n_bins)
                    held[t] = held[t] + cells if t in held else cells
            for t, cells in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), t, np.int32)), pa.array(np.arange(len(cells), dtype=np.int32)),
                                                  pa.array([c.tobytes() for c in cells], pa.binary())], ["tree", "slot", "cells"])

        def split(group: pa.Table) -> pa.Table:
            t, slot = group["tree"][0].as_py(), group["slot"][0].as_py()
            may = allowed(t, heaps_of[t][slot:slot + 1], k, p)
            cells = sum(np.frombuffer(c.as_py()) for c in group["cells"]).reshape(1, may.shape[1], n_bins, 2)
            feature, cut, gain, left, total = best(cells, may, weights, p.min_rows)
            return pa.table({"tree": pa.array([t], pa.int32()), "slot": pa.array([slot], pa.int32()), "feature": pa.array([int(feature[0])], pa.int32()),
                             "cut": pa.array([int(cut[0])], pa.int32()), "gain": pa.array([float(gain[0])]),
                             "draws": pa.array([[*left[0].tolist(), *total[0].tolist()]])})

        found = packed.mapInArrow(summed, "tree int, slot int, cells binary").repartition(tasks, "tree", "slot").groupBy("tree", "slot") \
            .applyInArrow(split, "tree int, slot int, feature int, cut int, gain double, draws array<double>").collect()
        nodes_of, asked = asked, {t: [] for t in tops}
        for r in sorted(found, key=lambda r: (r["tree"], r["slot"])):
            t, node = r["tree"], nodes_of[r["tree"]][r["slot"]]
            top, left, total = tops[t], np.array(r["draws"][:2]), np.array(r["draws"][2:])
            top.value[node] = float(_share(total, weights))
            top.frontier.remove(node)
            if r["feature"] < 0:
                continue
            top.feature[node], top.cut[node], top.down[node] = r["feature"], r["cut"], len(top.feature)
            gains[t, r["feature"]] += r["gain"]
            for side, c in enumerate((left, total - left)):
                child = len(top.feature)
                for x, v in ((top.feature, -1), (top.cut, 0), (top.down, 0), (top.heap, 2 * top.heap[node] + side),
                             (top.value, float(_share(c, weights)))):
                    x.append(v)
                if level + 1 < p.depth and c.min() > 0:
                    top.frontier.append(child)
                    if c.sum() > LOCAL or p.depth <= SHALLOW:
                        asked[t].append(child)
    return tops, gains


# --- a forest ----------------------------------------------------------------------------------------
class Forest:
    """A fitted forest: feature names, fills, bin edges, importances, and the folder of
    its trees (rows of NODES: part -1 is the upper levels of a tree, part i what
    stands below its node i)."""

    def __init__(self, family: str, features: list[str], medians: dict, edges: dict, trees: int, gains: list[float], path: str):
        self.family, self.features, self.medians, self.edges = family, list(features), medians, edges
        self.trees, self.gains, self.path = trees, list(gains), path

    def filled(self) -> list:
        return [F.coalesce(_clean(c), F.lit(float(self.medians[c]))).alias(f"x{i}") for i, c in enumerate(self.features)]

    def binned(self, columns: list[np.ndarray]) -> np.ndarray:
        return binned(columns, [np.array(self.edges[c], float) for c in self.features])

    def score(self, df: DataFrame, keep=("id", "label")) -> DataFrame:
        cols, model = [c for c in keep if c in df.columns], self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for some in _gathered(batches, 16 * BLOCK):        # the trees are read once for each
                table = pa.Table.from_batches(some)
                del some
                bins = np.ascontiguousarray(model.binned([table.column(len(cols) + i).to_numpy() for i in range(len(model.features))]).T)
                table = table.select(range(len(cols)))
                total = np.zeros(len(bins))
                for feature, cut, down, value in stored(model.path):
                    total += value[walked(feature, cut, down, bins)]
                out = table.append_column("p1", pa.array(total / max(model.trees, 1)))
                yield from out.to_batches(max_chunksize=10_000)

        kinds = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols), "p1 double"])
        p1 = F.col("p1")
        return df.select(*cols, *self.filled()).mapInArrow(run, kinds).select(
            *cols, (p1 > 0.5).cast("int").alias("prediction"), p1, F.greatest(p1, F.lit(1.0) - p1).alias("confidence"))

    def importances(self) -> list[tuple[str, float]]:
        return list(zip(self.features, self.gains))

    def as_dict(self) -> dict:
        return {k: getattr(self, k) for k in ("family", "features", "medians", "edges", "trees", "gains")}


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches put together to about so many rows."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield held
            held = []
    if held:
        yield held


def stored(path: str) -> Iterator[tuple[np.ndarray, ...]]:
    """Feature, cut, left child and value of all nodes, tree after tree."""
    store, root = pafs.FileSystem.from_uri(path)
    names = sorted(f.path for f in store.get_file_info(pafs.FileSelector(root)) if f.base_name.endswith(".parquet"))
    for name in names:
        rows: dict[int, list[dict]] = {}
        for b in pq.ParquetFile(store.open_input_file(name)).iter_batches(batch_size=64):
            for r in b.to_pylist():
                rows.setdefault(r["tree"], []).append(r)
        for t in sorted(rows):
            yield joined(rows.pop(t))


def joined(parts: list[dict]) -> tuple[np.ndarray, ...]:
    """One tree of its parts."""
    parts = sorted(parts, key=lambda r: r["part"])
    read = [{c: np.frombuffer(r[c], kind) for c, kind in KINDS.items()} for r in parts]
    whole = {c: np.concatenate([x[c][min(i, 1):] for i, x in enumerate(read)]) for c in KINDS}
    made = len(read[0]["feature"])
    for r, x in zip(parts[1:], read[1:]):
        n, at = len(x["feature"]) - 1, r["part"]
        for c in KINDS:
            whole[c][at] = x[c][0]
        inner = np.concatenate([[at], np.arange(made, made + n)])
        whole["down"][inner] = np.where(x["feature"] >= 0, x["down"] + (made - 1), 0)
        made += n
    return tuple(whole[c] for c in KINDS)


def fit(df: DataFrame, features: list[str], family: str, p: Params, medians: dict, weights: tuple[float, float] = (1.0, 1.0),
        label: str = "label", id_col: str = "id", rows: int | None = None) -> Forest:
    """A forest on rows with labels 0 and 1 (rows without one leave); features have
    their fills in ``medians``."""
    spark, k = df.sparkSession, len(features)
    model = Forest(family, features, medians, {}, p.trees, [0.0] * k, scratch_dir(spark, f"forest-{uuid.uuid4().hex}"))
    ready = df.where(F.col(label).isNotNull()).select(*model.filled(), F.col(label).cast("int").alias("y"),
                                                      F.xxhash64(id_col, label, *features).alias("mark"))
    rows = ready.count() if rows is None else rows
    model.edges = _edges(ready.toDF(*features, "y", "mark"), features, p.bins + 1)
    n_bins = 2 + max((len(model.edges[c]) for c in features), default=0)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _gathered(batches, BLOCK):
            table = pa.Table.from_batches(some)
            x = [table.column(j).to_numpy() for j in range(k)]
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in
                                              (np.ascontiguousarray(model.binned(x).T), table.column(k).to_numpy().astype(np.uint8),
                                               table.column(k + 1).to_numpy())], ["bins", "y", "mark"])

    slots = spark.sparkContext.defaultParallelism
    packed = ready.repartition(max(min(slots, -(-rows // 4096)), -(-rows // (4 * BLOCK)), 1)).mapInArrow(pack, PACKED).persist()
    tops, gains = _levels(packed, k, n_bins, rows, weights, p, 2 * slots)
    heads = {t: (top.arrays(), np.array(top.frontier, int)) for t, top in tops.items() if top.frontier}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bins, y, mark in _blocks(batches, k):
            for t, (top, frontier) in heads.items():
                slot = np.full(len(top[0]), -1)
                slot[frontier] = np.arange(len(frontier))
                w, at = draws(mark, t, p), slot[walked(*top, bins)]
                some = np.flatnonzero((w > 0) & (at >= 0))
                order = some[np.argsort(at[some].astype(np.uint16) if len(frontier) < 1 << 16 else at[some], kind="stable")]
                ends = np.searchsorted(at[order], np.arange(len(frontier)), "right").tolist()
                own = [np.take(x, order, axis=0) for x in (bins, y, w)]
                out = [(node, *[x[lo:hi].tobytes() for x in own]) for node, lo, hi in zip(frontier.tolist(), [0, *ends], ends) if hi > lo]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([t] * len(out), pa.int32()), pa.array([r[0] for r in out], pa.int32()),
                                                      *[pa.array([r[c] for r in out], pa.binary()) for c in (1, 2, 3)]],
                                                     ["tree", "part", "bins", "y", "w"])

    places = {t: {i: top.heap[i] for i in top.frontier} for t, top in tops.items()}

    def grow(group: pa.Table) -> pa.Table:
        t, node = group["tree"][0].as_py(), group["part"][0].as_py()
        bins, y, w = (np.frombuffer(b"".join(group[c].to_pylist()), np.uint8) for c in ("bins", "y", "w"))
        heap = places[t][node]
        part, gain = grown(bins.reshape(-1, k), y, w, t, heap, p.depth + 1 - heap.bit_length(), n_bins, weights, p)
        return pa.table({"tree": pa.array([t], pa.int32()), "part": pa.array([node], pa.int32()),
                         **{c: pa.array([part[c].tobytes()], pa.binary()) for c in KINDS}, "gains": pa.array([gain.tolist()])})

    heads_of_trees = spark.createDataFrame(
        [(t, -1, *[bytearray(np.array(getattr(top, c)).astype(kind).tobytes()) for c, kind in KINDS.items()], [0.0] * k) for t, top in tops.items()],
        f"{NODES}, gains array<double>")
    parts = packed.mapInArrow(dealt, "tree int, part int, bins binary, y binary, w binary").repartition(max(3 * slots, -(-rows * p.trees // (1 << 24))), "tree", "part") \
        .groupBy("tree", "part").applyInArrow(grow, f"{NODES}, gains array<double>")
    parts.unionByName(heads_of_trees).repartition(max(1, min(p.trees, 4 * slots)), "tree").write.parquet(model.path)
    packed.unpersist()
    sums = spark.read.parquet(model.path).groupBy("tree").agg(*[F.sum(F.col("gains")[j]).alias(f"g{j}") for j in range(k)])
    for r in sums.collect():                   # a row per tree
        gains[r["tree"]] += [r[f"g{j}"] for j in range(k)]
    whole = gains.sum(axis=1, keepdims=True)   # every tree's shares count the same
    shares = np.divide(gains, whole, out=np.zeros_like(gains), where=whole > 0).sum(axis=0)
    model.gains = (shares / (shares.sum() or 1.0)).tolist()
    return model


def restored(d: dict, path: str) -> Forest:
    return Forest(**d, path=path)


def saved(model: Forest, path: str) -> None:
    """Copies the trees."""
    SparkSession.active().read.parquet(model.path).write.mode("overwrite").parquet(path)
