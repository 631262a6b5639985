"""Binned-histogram boosting (J2-J5, J11): all rounds of all folds on one packed
table.

Features are cut once into at most 256 bins: bin 0 holds missing values, which
go left at every split, the others end at approximate quantiles.  Rows lie packed
in blocks (a byte per feature and row).  All rounds run in one barrier stage: each
task keeps its share of the rows, their scores and their nodes in memory, sums
gradient, second order and rows per (node, feature, bin) of a level, and puts the
sums into a file of the shared folder, for as many models at once as it has room for.
Where a level has many nodes, each task adds up and splits its share of them, and the
splits go round; so what a task reads depends on the model's size, not on the rows.
Where the rows of many nodes are fewer bytes than the sums of the levels to come, their
rows are dealt to the tasks instead, each of which finds all that is below its share of
the nodes.  Gradients are rounded to whole
multiples of 1 / UNIT, so sums are exact and, given the bins, a fit does not depend
on how rows are laid out.

Where the number of tasks that run at once is not known, or tasks cannot write to
the shared folder, a level is one Spark aggregate instead, all folds in the same
passes; scores so far are then kept per block and written anew every RENEW rounds,
which cuts lineage.  Folds are models that leave out the rows of one fold.  An input
that fits one block (BLOCK rows) has no sums to exchange: its rounds run beside it,
one task per model.  All three use the same functions and have the same result.

Leaves take a Newton step with L2: -G / (H + l2) times the step size.  A fit with
validation rows keeps their loss after every round, stops when ``patience`` rounds
brought no gain and returns the best round.  AdaBoost (SAMME) is the same loop over
stumps by Gini gain on sums of weights.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.session import scratch_dir

BLOCK = 1 << 17            # rows of a block
UNIT = float(1 << 24)      # whole parts of a gradient
GANG_ROWS = 1 << 15        # rows of a task of the barrier stage, at least
FEW_NODES = 8              # nodes of a level whose sums every task adds up itself
CHUNK = 1 << 14            # rows that are worked on at once, so that they stay in the processor's cache
FEW_SPLITS = 16            # splits of a tree up to which all are tried for every row
TOGETHER = 1 << 28         # bytes of a task's rows and sums for models that are fitted in the same steps
RENEW = 10                 # rounds between two writes of the scores so far
PACKED = "n int, bins binary, y binary, fold binary, held binary, score binary"


@dataclass
class Params:
    rounds: int = 100
    depth: int = 6
    step: float = 0.1
    bins: int = 256
    l2: float = 1.0
    min_rows: int = 1
    min_hessian: float = 0.0
    patience: int | None = None
    kind: str = "newton"       # or "samme"


@dataclass
class Tree:
    """Nodes in the order of their making; a leaf has feature -1."""
    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])     # the right child follows
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, gain: float, values: tuple[float, float]) -> list[int]:
        at = len(self.feature)
        self.feature[node], self.bin[node], self.left[node], self.gain[node] = feature, cut, at, gain
        for v in values:
            self.feature.append(-1)
            self.bin.append(0)
            self.left.append(0)
            self.value.append(v)
            self.gain.append(0.0)
        return [at, at + 1]

    def _value(self, node: int, bins: np.ndarray):
        """The values below a node, each split tried for all rows."""
        if self.feature[node] < 0:
            return self.value[node]
        left = self.left[node]
        return np.where(bins[self.feature[node]] > self.bin[node], self._value(left + 1, bins), self._value(left, bins))

    def score(self, bins: np.ndarray) -> np.ndarray:
        """The value of each row (column of ``bins``)."""
        out = np.empty(bins.shape[1])
        if len(self.feature) <= 2 * FEW_SPLITS + 1:
            for lo in range(0, len(out), CHUNK):
                out[lo:lo + CHUNK] = self._value(0, bins[:, lo:lo + CHUNK])
            return out
        deep = np.zeros(len(self.feature), int)
        for node, f in enumerate(self.feature):
            if f >= 0:
                deep[self.left[node]] = deep[self.left[node] + 1] = deep[node] + 1
        feature, value = np.array(self.feature), np.array(self.value)
        inner = feature >= 0            # a row that has come to a leaf stays there
        cut = np.where(inner, self.bin, 255).astype(np.uint8)
        left = np.where(inner, self.left, np.arange(len(feature)))
        for lo in range(0, len(out), CHUNK):
            part = np.ascontiguousarray(bins[:, lo:lo + CHUNK])
            n = part.shape[1]
            flat, column, row = part.ravel(), np.arange(n), np.where(inner, feature, 0) * n
            now = np.zeros(n, np.int64)
            for _ in range(deep.max()):
                now = left.take(now) + (flat.take(row.take(now) + column) > cut.take(now))
            out[lo:lo + CHUNK] = value.take(now)
        return out


@dataclass
class Fit:
    """A model in the making: what a block must know to go on with it."""
    out: int | None            # rows of this fold are left out
    base: float
    weights: tuple[float, float]
    trees: list[Tree] = field(default_factory=list)
    frontier: list[int] = field(default_factory=lambda: [0])
    scale: float = 1.0         # SAMME: rows per sum of weights
    train_loss: list[float] = field(default_factory=list)
    held_loss: list[float] = field(default_factory=list)
    done: bool = False


# --- what a block does ---------------------------------------------------------------------------
class Block:
    """Packed rows of one task: (features, rows) bins, labels, folds, held-out
    marks and per model the score of the trees that are in ``score``."""

    def __init__(self, rows: list[dict], n_features: int, n_models: int):
        raw = {c: b"".join(r[c] for r in rows) for c in ("y", "fold", "held")}
        self.y, self.fold, self.held = (np.frombuffer(raw[c], np.uint8) for c in ("y", "fold", "held"))
        n = len(self.y)
        self.bins = np.concatenate([np.frombuffer(r["bins"], np.uint8).reshape(n_features, -1) for r in rows] or
                                   [np.zeros((n_features, 0), np.uint8)], axis=1)
        parts = [np.frombuffer(r["score"], np.float64).reshape(-1, r["n"]) for r in rows]
        self.score = np.concatenate(parts, axis=1).copy() if rows and parts[0].size else np.zeros((n_models, n))
        self.forget()

    def forget(self) -> None:
        self.own: dict[int, tuple] = {}         # model -> its training rows, their bins and labels
        self.last: dict[int, tuple] = {}        # model -> (tree, the training rows of each leaf, gradients)
        self.before: dict[int, tuple] = {}      # model -> (slot of each node of the level before, its sums)
        self.counts: dict[int, np.ndarray] = {}     # model -> rows per (feature, bin) at any root

    def begin(self, n_models: int) -> None:
        """Other models, from the first round on."""
        self.score = np.zeros((n_models, len(self.y)))
        self.forget()

    def mine(self, m: int, fit: Fit) -> tuple:
        if m not in self.own:
            used = self.used(fit)
            if used.all():
                self.own[m] = slice(None), self.bins, self.y
            else:
                rows = np.nonzero(used)[0]
                self.own[m] = rows.astype(np.int32), self.bins.take(rows, axis=1), self.y[rows]
        return self.own[m]

    def add(self, m: int, fit: Fit, tree: Tree, p: Params) -> None:
        def more(score: np.ndarray, y: np.ndarray) -> np.ndarray:
            # SAMME: the logarithm of a row's weight grows where the stump is wrong
            return abs(tree.value[0]) * ((score > 0) != (y > 0)) if p.kind == "samme" else score

        if m not in self.last or self.last[m][0] is not tree:
            self.last.pop(m, None)
            self.score[m] += more(tree.score(self.bins), self.y)
            return
        _, parts, _ = self.last.pop(m)
        rows, bins, y = self.mine(m, fit)
        if len(tree.feature) <= 2 * FEW_SPLITS + 1:
            score = tree.score(bins)
        else:
            score = np.empty(len(y))
            for node, at in _parted(parts, bins, tree).items():
                score[at] = tree.value[node]
        self.score[m][rows] += more(score, y)
        held = np.nonzero(self.held > 0)[0]
        if len(held):
            self.score[m][held] += more(tree.score(self.bins.take(held, axis=1)), self.y[held])

    def gradients(self, m: int, fit: Fit, p: Params) -> tuple[np.ndarray | None, np.ndarray]:
        """Of the training rows; SAMME: weights only, as the gradient is that of label 1."""
        rows, _, y = self.mine(m, fit)
        score = self.score[m][rows]
        if p.kind == "samme":
            return None, np.rint(np.exp(score) * fit.scale * UNIT)
        w = np.where(y > 0, fit.weights[1], fit.weights[0])
        prob = 1.0 / (1.0 + np.exp(-(fit.base + score)))
        return np.rint((prob - y) * w * UNIT), np.rint(prob * (1.0 - prob) * w * UNIT)

    def used(self, fit: Fit) -> np.ndarray:
        keep = self.held == 0
        return keep if fit.out is None else keep & (self.fold != fit.out)

    def losses(self, m: int, fit: Fit) -> np.ndarray:
        """Sums of the log loss (in units) and rows: training, held out."""
        out = []
        held = np.nonzero(self.held > 0)[0]
        rows, _, y = self.mine(m, fit)
        for rows, y in ((rows, y), (held, self.y[held])):
            margin = fit.base + self.score[m][rows]
            out.append([int(np.rint((np.logaddexp(0.0, margin) - y * margin) * UNIT).sum()), len(y)])
        return np.array(out, np.int64)

    def parts(self, m: int, fit: Fit, tree: Tree, p: Params) -> tuple[dict, np.ndarray | None, np.ndarray]:
        """The training rows of each leaf, and all their gradients."""
        if m not in self.last or self.last[m][0] is not tree:
            self.last[m] = tree, {0: slice(None)}, self.gradients(m, fit, p)
            self.before.pop(m, None)
        _, parts, (g, h) = self.last[m]
        return _parted(parts, self.mine(m, fit)[1], tree), g, h

    def frontier_rows(self, m: int, fit: Fit, tree: Tree, p: Params) -> list[tuple]:
        """Per frontier node bins and gradients of its training rows."""
        parts, g, h = self.parts(m, fit, tree, p)
        bins = self.mine(m, fit)[1]
        return [(bins.take(at, axis=1), g[at], h[at]) for at in (parts[node] for node in fit.frontier)]

    def sums(self, m: int, fit: Fit, tree: Tree, p: Params, n_bins: int) -> np.ndarray:
        """(frontier node, feature, bin, 3) whole sums of gradient, second order, rows.
        Of two children of a node whose sums are kept, only the one with fewer rows
        is summed; the other has the rest."""
        _, bins, y = self.mine(m, fit)
        parts, g, h = self.parts(m, fit, tree, p)
        where = {node: i for i, node in enumerate(fit.frontier)}
        rest = []                               # (slot of a child, slot of its sibling, slot of their parent)
        slots, old = self.before.get(m, ({}, None))
        for parent, i in slots.items():
            a, b = where.get(tree.left[parent]), where.get(tree.left[parent] + 1)
            if tree.feature[parent] >= 0 and a is not None and b is not None:
                left, both = old[i, tree.feature[parent], :tree.bin[parent] + 1, 2].sum(), old[i, 0, :, 2].sum()
                rest.append((a, b, i) if 2 * left > both else (b, a, i))
        n, f = len(fit.frontier), len(bins)
        todo = sorted(set(range(n)) - {a for a, _, _ in rest})
        if fit.frontier == [0]:
            out = cell_sums(bins, y, g, h, None, None, n_bins, self.counts.get(m))
            self.counts[m] = out[0, :, :, 2].copy()
        else:
            at = [parts[fit.frontier[i]] for i in todo]
            out = cell_sums(bins, y, g, h, np.concatenate(at) if at else np.zeros(0, np.int32), [len(x) for x in at], n_bins)
        if rest:
            some, out = out, np.empty((n, f, n_bins, 3))
            out[todo] = some
            a, b, i = (list(x) for x in zip(*rest))
            out[a] = old[i] - out[b]
        self.before[m] = where, out
        return out


def _parted(parts: dict, bins: np.ndarray, tree: Tree) -> dict:
    """Hands rows of nodes that have been split on to their children."""
    todo = [node for node in parts if tree.feature[node] >= 0]
    while todo:
        node = todo.pop()
        at, left = parts.pop(node), tree.left[node]
        right = bins[tree.feature[node]][at] > tree.bin[node]
        for child, go in ((left, ~right), (left + 1, right)):
            parts[child] = np.nonzero(go)[0].astype(np.int32) if isinstance(at, slice) else at[go]
            if tree.feature[child] >= 0:
                todo.append(child)
    return parts


def cell_sums(bins: np.ndarray, y: np.ndarray, g: np.ndarray | None, h: np.ndarray, at: np.ndarray | None,
              sizes: list[int] | None, n_bins: int, counts: np.ndarray | None = None) -> np.ndarray:
    """(node, feature, bin, 3) sums of gradient, second order, rows.  ``at``: rows of
    the first node, of the second and so on, ``sizes`` of them; None: one node has all,
    with ``counts`` rows per bin if these are known.  Without ``g`` the gradient is
    ``h`` in rows of label 1."""
    nodes = 1 if at is None else len(sizes)
    n, size = bins.shape[1] if at is None else len(at), nodes * n_bins
    out = np.zeros((nodes, len(bins), n_bins, 3))
    base = None if at is None else np.repeat(np.arange(nodes) * n_bins, sizes)
    step = max(CHUNK, size)
    for lo in range(0, n, step):
        s = slice(lo, lo + step) if at is None else at[lo:lo + step]
        hs, gs, ys = h[s], None if g is None else g[s], y[s] * np.int64(size) if g is None else None
        for j in range(len(bins)):
            cell = bins[j][s].astype(np.int64)
            if base is not None:
                cell += base[lo:lo + step]
            if counts is None:
                out[:, j, :, 2] += np.bincount(cell, None, size).reshape(nodes, n_bins)
            if g is None:
                both = np.bincount(cell + ys, hs, 2 * size).reshape(2, nodes, n_bins)
                out[:, j, :, 0] += both[1]
                out[:, j, :, 1] += both[0] + both[1]
            else:
                out[:, j, :, 0] += np.bincount(cell, gs, size).reshape(nodes, n_bins)
                out[:, j, :, 1] += np.bincount(cell, hs, size).reshape(nodes, n_bins)
    if counts is not None:
        out[0, :, :, 2] = counts
    return out


def levels_below(rows: list[tuple], p: Params, levels: int, n_bins: int) -> list[list[list[tuple | None]]]:
    """For each of several nodes, given its rows (bins, gradient, second order): the
    splits of its first level, of the second and so on, as far as there are any."""
    out: list[list] = [[] for _ in rows]
    if not rows:
        return out
    bins, g, h = (np.concatenate(x, axis=-1) for x in zip(*rows))
    ends = np.cumsum([len(r[1]) for r in rows])
    # (node, rows, and for the larger of two children its sibling's place and their parent's sums)
    now = [(i, np.arange(end - len(r[1]), end), None) for i, (r, end) in enumerate(zip(rows, ends))]
    for level in range(levels):
        if not now:
            break
        todo = [k for k, x in enumerate(now) if x[2] is None]
        at = [now[k][1] for k in todo]
        sums = np.empty((len(now), len(bins), n_bins, 3))
        sums[todo] = cell_sums(bins, h, g, h, np.concatenate(at), [len(x) for x in at], n_bins)
        for k, (_, _, rest) in enumerate(now):
            if rest:
                sums[k] = rest[1] - sums[rest[0]]
        new = []
        for (i, x, _), s, own in zip(now, best_splits(sums, p), sums):
            if len(out[i]) == level:
                out[i].append([])
            out[i][level].append(s)
            if s:
                right = bins[s[0]][x] > s[1]
                sides = [x[go] for go, more in zip((~right, right), s[4]) if more]
                large = max((0, 1), key=lambda k: len(sides[k])) if len(sides) == 2 else None
                new += [(i, side, (len(new) + 1 - k, own) if k == large else None) for k, side in enumerate(sides)]
        now = new
    return out


# --- what follows from the sums --------------------------------------------------------------------
def best_splits(sums: np.ndarray, p: Params) -> list[tuple | None]:
    """Per node (feature, bin, gain, left and right value, which of them may be
    split again), the first of equal gains, or nothing.  ``sums`` has whole numbers."""
    n, f, b, _ = sums.shape
    left = sums.cumsum(axis=2)[:, :, :-1].astype(float)
    total = sums.sum(axis=2)[:, :, None].astype(float)
    right = total - left
    enough = (left[..., 2] >= p.min_rows) & (right[..., 2] >= p.min_rows)

    def leaf(x: np.ndarray) -> np.ndarray:
        if p.kind == "samme":
            return np.where(x[..., 1] > 0, 2 * x[..., 0] > x[..., 1], 0) * 2.0 - 1.0
        return -x[..., 0] / np.maximum(x[..., 1] + p.l2 * UNIT, 1e-12) * p.step

    def good(x: np.ndarray) -> np.ndarray:
        if p.kind == "samme":      # weight times (1 - Gini impurity), up to a constant
            return (x[..., 0] ** 2 + (x[..., 1] - x[..., 0]) ** 2) / np.maximum(x[..., 1], 1e-12)
        return x[..., 0] ** 2 / np.maximum(x[..., 1] + p.l2 * UNIT, 1e-12)

    enough &= (left[..., 1] >= p.min_hessian * UNIT) & (right[..., 1] >= p.min_hessian * UNIT)
    gain = np.where(enough, good(left) + good(right) - good(total), -np.inf) / UNIT
    if not gain.size:
        return [None] * n
    at = gain.reshape(n, -1).argmax(axis=1)
    out: list[tuple | None] = []
    for i, a in enumerate(at.tolist()):
        j, k = divmod(a, b - 1)
        if not gain[i, j, k] > 1e-9:
            out.append(None)
            continue
        sides = left[i, j, k], right[i, j, k]
        # a side that cannot be split again leaves the frontier
        more = tuple(bool(x[2] >= 2 * p.min_rows and x[1] >= 2 * p.min_hessian * UNIT) for x in sides)
        out.append((j, k, float(gain[i, j, k]), tuple(float(leaf(x)) for x in sides), more))
    return out


def _grown(tree: Tree, fit: Fit, splits: list[tuple | None]) -> None:
    """The next level of a tree; the frontier becomes the new nodes."""
    new = []
    for node, s in zip(fit.frontier, splits):
        if s:
            new += [child for child, more in zip(tree.split(node, *s[:4]), s[4]) if more]
    fit.frontier = new


def _weighted(tree: Tree, fit: Fit, root: np.ndarray) -> None:
    """SAMME: a stump's vote weight (kept as the root's value) and the next scale
    of the weights, from the root's sums, in which the split's sides can be read."""
    total = float(root[0, :, 1].sum())
    if tree.feature[0] < 0:
        fit.done = True
        return
    j, k, at = tree.feature[0], tree.bin[0], tree.left[0]
    sides = [root[j, :k + 1].sum(axis=0), root[j, k + 1:].sum(axis=0)]
    wrong = sum(float(s[1] - s[0] if tree.value[at + i] > 0 else s[0]) for i, s in enumerate(sides))
    err = wrong / total
    if err >= 0.5:
        fit.done = True
        return
    alpha = math.log((1 - max(err, 1e-10)) / max(err, 1e-10))
    tree.value[0], tree.value[at], tree.value[at + 1] = alpha, alpha * tree.value[at], alpha * tree.value[at + 1]
    fit.scale *= total / (total + wrong * (math.exp(alpha) - 1.0))
    fit.done = err <= 1e-10


def _heard(fit: Fit, loss: np.ndarray, p: Params) -> None:
    """Losses after the trees so far; stops where patience ends."""
    (a, n), (b, held) = loss.tolist()
    fit.train_loss.append(a / UNIT / n if n else 0.0)
    if held:
        fit.held_loss.append(b / UNIT / held)
        if p.patience is not None and len(fit.held_loss) - 1 - int(np.argmin(fit.held_loss)) >= p.patience:
            fit.done = True


def _rounds(fits: list[Fit], p: Params, sums_of, losses_of, add, splits_of=None) -> None:
    """The loop of all models.  ``sums_of(trees)`` gives the sums of every model
    that has a frontier, ``losses_of()`` the losses of those at work, ``add`` puts
    finished trees into the scores; ``splits_of(trees)`` gives, in place of sums,
    those of a model's first node (at a root) and the splits of all."""
    if splits_of is None:
        def splits_of(trees: dict[int, Tree]) -> dict[int, tuple]:
            return {m: (s[0], best_splits(s, p)) for m, s in sums_of(trees).items()}
    for _ in range(p.rounds):
        trees: dict[int, Tree] = {}
        if p.kind == "newton":
            for m, x in losses_of([m for m, f in enumerate(fits) if not f.done]).items():
                _heard(fits[m], x, p)
        for m, fit in enumerate(fits):
            if not fit.done:
                trees[m], fit.frontier = Tree(), [0]
        roots = {}
        for level in range(p.depth):
            at_work = {m: t for m, t in trees.items() if fits[m].frontier}
            if not at_work:
                break
            for m, (root, splits) in splits_of(at_work).items():
                roots.setdefault(m, root)
                _grown(trees[m], fits[m], splits)
        for m, tree in trees.items():
            if p.kind == "samme":
                _weighted(tree, fits[m], roots[m])
                if tree.value[0] == 0.0:
                    continue
            fits[m].trees.append(tree)
            add(m, tree)
        if all(f.done for f in fits):
            return
    if p.kind == "newton":
        for m, x in losses_of([m for m, f in enumerate(fits) if not f.done]).items():
            _heard(fits[m], x, p)


def _rows(batches: Iterator[pa.RecordBatch]) -> list[dict]:
    return [r for b in batches for r in b.to_pylist()]


def _fit_beside(blocks: DataFrame, fits: list[Fit], p: Params, n_features: int, n_bins: int) -> list[Fit]:
    """All rounds beside the one block, one task per model."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _rows(batches)
        for m in sorted({r["model"] for r in rows}):
            block, fit = Block([r for r in rows if r["model"] == m], n_features, 1), fits[m]
            _rounds([fit], p, lambda trees: {0: block.sums(0, fit, trees[0], p, n_bins)},
                    lambda at_work: {i: block.losses(i, fit) for i in at_work}, lambda i, tree: block.add(i, fit, tree, p))
            yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([json.dumps(asdict(fit))])], ["model", "fit"])

    models = F.explode(F.array(*[F.lit(m) for m in range(len(fits))])).alias("model")
    spread = blocks.select("*", models).repartitionByRange(len(fits), "model")
    done = {r["model"]: json.loads(r["fit"]) for r in spread.mapInArrow(run, "model int, fit string").collect()}
    return [_restored(done[m]) if m in done else fits[m] for m in range(len(fits))]


def _restored(d: dict) -> Fit:
    return Fit(**{**d, "weights": tuple(d["weights"]), "trees": [Tree(**t) for t in d["trees"]]})


class Gang:
    """What the tasks of one barrier stage tell each other, in files of the shared
    folder: in a step every task puts one file and gets a range of all of them."""

    def __init__(self, folder: str, rank: int, size: int):
        self.store, self.root = pafs.FileSystem.from_uri(folder)
        self.store.create_dir(self.root, recursive=True)
        self.rank, self.size, self.step = rank, size, 0

    def name(self, step: int, rank: int) -> str:
        return f"{self.root}/{step}-{rank}"

    def put(self, raw: bytes) -> None:
        self.step += 1
        part = f"{self.root}/part-{self.rank}"
        with self.store.open_output_stream(part, compression=None) as out:
            out.write(raw)
        self.store.move(part, self.name(self.step, self.rank))     # seen whole or not at all

    def get(self, read=lambda f: f.read()) -> Iterator:
        for rank in range(self.size):
            name, pause = self.name(self.step, rank), 0.0005
            while self.store.get_file_info(name).type != pafs.FileType.File:
                time.sleep(pause)
                pause = min(2 * pause, 0.01)
            with self.store.open_input_file(name) as f:
                yield read(f)
        if self.step > 1:          # who has put this step's file has read all of the step before
            self.store.delete_file(self.name(self.step - 1, self.rank))

    def total(self, x: np.ndarray) -> np.ndarray:
        """The sum of all tasks' arrays."""
        self.put(np.ascontiguousarray(x).tobytes())
        return sum(np.frombuffer(raw, x.dtype) for raw in self.get()).reshape(x.shape)

    def added(self, sums: np.ndarray, p: Params) -> tuple[np.ndarray | None, list[tuple | None]]:
        """All nodes' sums (None if no task added them all up) and splits; every task
        adds up and splits its share of many nodes."""
        n = len(sums)
        if n < FEW_NODES or p.kind == "samme":
            whole = self.total(sums)
            return whole, best_splits(whole, p)
        # few rows of a task come to one of many nodes: their sums mostly fit half the bytes
        short = np.abs(sums).max() < 1 << 31
        self.put(b"\1" + sums.astype(np.int32).tobytes() if short else b"\0" + np.ascontiguousarray(sums).tobytes())
        lo, hi = (n * r // self.size for r in (self.rank, self.rank + 1))

        def share(f) -> np.ndarray:
            kind = np.dtype(np.int32 if f.read(1) == b"\1" else sums.dtype)
            width = sums[0].size * kind.itemsize
            f.seek(1 + lo * width)
            return np.frombuffer(f.read((hi - lo) * width), kind).astype(sums.dtype)

        mine = sum(self.get(share))
        mine = best_splits(mine.reshape(hi - lo, *sums.shape[1:]), p) if hi > lo else []
        self.put(json.dumps(mine).encode())
        return None, [s for raw in self.get() for s in json.loads(raw)]

    def below(self, rows: list[tuple], n_features: int, p: Params, levels: list[int], n_bins: int) -> list[list[list[tuple | None]]]:
        """``levels_below`` for the nodes of all tasks' ``rows``, ``levels`` of each;
        every task gets all rows of its share of the nodes."""
        parts = []
        for r in range(self.size):
            own = rows[r::self.size]
            parts.append(b"".join([np.array([len(x[1]) for x in own], np.int64).tobytes(), *[
                np.ascontiguousarray(a).tobytes() for x in own for a in x]]))
        ends = np.cumsum([len(x) for x in parts])
        self.put(b"".join([ends.astype(np.int64).tobytes(), *parts]))
        mine = range(self.rank, len(rows), self.size)

        def share(f) -> list[tuple]:
            ends = [0, *np.frombuffer(f.read(8 * self.size), np.int64).tolist()]
            f.seek(8 * self.size + ends[self.rank])
            raw = f.read(ends[self.rank + 1] - ends[self.rank])
            out, at = [], 8 * len(mine)
            for n in np.frombuffer(raw, np.int64, len(mine)).tolist():
                out.append((np.frombuffer(raw, np.uint8, n_features * n, at).reshape(n_features, n),
                            *[np.frombuffer(raw, np.float64, n, at + n_features * n + i * 8 * n) for i in range(2)]))
                at += (n_features + 16) * n
            return out

        got = list(self.get(share))
        whole = [tuple(np.concatenate(x, axis=-1) for x in zip(*node)) for node in zip(*got)]
        found = {}
        for depth in sorted({levels[i] for i in mine}):
            some = [k for k, i in enumerate(mine) if levels[i] == depth]
            found |= dict(zip([mine[k] for k in some], levels_below([whole[k] for k in some], p, depth, n_bins)))
        self.put(json.dumps(found).encode())
        all_found = {int(i): x for raw in self.get() for i, x in json.loads(raw).items()}
        return [all_found[i] for i in range(len(rows))]

    def splits(self, sums: dict[int, np.ndarray], p: Params) -> dict[int, tuple]:
        """Per model the sums of its first node (None where ``added`` has none) and all its nodes' splits."""
        whole, found = self.added(np.concatenate(list(sums.values())) if len(sums) > 1 else [*sums.values()][0], p)
        out, at = {}, 0
        for m, s in sums.items():
            out[m] = None if whole is None else whole[at], found[at:at + len(s)]
            at += len(s)
        return out

    def totals(self, x: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        return dict(zip(x, self.total(np.array(list(x.values()))))) if x else {}


def _slots(spark) -> int:
    """Tasks that can run at once; 0 where that is not settled or tasks cannot
    write to the shared folder."""
    conf = spark.sparkContext.getConf()
    if conf.get("spark.dynamicAllocation.enabled", "false") == "true" or conf.get("spark.default.parallelism"):
        return 0
    try:
        pafs.FileSystem.from_uri(scratch_dir(spark, "boosting"))
    except (OSError, ValueError, NotImplementedError):      # no such store for tasks
        return 0
    return spark.sparkContext.defaultParallelism // int(conf.get("spark.task.cpus", "1"))


@dataclass
class Plan:
    """How the tasks of one barrier stage share the work, from numbers that all of them know."""
    tasks: int
    rows: int
    p: Params
    n_features: int
    n_bins: int

    def owned(self, nodes: int, levels: int) -> bool:
        """Whether all that is below a level's nodes is found by the tasks that get
        their rows: these are fewer bytes than the sums of the ``levels`` to come."""
        rows, sums = self.rows * (self.n_features + 16), self.tasks * self.n_features * self.n_bins * 12
        return nodes >= 2 * self.tasks and rows <= TOGETHER and 2 * rows < sums * nodes * (2 ** min(levels, 40) - 1)

    def together(self, models: int) -> int:
        """Models that go through the same steps: as many as a task has room for."""
        most = next((2 ** level for level in range(self.p.depth) if self.owned(2 ** level, self.p.depth - level)), 2 ** min(self.p.depth - 1, 40))
        rows = -(-self.rows // self.tasks) * (2 * self.n_features + 60)
        return max(1, min(models, TOGETHER // (rows + 4 * most * self.n_features * self.n_bins * 24 + 1)))


def _fit_gang(packed: DataFrame, fits: list[Fit], p: Params, n_features: int, n_bins: int, tasks: int, rows: int) -> list[Fit]:
    """All rounds in one barrier stage over shares of the rows, several models at once."""
    folder = scratch_dir(packed.sparkSession, f"boosting-{uuid.uuid4().hex}")
    plan = Plan(tasks, rows, p, n_features, n_bins)
    some = plan.together(len(fits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, task = Block(_rows(batches), n_features, 1), BarrierTaskContext.get()
        rank = task.partitionId()
        # a stage that is run again has files of its own
        gang = Gang(f"{folder}/{task.allGather(uuid.uuid4().hex)[0]}", rank, tasks)
        for first in range(0, len(fits), some):
            now = fits[first:first + some]
            block.begin(len(now))
            level: dict[int, int] = {}
            ahead: dict[int, list] = {}         # model -> splits of the levels that are known by now

            def splits_of(trees: dict[int, Tree]) -> dict[int, tuple]:
                for i in trees:
                    level[i] = 0 if now[i].frontier == [0] else level[i] + 1
                    if level[i] == 0:
                        ahead.pop(i, None)
                own = [i for i in trees if i not in ahead and plan.owned(len(now[i].frontier), p.depth - level[i])]
                if own:
                    rows = [block.frontier_rows(i, now[i], trees[i], p) for i in own]
                    found = iter(gang.below([x for r in rows for x in r], n_features, p,
                                            [p.depth - level[i] for i, r in zip(own, rows) for _ in r], n_bins))
                    for i, r in zip(own, rows):
                        nodes = [next(found) for _ in r]
                        ahead[i] = [[s for x in nodes if len(x) > k for s in x[k]] for k in range(p.depth - level[i])]
                rest = {i: block.sums(i, now[i], t, p, n_bins) for i, t in trees.items() if i not in ahead}
                return {i: (None, ahead[i].pop(0)) for i in trees if i in ahead} | (gang.splits(rest, p) if rest else {})

            _rounds(now, p, None, lambda at_work: gang.totals({i: block.losses(i, now[i]) for i in at_work}),
                    lambda i, tree: block.add(i, now[i], tree, p),
                    splits_of)
            if rank == 0:
                yield pa.RecordBatch.from_arrays([pa.array(range(first, first + len(now)), pa.int32()),
                                                  pa.array([json.dumps(asdict(fit)) for fit in now])], ["model", "fit"])

    done = {r["model"]: json.loads(r["fit"])
            for r in packed.repartition(tasks).mapInArrow(run, "model int, fit string", barrier=True).collect()}
    return [_restored(done[m]) for m in range(len(fits))]


def _fit_spread(blocks: DataFrame, fits: list[Fit], p: Params, n_features: int, n_bins: int) -> list[Fit]:
    """One aggregate per level over all blocks and models."""
    spark, n_models = blocks.sparkSession, len(fits)
    held = {"blocks": blocks.persist(), "pending": []}

    def block_of(rows: list[dict], pending: list) -> Block:
        block = Block(rows, n_features, n_models)
        for m, tree in pending:
            block.add(m, fits_now[m], tree, p)
        return block

    fits_now = fits

    def collected(work) -> DataFrame:
        """Adds up (model, cell, three whole numbers) of all tasks."""
        pending, now = list(held["pending"]), fits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = Block(_rows(batches), n_features, n_models)
            for m, tree in pending:
                block.add(m, now[m], tree, p)
            for m, cells in work(block):
                flat = cells.reshape(-1, cells.shape[-1])
                some = np.nonzero(flat.any(axis=1))[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), m, np.int32)), pa.array(some),
                                                  *[pa.array(flat[some, c].astype(np.int64)) for c in range(3)]],
                                                 ["model", "cell", "g", "h", "n"])

        return held["blocks"].mapInArrow(run, "model int, cell long, g long, h long, n long") \
            .groupBy("model", "cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toPandas()

    def sums_of(trees: dict[int, Tree]) -> dict[int, np.ndarray]:
        now = fits
        got = collected(lambda block: ((m, block.sums(m, now[m], t, p, n_bins)) for m, t in trees.items()))
        out = {}
        for m in trees:
            s = np.zeros((len(fits[m].frontier) * n_features * n_bins, 3), np.int64)
            mine = got[got["model"] == m]
            s[mine["cell"].to_numpy()] = mine[["g", "h", "n"]].to_numpy()
            out[m] = s.reshape(-1, n_features, n_bins, 3)
        return out

    def losses_of(at_work: list[int]) -> dict[int, np.ndarray]:
        now = fits
        got = collected(lambda block: ((m, np.pad(block.losses(m, now[m]), ((0, 0), (0, 1)))) for m in at_work))
        out = {m: np.zeros((2, 2), np.int64) for m in at_work}
        for r in got.itertuples():
            out[r.model][r.cell] = r.g, r.h
        return out

    def add(m: int, tree: Tree) -> None:
        held["pending"].append((m, tree))
        if len(held["pending"]) >= RENEW * max(1, sum(not f.done for f in fits)):
            pending, now = held["pending"], fits

            def renew(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for r in b.to_pylist():
                        block = Block([r], n_features, n_models)
                        for i, t in pending:
                            block.add(i, now[i], t, p)
                        yield pa.RecordBatch.from_pylist([{**r, "score": block.score.tobytes()}], schema=b.schema)

            path = scratch_dir(spark, f"boosting-{id(fits)}-{len(fits[m].trees)}-{m}")
            held["blocks"].mapInArrow(renew, PACKED).write.mode("overwrite").parquet(path)
            held["blocks"].unpersist()
            held["blocks"], held["pending"] = spark.read.schema(PACKED).parquet(path).persist(), []

    _rounds(fits, p, sums_of, losses_of, add)
    held["blocks"].unpersist()
    return fits


# --- binning ---------------------------------------------------------------------------------------
def _clean(c: str) -> Column:
    return F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))


def _edges(df: DataFrame, features: list[str], bins: int) -> dict[str, list[float]]:
    """Upper ends of all bins but the last, ascending; no values: none."""
    at = [i / (bins - 1) for i in range(1, bins - 1)]
    row = df.agg(*[F.percentile_approx(_clean(c), at, 10_000).alias(f"e{i}") for i, c in enumerate(features)]).first()
    return {c: sorted(set(row[f"e{i}"] or [])) for i, c in enumerate(features)}


def binned(values: list[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    """(features, rows) bins: 0 missing, k the k-th from below (from 1)."""
    return np.array([np.where(np.isnan(x), 0, 1 + np.searchsorted(e, x, "left")) for x, e in zip(values, edges)], np.uint8) \
        .reshape(len(values), -1)


def pack(df: DataFrame, features: list[str], edges: dict, label: str, fold: Column, held: Column) -> DataFrame:
    """Packed rows: bins by feature, label, fold (255: none) and held-out mark."""
    cuts = [np.array(edges[c], float) for c in features]
    k = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = [b.column(j).to_numpy(zero_copy_only=False).astype(float) for j in range(k)]
            y, f, h = (b.column(k + j).to_numpy(zero_copy_only=False).astype(np.uint8).tobytes() for j in range(3))
            yield pa.RecordBatch.from_arrays([pa.array([len(b)], pa.int32()), *[pa.array([v], pa.binary()) for v in
                                              (binned(x, cuts).tobytes(), y, f, h, b"")]],
                                             ["n", "bins", "y", "fold", "held", "score"])

    return df.select(*[_clean(c).alias(f"x{i}") for i, c in enumerate(features)], F.col(label).cast("double").alias("y"),
                     fold.cast("int").alias("fold"), held.cast("int").alias("held")).mapInArrow(run, PACKED)


# --- models ------------------------------------------------------------------------------------------
class BoostedTrees:
    """A fitted ensemble: feature names, bin edges, trees and losses per round."""

    def __init__(self, family: str, features: list[str], edges: dict, base: float, kind: str, trees: list[Tree],
                 train_loss: list[float] = (), held_loss: list[float] = ()):
        self.family, self.features, self.edges, self.base, self.kind, self.trees = family, list(features), edges, base, kind, trees
        self.train_loss, self.held_loss = list(train_loss), list(held_loss)

    def margin(self, columns: list[np.ndarray]) -> np.ndarray:
        bins = binned(columns, [np.array(self.edges[c], float) for c in self.features])
        total = np.full(bins.shape[1], self.base)
        for t in self.trees:
            total += t.score(bins)
        if self.kind == "samme":       # twice the vote, normalized by all weights
            total *= 2.0 / (sum(abs(t.value[0]) for t in self.trees) or 1.0)
        return total

    def margin_column(self) -> Column:
        """The margin of a row as a column (Arrow batches, no shuffle)."""
        if not self.trees:
            return F.lit(self.base if self.kind == "newton" else 0.0)
        model = self

        @F.pandas_udf("double")
        def margin(x: pd.DataFrame) -> pd.Series:
            return pd.Series(model.margin([x[c].to_numpy(float) for c in x.columns]))

        return margin(F.struct(*[_clean(c).alias(f"x{i}") for i, c in enumerate(self.features)]))

    def score(self, df: DataFrame, keep=("id", "label")) -> DataFrame:
        cols = [c for c in keep if c in df.columns]
        p1 = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_m")))
        return df.select(*cols, self.margin_column().alias("_m")).select(
            *cols, (F.col("_m") > 0).cast("int").alias("prediction"), p1.alias("p1"),
            F.greatest(p1, F.lit(1.0) - p1).alias("confidence"))

    def importances(self) -> list[tuple[str, float]]:
        """Gain per feature as a share of all gain (AdaBoost: vote weight)."""
        total = dict.fromkeys(self.features, 0.0)
        for t in self.trees:
            for f, g in zip(t.feature, t.gain):
                if f >= 0:
                    total[self.features[f]] += abs(t.value[0]) if self.kind == "samme" else g
        whole = sum(total.values()) or 1.0
        return [(c, v / whole) for c, v in total.items()]

    def as_dict(self) -> dict:
        return {**{k: getattr(self, k) for k in ("family", "features", "edges", "base", "kind", "train_loss", "held_loss")},
                "trees": [asdict(t) for t in self.trees]}

    @classmethod
    def from_dict(cls, d: dict) -> BoostedTrees:
        return cls(**{**d, "trees": [Tree(**t) for t in d["trees"]]})


def fit(df: DataFrame, features: list[str], family: str, p: Params, label: str = "label", balanced: bool = False,
        folds: tuple[str, int] | None = None, held: Column | None = None, block: int | None = None) -> list[BoostedTrees]:
    """One model, or with ``folds`` = (column, k) one for each fold left out.

    Labels are 0 and 1; rows without a label leave.  Features without values leave
    by name.  ``held`` marks rows that are no training rows but show the loss."""
    block = block or BLOCK
    fold = F.lit(255) if folds is None else F.coalesce(F.col(folds[0]).cast("int"), F.lit(255))
    held = F.lit(False) if held is None else F.coalesce(held, F.lit(False))
    df = df.where(F.col(label).isNotNull())
    counts = [(r["f"], r["y"], r["n"]) for r in df.where(~held).groupBy(fold.alias("f"), F.col(label).cast("int").alias("y"))
              .agg(F.count(F.lit(1)).alias("n")).collect()]
    edges = _edges(df, features, p.bins)
    feats = [c for c in features if edges[c]]
    n_bins = 2 + max((len(edges[c]) for c in feats), default=0)
    fits = []
    for out in [None] if folds is None else range(folds[1]):
        n = [sum(k for f, y, k in counts if y == c and f != out) for c in (0, 1)]
        w = tuple(sum(n) / (2 * k) if balanced and min(n) else 1.0 for k in n)
        prior = math.log(n[1] * w[1] / (n[0] * w[0])) if min(n) else (math.inf if n[1] else -math.inf if n[0] else 0.0)
        base = 0.0 if p.kind == "samme" else max(-20.0, min(20.0, prior))
        fits.append(Fit(out, base, w, done=not min(n) or not feats))
    packed = pack(df, feats, edges, label, fold, held)
    rows = sum(n for _, _, n in counts)
    blocks = -(-rows // block)
    tasks = min(_slots(df.sparkSession), -(-rows // min(block, GANG_ROWS)))
    if blocks <= 1:
        done = _fit_beside(packed, fits, p, len(feats), n_bins)
    elif tasks:
        done = _fit_gang(packed, fits, p, len(feats), n_bins, tasks, rows)
    else:
        path = scratch_dir(df.sparkSession, f"packed-{id(fits)}-{family}-{blocks}")
        packed.repartition(blocks).write.mode("overwrite").parquet(path)
        done = _fit_spread(df.sparkSession.read.schema(PACKED).parquet(path), fits, p, len(feats), n_bins)
    out = []
    for f in done:
        best = int(np.argmin(f.held_loss)) if f.held_loss else len(f.trees)     # losses[r]: after r trees
        out.append(BoostedTrees(family, feats, {c: edges[c] for c in feats}, f.base, p.kind, f.trees[:best], f.train_loss, f.held_loss))
    return out
