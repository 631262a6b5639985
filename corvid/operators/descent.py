"""Quasi-Newton fits of the margin classifier and the neural network (J9, J10): all
iterations in one barrier stage.

Each task keeps its share of the prepared rows in memory and adds up loss and gradient
of its rows; the sums go round through files of the shared folder (``boosting.Gang``),
so what a task reads depends on the model's size, not on the rows, and an iteration
costs no Spark job.  A line search of the margin classifier adds up two numbers a step
and makes no new pass over the columns.  Every task then takes the same step.  Objectives, stopping rules and
line searches are those of ``LinearSVC`` and ``MultilayerPerceptronClassifier`` of
``pyspark.ml`` (Breeze's OWLQN and L-BFGS with a history of ten), so a fit has their
result up to rounding.

Random Fourier features are made from the rows beside them: the waves of a task's first
rows are kept (up to KEEP bytes), those of the others are made anew in every pass, so the
memory of a task does not grow by a row's 128 waves.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame

from corvid.operators.boosting import Gang
from corvid.session import scratch_dir

CHUNK = 1024               # rows of one matrix product
KEEP = 1 << 29             # bytes of waves that a task keeps
FEW = 1 << 14              # cosines that are made at once, so that they stay in the processor's cache
STACK = 128                # rows of a block of the neural network
HISTORY = 10


# --- optimizers --------------------------------------------------------------------------------
class Failed(ArithmeticError):
    """A line search without a step, or a history without a direction."""


def _direction(grad: np.ndarray, steps: list, deltas: list) -> np.ndarray:
    """Minus the approximate inverse Hessian times the gradient; newest pairs first."""
    d, a, rho = grad.copy(), [], [float(s @ y) for s, y in zip(steps, deltas)]
    scale = 1.0
    if steps:
        if not rho[0] >= 0:
            raise Failed("history")
        scale = rho[0] / float(deltas[0] @ deltas[0]) if deltas[0].any() else math.nan
    for s, y, r in zip(steps, deltas, rho):
        a.append(float(s @ d) / r if r else math.nan)
        if math.isnan(a[-1]):
            raise Failed("history")
        d -= a[-1] * y
    d *= scale
    for s, y, r, x in reversed(list(zip(steps, deltas, rho, a))):
        d += (x - float(y @ d) / r) * s
    return -d


def _backtracked(phi: Callable, init: float, shrink: float) -> float:
    """A step by shrinking and growing until the strong Wolfe conditions hold; the first
    one counts as no better than none (as in Breeze), so it is mostly not tried."""
    t, (f0, slope0) = init, phi(0.0)
    f, slope = f0, None
    for i in range(20):
        if slope is None and not f > f0 + t * slope0 * 1e-4:
            slope = phi(t)[1]
        if f > f0 + t * slope0 * 1e-4:
            times = shrink
        elif slope < 0.9 * slope0:
            times = 2.1
        elif slope > -0.9 * slope0:
            times = shrink
        else:
            return t
        last, t = t, t * times
        if not 1e-10 <= t <= 1e10:
            raise Failed("line search")
        if i < 19:
            f, slope = phi(t)
    return last


def _strong_wolfe(phi: Callable, t: float) -> float:
    """A step by bracketing and cubic interpolation."""
    f0, slope0 = phi(0.0)
    if slope0 > 0:
        raise Failed("direction")

    def between(a: tuple, b: tuple) -> float:
        d1 = a[2] + b[2] - 3 * (a[1] - b[1]) / (a[0] - b[0])
        root = d1 * d1 - a[2] * b[2]
        d2 = math.sqrt(root) if root >= 0 else math.nan
        below = b[2] - a[2] + 2 * d2
        x = b[0] - (b[0] - a[0]) * (b[2] + d2 - d1) / below if below else math.nan
        lo, hi = a[0] + 0.1 * (b[0] - a[0]), a[0] + 0.9 * (b[0] - a[0])
        return lo if x < lo else hi if x > hi else x

    def zoomed(low: tuple, high: tuple) -> float:
        for _ in range(10):
            x = between(high, low) if low[0] > high[0] else between(low, high)
            c = (x, *phi(x))
            if c[1] > f0 + 1e-4 * x * slope0 or c[1] >= low[1]:
                high = c
            else:
                if abs(c[2]) <= 0.9 * abs(slope0):
                    return x
                if c[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise Failed("zoom")

    low = (0.0, f0, slope0)
    for i in range(10):
        c = (t, *phi(t))
        if not math.isfinite(c[1]):
            t /= 2.0
            continue
        if c[1] > f0 + 1e-4 * t * slope0 or (c[1] >= low[1] and i > 0):
            return zoomed(low, c)
        if abs(c[2]) <= 0.9 * abs(slope0):
            return t
        if c[2] >= 0:
            return zoomed(c, low)
        low = c
        t *= 1.5
    raise Failed("line search")


def minimized(f: Callable, start: np.ndarray, rounds: int, tol: float, along: Callable | None = None) -> tuple[np.ndarray, int]:
    """Where ``f`` (x -> value, gradient) is least, from ``start`` on, and the number of
    iterations: L-BFGS, or with ``along`` OWLQN without an L1 term, as for the margin
    classifier.  ``along(x, d)`` gives a function of (step, point) that returns value and
    slope at the points of a line search from x, the last point given to ``f``."""
    orthants = along is not None
    seen: dict[bytes, tuple] = {}

    def at(x: np.ndarray) -> tuple[float, np.ndarray]:
        name = x.tobytes()
        if name not in seen:
            value = f(x)
            while len(seen) > 1:
                seen.pop(next(iter(seen)))
            seen[name] = value
        return seen[name]

    x = start.astype(float)
    value, grad = at(x)
    first, values, steps, deltas, n, failed = value, [math.inf], [], [], 0, False
    while n < rounds:
        if len(values) >= 2 and abs(value - max(values)) <= tol * abs(first):
            break
        if np.linalg.norm(grad) <= max(tol * abs(value), 1e-8):
            break
        try:
            d = _direction(grad, steps, deltas)
            if orthants:
                d = np.where(d * grad < 0, d, 0.0)
                side = np.where(x != 0, np.sign(x), np.sign(-grad))

            def stepped(t: float) -> np.ndarray:
                y = x + d * t
                return np.where(np.sign(y) == side, y, 0.0) if orthants else y

            go = along(x, d) if orthants else None

            def phi(t: float) -> tuple[float, float]:
                if t == 0.0:
                    return value, float(grad @ d)
                if go:
                    return go(t, stepped(t))
                v, g = at(stepped(t))
                return v, float(g @ d)

            if orthants:
                t = _backtracked(phi, 1.0 if n else 0.5 / float(np.linalg.norm(grad)), 0.5 if n else 0.1)
            else:
                t = _strong_wolfe(phi, 1.0 if n else 1.0 / float(np.linalg.norm(d)))
                if t * float(np.linalg.norm(grad)) < 1e-10:
                    raise Failed("step")
            y = stepped(t)
            new, slope = at(y)
        except Failed:
            if failed:
                break
            failed, steps, deltas = True, [], []
            continue
        failed = False
        steps, deltas = [y - x, *steps][:HISTORY], [slope - grad, *deltas][:HISTORY]
        x, value, grad, n = y, new, slope, n + 1
        values = [*values, value][-20:]
    return x, n


# --- what a task does --------------------------------------------------------------------------
class Share:
    """Rows of one task: (rows, features) numbers, labels and weights."""

    def __init__(self, batches: Iterator[pa.RecordBatch], n_features: int):
        parts = [np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns], axis=1) for b in batches if len(b)]
        rows = np.concatenate(parts) if parts else np.zeros((0, n_features + 2))
        if not np.isfinite(rows).all():
            raise ValueError("a feature, label or weight is not a finite number")
        self.x, self.y, self.w = np.ascontiguousarray(rows[:, :n_features]), rows[:, n_features].copy(), rows[:, n_features + 1].copy()

    def chunks(self) -> Iterator[slice]:
        for at in range(0, len(self.y), CHUNK):
            yield slice(at, min(at + CHUNK, len(self.y)))


# the sine of a quarter turn times x, for x from -1 to 1, by odd powers of x
_SINE = np.polynomial.chebyshev.cheb2poly(np.polynomial.chebyshev.chebinterpolate(lambda x: np.sin(np.pi / 2 * x), 18)[:16])[1::2]


def cosines(turns: np.ndarray, size: float) -> np.ndarray:
    """``size`` times the cosine of whole turns, in place, up to rounding; many times
    faster than a cosine of each number."""
    # cos = sin of a quarter turn less the distance to a whole one
    powers = [float(c) * -size * 4.0 ** (2 * i + 1) for i, c in enumerate(_SINE)]
    flat = turns.reshape(-1)
    for lo in range(0, len(flat), FEW):
        x = flat[lo:lo + FEW]
        u = np.rint(x)
        x -= u
        np.abs(x, out=x)
        x -= 0.25
        np.multiply(x, x, out=u)
        y = u * powers[-1]
        for c in powers[-2:0:-1]:
            y += c
            y *= u
        y += powers[0]
        x *= y
    return turns


class Waves:
    """Columns of a share's rows, mapped by random Fourier features if there are any."""

    def __init__(self, share: Share, waves: np.ndarray | None):
        self.share, self.kept, self.room = share, {}, KEEP
        self.waves = None if waves is None else np.asarray(waves) / (2.0 * math.pi)      # in whole turns

    def of(self, rows: slice, some: np.ndarray | None = None) -> np.ndarray:
        """All columns, or some of them."""
        x = self.share.x[rows]
        if self.waves is None:
            return x if some is None else x[:, some]
        z = self.kept.get(rows.start)
        if z is not None:
            return z if some is None else z[:, some]
        waves = self.waves if some is None else self.waves[some]
        z = x @ waves[:, 1:].T
        z += waves[:, 0]
        cosines(z, math.sqrt(2.0 / len(self.waves)))
        if some is None and z.nbytes <= self.room:
            self.kept[rows.start], self.room = z, self.room - z.nbytes
        return z


def margin_fit(share: Share, waves: np.ndarray | None, rounds: int, tol: float, total: Callable) -> list[float]:
    """Coefficients and intercept of least weighted hinge loss, found on columns of mean 0
    and deviation 1 (columns of one value: coefficient 0)."""
    made, k = Waves(share, waves), len(waves) if waves is not None else share.x.shape[1]
    sums = np.concatenate([[share.w.sum(), (share.w ** 2).sum()], np.zeros(k)])
    for rows in share.chunks():
        sums[2:] += share.w[rows] @ made.of(rows)
    sums = total(sums)
    whole, mean = sums[0], sums[2:] / sums[0]
    spread = np.zeros(k)
    for rows in share.chunks():
        spread += share.w[rows] @ (made.of(rows) - mean) ** 2
    free = whole - sums[1] / whole
    std = np.sqrt(np.maximum(total(spread), 0.0) / free) if free > 0 else np.zeros(k)
    inverse = np.divide(1.0, std, out=np.zeros(k), where=std > 0)
    sign = 2.0 * share.y - 1.0

    margins = np.zeros(len(sign))          # of the last point

    def objective(v: np.ndarray) -> tuple[float, np.ndarray]:
        c, out = v[:k] * inverse, np.zeros(k + 2)
        shift = v[k] - float(c @ mean)
        for rows in share.chunks():
            z, s = made.of(rows), sign[rows]
            margins[rows] = z @ c + shift
            gap = 1.0 - s * margins[rows]
            pull = np.where(gap > 0, -s * share.w[rows], 0.0)
            out[0] += np.maximum(gap, 0.0) @ share.w[rows]
            out[1] += pull.sum()
            out[2:] += pull @ z
        out = total(out) / whole
        return float(out[0]), np.append((out[2:] - out[1] * mean) * inverse, out[1])

    def added(v: np.ndarray, some: np.ndarray | None = None) -> np.ndarray:
        """What ``v``, or some of its coefficients, add to every row's margin."""
        c = v[:k] * inverse if some is None else v[some] * inverse[some]
        shift, out = v[k] - float(c @ (mean if some is None else mean[some])), np.empty(len(sign))
        for rows in share.chunks():
            out[rows] = made.of(rows, some) @ c
        return out + shift

    def along(x: np.ndarray, d: np.ndarray) -> Callable:
        # margins change in proportion to the step, but for numbers held at 0
        climb = added(d)

        def at(t: float, y: np.ndarray) -> tuple[float, float]:
            here, rest = margins + t * climb, np.where(y == 0, x + d * t, 0.0)
            if rest.any():
                here -= added(rest, np.nonzero(rest[:k])[0])
            gap = 1.0 - sign * here
            pull = np.where(gap > 0, -sign * share.w, 0.0)
            out = total(np.array([np.maximum(gap, 0.0) @ share.w, pull @ climb])) / whole
            return float(out[0]), float(out[1])
        return at

    v, _ = minimized(objective, np.zeros(k + 1), rounds, tol, along)
    c = v[:k] * inverse
    return [*c.tolist(), float(v[k] - c @ mean)]


def stacked(rows: DataFrame) -> DataFrame:
    """``rows`` (features, label) with weight one over the rows of their block: STACK of
    a partition one after another, fewer in its last."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            now = [pa.concat_arrays([a, c]) for a, c in zip(held, b.columns)] if held else b.columns
            full = len(now[0]) // STACK * STACK
            yield pa.RecordBatch.from_arrays([*[c[:full] for c in now], pa.array(np.full(full, 1.0 / STACK))], names)
            held = [c[full:] for c in now]
        if held and len(held[0]):
            n = len(held[0])
            yield pa.RecordBatch.from_arrays([*held, pa.array(np.full(n, 1.0 / n))], names)

    names = [*rows.columns, "_w"]
    return rows.mapInArrow(run, ", ".join(f"`{c}` double" for c in names))


def network_fit(share: Share, layers: list[int], start: np.ndarray, rounds: int, tol: float, total: Callable) -> list[float]:
    """Weights of sigmoid layers below a softmax of least cross entropy, a mean of the
    means of blocks (``stacked``)."""
    blocks = round(float(total(np.array([share.w.sum()]))[0]))
    places, at = [], 0
    for a, b in zip(layers, layers[1:]):
        places.append((at, at + a * b, at + a * b + b))
        at += a * b + b
    hot = np.eye(layers[-1])[share.y.astype(int)]

    def objective(v: np.ndarray) -> tuple[float, np.ndarray]:
        out = np.zeros(len(v) + 1)
        tables = [(v[i:j].reshape(a, b), v[j:k]) for (i, j, k), a, b in zip(places, layers, layers[1:])]    # column-major (out, in)
        for rows in share.chunks():
            seen = [share.x[rows]]
            for i, (table, bias) in enumerate(tables):
                z = seen[-1] @ table
                z += bias
                if i + 1 < len(tables):
                    np.negative(z, out=z)
                    with np.errstate(over="ignore"):
                        np.exp(z, out=z)
                    z += 1.0
                    np.reciprocal(z, out=z)
                else:
                    z -= z.max(axis=1, keepdims=True)
                    np.exp(z, out=z)
                    z /= z.sum(axis=1, keepdims=True)
                seen.append(z)
            share_of = share.w[rows]
            with np.errstate(divide="ignore"):
                out[0] -= np.log((seen[-1] * hot[rows]).sum(axis=1)) @ share_of
            delta = (seen[-1] - hot[rows]) * share_of[:, None]
            for i in range(len(tables) - 1, -1, -1):
                lo, mid, hi = places[i]
                out[1 + lo:1 + mid] += (seen[i].T @ delta).ravel()
                out[1 + mid:1 + hi] += delta.sum(axis=0)
                if i:
                    delta = delta @ tables[i][0].T
                    delta *= seen[i] * (1.0 - seen[i])
        out = total(out) / blocks
        return float(out[0]), out[1:]

    v, _ = minimized(objective, start, rounds, tol)
    return v.tolist()


def fitted(rows: DataFrame, n_features: int, tasks: int, fit: Callable) -> list[float]:
    """The numbers that ``fit(share, total)`` returns, from one barrier stage of ``tasks``
    tasks over ``rows`` (features, label, weight); ``total`` adds up arrays of all tasks."""
    folder = scratch_dir(rows.sparkSession, f"descent-{uuid.uuid4().hex}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, task = Share(batches, n_features), BarrierTaskContext.get()
        rank = task.partitionId()
        # a stage that is run again has files of its own
        gang = Gang(f"{folder}/{task.allGather(uuid.uuid4().hex)[0]}", rank, tasks)
        found = fit(share, gang.total)
        if rank == 0:
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(found)])], ["found"])

    return json.loads(rows.repartition(tasks).mapInArrow(run, "found string", barrier=True).collect()[0]["found"])
