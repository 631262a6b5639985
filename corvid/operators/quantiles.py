"""Exact quantiles without a single unbounded aggregation buffer.

``percentile`` / ``median`` are exact but keep every distinct value of a
column in one task's buffer for a global aggregate.  Here the exact order
statistics are found by bracketing:

1. one pass of ``percentile_approx`` (bounded sketch) gives a value bracket
   around each wanted rank, plus counts;
2. one aggregate without grouping counts the rows below and inside every
   bracket; a missed bracket widens;
3. a bracket of more than ``max_collect`` rows is narrowed by a histogram
   (map-side combined ``groupBy(task, bin)``: at most tasks x 1024 rows), any
   other's (value, count) pairs are fetched and the order statistics read off.

Only rows inside a bracket are unpivoted, which after step 1 is a share of about
``4 / accuracy`` of them; all others end at a filter.

Interpolation follows the usual continuous definition: with ``h = (n-1)*q``
the result is ``v[floor(h)] + (h - floor(h)) * (v[ceil(h)] - v[floor(h)])``.
NaN is treated as missing.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

N_BINS = 1024


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                    accuracy: int = 10000, max_collect: int = 200_000, small_n: int = 5000) -> dict:
    """Return {(col, prob): value or None} for every column and probability.

    The three passes share one evaluation of the columns: unless the caller caches
    them they are kept (memory, then disk) until the result is there; what a lost
    executor held is evaluated again."""
    if not cols:
        return {}
    at = {c: i for i, c in enumerate(dict.fromkeys(cols))}
    numbers = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"v{i}")
                          for c, i in at.items()])
    if df.storageLevel.useMemory or df.storageLevel.useDisk:
        return _bracketed(numbers, at, probs, accuracy, max_collect, small_n)
    numbers = numbers.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _bracketed(numbers, at, probs, accuracy, max_collect, small_n)
    finally:
        numbers.unpersist()


def _double(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def _inside(t: dict) -> str:
    return f"v{t['i']} BETWEEN {_double(t['lo'])} AND {_double(t['hi'])}"


def _inside_rows(df: DataFrame, tasks: dict[int, dict], of) -> DataFrame:
    """(task, x) for every value inside the brackets; ``of`` gives x as SQL text."""
    items = ", ".join(f"named_struct('task', {j}, 'x', CASE WHEN {_inside(t)} THEN {of(t)} END)" for j, t in tasks.items())
    return (df.where(" OR ".join(f"({_inside(t)})" for t in tasks.values()))
            .selectExpr(f"inline(filter(array({items}), s -> s.x IS NOT NULL))"))


def _bin(t: dict) -> str:
    lo, hi = float(t["lo"]), float(t["hi"])
    return f"least(CAST(floor((v{t['i']} - {_double(lo)}) / {_double(hi - lo)} * {N_BINS}) AS INT), {N_BINS - 1})"


def _bracketed(df: DataFrame, at: dict[str, int], probs: list[float], accuracy: int, max_collect: int, small_n: int) -> dict:
    probs = [float(p) for p in probs]
    d = 2.0 / accuracy
    brackets = sorted({min(1.0, max(0.0, p + s)) for p in probs for s in (-d, d)})
    aggs = []
    at_probs = ", ".join(f"{p!r}D" for p in brackets)
    for i in at.values():
        aggs += [F.expr(f"count(v{i}) AS n{i}"), F.expr(f"min(v{i}) AS lo{i}"), F.expr(f"max(v{i}) AS hi{i}"),
                 F.expr(f"percentile_approx(v{i}, array({at_probs}), {accuracy}) AS pa{i}")]
    row = df.agg(*aggs).first()

    result: dict = {}
    tasks = []  # dicts: c, p, n, k1, k2, h, lo, hi
    for c, i in at.items():
        n = row[f"n{i}"]
        for p in probs:
            if not n:
                result[(c, p)] = None
                continue
            h = (n - 1) * p
            k1, k2 = int(math.floor(h)), int(math.ceil(h))
            if n <= small_n:          # small column: one fetch of all (value, count) pairs
                lo, hi = row[f"lo{i}"], row[f"hi{i}"]
            else:
                pa = dict(zip(brackets, row[f"pa{i}"]))
                lo = pa[min(1.0, max(0.0, p - d))]
                hi = pa[min(1.0, max(0.0, p + d))]
            tasks.append(dict(c=c, i=i, p=p, n=n, h=h, k1=k1, k2=k2, lo=lo, hi=hi,
                              gmin=row[f"lo{i}"], gmax=row[f"hi{i}"]))
    if not tasks:
        return result

    pending = tasks
    # a bracket that is the whole [min, max] range needs no histogram pass:
    # nothing lies below it and it holds all n values
    for t in pending:
        t["full"] = t["n"] <= small_n and t["lo"] == t["gmin"] and t["hi"] == t["gmax"]

    while pending:          # every pass narrows a bracket, widens a missed one, or reads it off
        # brackets are literals (a handful per column)
        counts = {}
        aggs = []
        for j, t in enumerate(pending):
            if not t["full"]:
                aggs += [F.expr(f"count_if(v{t['i']} < {_double(t['lo'])}) AS below{j}"),
                         F.expr(f"count_if({_inside(t)}) AS inside{j}")]
        if aggs:
            counts = df.agg(*aggs).first().asDict()
        collect_ids, narrow_ids, nxt = [], [], []
        for j, t in enumerate(pending):
            if t["full"]:
                t["below"] = 0
                t["full"] = False
                collect_ids.append(j)
                continue
            t["below"], inside = counts[f"below{j}"], counts[f"inside{j}"]
            if t["k1"] < t["below"]:           # bracket too high: widen down
                t["lo"] = t["gmin"]
                nxt.append(t)
            elif t["k2"] >= t["below"] + inside:  # bracket too low: widen up
                t["hi"] = t["gmax"]
                nxt.append(t)
            elif inside <= max_collect or t["lo"] == t["hi"]:
                collect_ids.append(j)
            else:
                narrow_ids.append(j)
        if narrow_ids:
            per: dict = {}
            for r in _inside_rows(df, {j: pending[j] for j in narrow_ids}, _bin).groupBy("task", "x").agg(F.count(F.lit(1)).alias("cnt")).collect():
                per.setdefault(r["task"], {})[r["x"]] = r["cnt"]
            for j in narrow_ids:                # narrow to the bins holding k1..k2
                t = pending[j]
                run, b1, b2 = t["below"], None, None
                for b in range(N_BINS):
                    cnt = per[j].get(b, 0)
                    if b1 is None and t["k1"] < run + cnt:
                        b1 = b
                    if b2 is None and t["k2"] < run + cnt:
                        b2 = b
                    run += cnt
                w = (t["hi"] - t["lo"]) / N_BINS
                # one bin more on both sides, so that rounding cannot lose the wanted values
                new_lo = max(t["lo"], t["lo"] + (b1 - 1) * w)
                new_hi = min(t["hi"], t["lo"] + (b2 + 2) * w)
                if (new_lo, new_hi) == (t["lo"], t["hi"]):
                    collect_ids.append(j)       # a few neighbouring doubles: few distinct values
                else:
                    t["lo"], t["hi"] = new_lo, new_hi
                    nxt.append(t)
        if collect_ids:
            # tasks with the same (column, bracket) share one fetch
            rep: dict = {}
            for j in collect_ids:
                t = pending[j]
                rep.setdefault((t["c"], float(t["lo"]), float(t["hi"])), j)
            vals = (_inside_rows(df, {j: pending[j] for j in rep.values()}, lambda t: f"v{t['i']}")
                    .groupBy("task", "x").agg(F.count(F.lit(1)).alias("cnt")).collect())
            grouped: dict = {}
            for r in vals:
                grouped.setdefault(r["task"], []).append((r["x"], r["cnt"]))
            for lst in grouped.values():
                lst.sort()
            for j in collect_ids:
                t = pending[j]
                src = rep[(t["c"], float(t["lo"]), float(t["hi"]))]
                run = t["below"]
                v1 = v2 = None
                for v, cnt in grouped.get(src, []):
                    if v1 is None and t["k1"] < run + cnt:
                        v1 = v
                    if v2 is None and t["k2"] < run + cnt:
                        v2 = v
                        break
                    run += cnt
                frac = t["h"] - t["k1"]
                result[(t["c"], t["p"])] = v1 + frac * (v2 - v1) if frac else v1
        pending = nxt
    return result


def exact_median(df: DataFrame, cols: list[str]) -> dict:
    q = exact_quantiles(df, cols, [0.5])
    return {c: q[(c, 0.5)] for c in cols}
