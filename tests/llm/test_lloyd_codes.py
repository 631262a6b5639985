"""Member-resident Lloyd against plain Lloyd on Python integers."""

import hashlib
import math
import random
from collections import Counter, defaultdict

from corvid.llm import lloyd_codes

SCHEMA = "vec_id long, embedding array<double>, label int, dim int, code string, moved int"


def _plain(rows, entries, rounds):
    """(vec_id, code, error, label_error, sha) of (vec_id, vector, label) rows."""
    kept = [(i, v, b) for i, v, b in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ints = [[math.floor(1024 * x) for x in v] for _, v, _ in kept]
    out, errors = [], defaultdict(int)
    by_dim = defaultdict(list)
    for n, v in enumerate(ints):
        by_dim[len(v)].append(n)
    done = {}
    for d, mine in by_dim.items():
        first = {}
        for n in mine:
            key = (kept[n][0] is None, kept[n][0] or 0)
            first[key] = min(first.get(key, ints[n]), ints[n])
        start = [first[k] for k in sorted(first)][:entries]
        code, err, numbers = {n: "" for n in mine}, {n: 0 for n in mine}, []
        for p in range(4):
            a, b = p * d // 4, (p + 1) * d // 4
            book = [v[a:b] for v in start]

            def near(x):
                far = [sum((u - w) ** 2 for u, w in zip(x, c)) for c in book]
                return far.index(min(far)), min(far)

            for _ in range(rounds):
                held = defaultdict(list)
                for n in mine:
                    held[near(ints[n][a:b])[0]].append(ints[n][a:b])
                book = [[sum(c) // len(held[e]) for c in zip(*held[e])] if e in held else book[e] for e in range(len(book))]
            for n in mine:
                e, far = near(ints[n][a:b])
                code[n] += f"{e:02x}"
                err[n] += far
            numbers += [str(x) for c in book for x in c]
        sha = hashlib.sha256(",".join(numbers).encode()).hexdigest()
        done |= {n: (code[n], err[n], sha) for n in mine}
    for n, (_, _, b) in enumerate(kept):
        errors[b] += done[n][1]
    for n, (i, _, b) in enumerate(kept):
        code, err, sha = done[n]
        out.append((i, code, *[x if x < 2 ** 63 else None for x in (err, errors[b])], sha))
    return Counter(out)


def _check(spark, rows, entries=6, rounds=4):
    df = spark.createDataFrame([(i, v, b, 1, "x", 2) for i, v, b in rows], SCHEMA).repartition(3)
    got = lloyd_codes.codes(df, entries, rounds)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == _plain(rows, entries, rounds)


def test_random_vectors(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(rnd.choice([-1, 0, 2]), 0.3) for _ in range(8)], rnd.choice([None, 1, 2])) for i in range(300)]
    _check(spark, rows)


def test_ties_repeats_nulls_lengths(spark):
    rnd = random.Random(6)
    rows = [(i, [rnd.randint(-2, 2) / 1024 for _ in range(8)], i % 3) for i in range(80)]
    rows += [(7, rows[7][1], 1), (7, [0.0] * 8, 1), (None, [0.5] * 8, None), (None, [0.25] * 8, None)]
    rows += [(500, None, 1), (501, [1.0, None] * 4, 1), (502, [float("nan")] * 8, 1), (503, [float("-inf")] * 8, 1)]
    rows += [(600 + i, [rnd.random() for _ in range(6)], 9) for i in range(10)]         # another length, not divisible
    rows += [(700, [], 3), (-1, [0.0] * 8, 4), (-2, [-0.0] * 8, 4)]
    _check(spark, rows)


def test_hot_vector_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(lloyd_codes, "MEMBERS", 8)
    rnd = random.Random(7)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 else [rnd.random() for _ in range(4)], i % 2) for i in range(200)]
    _check(spark, rows, entries=5, rounds=3)


def test_large_components(spark):
    rows = [(i, [x * (-1) ** i for x in (1e9, 3e9 + i, 5.0, 7e8)], 1) for i in range(12)]
    rows += [(100 + i, [1e30 * i, 1.0, 2.0, 3.0], 2) for i in range(3)]
    _check(spark, rows, entries=3, rounds=2)


def test_empty(spark):
    df = spark.createDataFrame([(1, None, 1, 1, "x", 2)], SCHEMA)
    assert lloyd_codes.codes(df).count() == 0 and lloyd_codes.codes(df.limit(0)).count() == 0


def test_only_movers_are_shuffled(spark):
    """After the first placement a round's shuffle holds rows that changed their entry alone."""
    rnd = random.Random(8)
    df = spark.createDataFrame([(i, [rnd.random() for _ in range(8)], 1, 1, "x", 2) for i in range(200)], SCHEMA)
    rows = lloyd_codes.clean(df)
    books = lloyd_codes.first_books(rows, 8)
    state = lloyd_codes._cut_rows(rows, books)
    now = lloyd_codes._moved(state, lloyd_codes._updated(state, books))
    moved = {(r.rid, r.pos) for r in now.filter("moved").collect()}
    before = {(r.rid, r.pos): r.entry for r in state.collect()}
    after = {(r.rid, r.pos): r.entry for r in now.collect()}
    assert 0 < len(moved) < len(before) and moved == {k for k in before if before[k] != after[k]}
