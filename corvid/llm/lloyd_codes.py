"""Vector code compression (operator 12): member-resident Lloyd.

Every vector is cut into PARTS consecutive parts, and each part position has a
codebook.  The parts lie in the shared folder as rows that are partitioned by
(position, entry, salt): an owner holds the members of an entry, or a salted
share of a large one.  Each round an owner sums its resident members, which
gives the new entries, and then finds the members that are now nearer to another
entry.  Only these go through the shuffle, to the owner of their new entry; the
others stay in the files where they lie.  All arithmetic is on whole numbers,
floor(SCALE * x), so sums and ties do not depend on the layout.

What reaches the driver is bounded by the codebooks: ENTRIES vectors per vector
length, their sums and counts.  An entry of more than MEMBERS parts is dealt out
over owners by a hash of the row, so copies of one vector share no task.

Vectors of another length have codebooks of their own (position i of a length d
starts at component floor(i * d / PARTS), which gives equal parts where d can be
divided).

Edge cases: rows whose vector is null or holds null or non-finite components are
dropped; of rows that share a vec_id the smallest vector starts a codebook, and
a null vec_id counts as one id behind all others; with fewer ids than ENTRIES
the codebook has fewer entries; repeated rows are rows of their own; rows with a
null label share a label_error; a sum beyond a long is null; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.common import materialise, shared_path, shuffle_parts

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
MEMBERS = 1024             # parts of one entry that share an owner
CHUNK = 4096               # parts that are compared with a codebook at once
_STATE = "rid long, vec_id long, label string, dim int, pos int, entry int, part array<double>"
#: Whole numbers are worked on as doubles while all results stay below this.
_EXACT = 2.0 ** 52


def cuts(dim: int) -> list[int]:
    return [i * dim // PARTS for i in range(PARTS + 1)]


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """Doubles that hold whole numbers, as Python integers where squared
    distances would not be exact."""
    top = float(np.abs(x).max(initial=0.0))
    return x if x.dtype == object or top * top * 4 * max(1, x.shape[1]) < _EXACT else np.array([[int(c) for c in r] for r in x], object).reshape(x.shape)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, the lower if equal; squared distance), exactly."""
    x, book = whole_numbers(x), whole_numbers(book)
    if x.dtype != object and book.dtype != object:
        far = (book * book).sum(axis=1) - 2.0 * (x @ book.T)
        at = far.argmin(axis=1)
        return at, far[np.arange(len(x)), at] + (x * x).sum(axis=1)
    x, book = x.astype(object), book.astype(object)
    far = np.stack([((x - c) ** 2).sum(axis=1) for c in book], axis=1) if x.shape[1] else np.zeros((len(x), len(book)), object)
    at = np.array([min(range(len(book)), key=row.__getitem__) for row in far], np.int64)
    return at, far[np.arange(len(x)), at]


def _ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False), offsets


def clean(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(rid, vec_id, label, v): rows that take part, scaled to whole numbers,
    written once, so that a row number stands for a row from then on."""
    v = F.col("v")
    good = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                       F.col(vec_col).cast("array<double>").alias("v")) \
        .filter(v.isNotNull()) \
        .filter(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))) \
        .select(F.monotonically_increasing_id().alias("rid"), "vec_id", "label", v)

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = _ragged(batch.column(3))
            part = pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), pa.array(np.floor(SCALE * x[at[0]:at[-1]]) + 0.0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], part], ["rid", "vec_id", "label", "v"])

    return materialise(good.mapInArrow(scaled, "rid long, vec_id long, label string, v array<double>"), "code-vectors")


def first_books(rows: DataFrame, entries: int = ENTRIES) -> dict[tuple[int, int], np.ndarray]:
    """(length, position) -> the parts of the ``entries`` smallest ids."""
    out = {}
    for r in rows.select(F.size("v").alias("d")).distinct().orderBy("d").collect():
        of_dim = rows.filter(F.size("v") == r["d"])
        ids = of_dim.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries)
        ids = of_dim.sparkSession.createDataFrame(ids.collect(), "id long")
        start = of_dim.join(F.broadcast(ids), F.col("vec_id").eqNullSafe(F.col("id"))).groupBy("id").agg(F.min("v").alias("v")) \
            .orderBy(F.col("id").asc_nulls_last()).collect()
        v, c = np.array([x["v"] for x in start], float).reshape(len(start), -1), cuts(r["d"])
        for p in range(PARTS):
            out[r["d"], p] = v[:, c[p]:c[p + 1]]
    return out


def _cut_rows(rows: DataFrame, books: dict) -> DataFrame:
    """The parts of all rows with their first entry; id and label ride with position 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = _ragged(batch.column(3))
            size = np.diff(at)
            for d in np.unique(size).tolist():
                of = np.nonzero(size == d)[0]
                v = x[at[of][:, None] + np.arange(d)]
                c = cuts(d)
                for p in range(PARTS):
                    part = v[:, c[p]:c[p + 1]]
                    known = [batch.column(i).take(pa.array(of)) if p == 0 or not i else pa.nulls(len(of), batch.column(i).type)
                             for i in range(3)]
                    yield _state(known, d, p, _assign(part, books[d, p])[0], part)

    return rows.mapInArrow(run, _STATE)


def _assign(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, list]:
    entry, far = np.zeros(len(part), np.int32), []
    for a in range(0, len(part), CHUNK):
        at, d = nearest(part[a:a + CHUNK], book)
        entry[a:a + CHUNK] = at
        far += d.tolist()
    return entry, far


def _state(known: list, d: int, p: int, entry: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    n, w = part.shape
    cols = [*known, pa.array([d] * n, pa.int32()), pa.array([p] * n, pa.int32()), pa.array(entry, pa.int32()),
            pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * w), pa.array(part.ravel()))]
    return pa.RecordBatch.from_arrays(cols, ["rid", "vec_id", "label", "dim", "pos", "entry", "part"])


def _spaces(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(length, position, row numbers, parts) inside a batch of state rows."""
    d, p = batch.column("dim").to_numpy(), batch.column("pos").to_numpy()
    x, at = _ragged(batch.column("part"))
    for key in np.unique(d.astype(np.int64) * PARTS + p).tolist():
        of = np.nonzero((d == key // PARTS) & (p == key % PARTS))[0]
        c = cuts(key // PARTS)
        yield key // PARTS, key % PARTS, of, x[at[of][:, None] + np.arange(c[key % PARTS + 1] - c[key % PARTS])]


def _salts(state: DataFrame) -> DataFrame:
    """Owners per (dim, pos, entry): at most MEMBERS parts each on average."""
    counts = state.groupBy("dim", "pos", "entry").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("dim", "pos", "entry", F.ceil(F.col("n") / MEMBERS).alias("salts")).filter("salts > 1")


def _place(state: DataFrame, salts: DataFrame) -> DataFrame:
    """Rows to their owners.  ``salts`` has a row only for entries of many
    members, at most the codebooks' entries."""
    salt = F.pmod(F.xxhash64("rid"), F.coalesce("salts", F.lit(1)))
    return state.join(F.broadcast(salts), ["dim", "pos", "entry"], "left").withColumn("salt", salt) \
        .repartition(shuffle_parts(state.sparkSession), "dim", "pos", "entry", "salt") \
        .select("rid", "vec_id", "label", "dim", "pos", "entry", "part")


def _updated(state: DataFrame, books: dict) -> dict:
    """New entries from the resident members: componentwise floor(sum / count);
    unused entries stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], list] = {}
        for batch in batches:
            entry = batch.column("entry").to_numpy()
            for d, p, of, part in _spaces(batch):
                part = whole_numbers(part)
                order = np.argsort(entry[of], kind="stable")
                mine = entry[of][order]
                starts = np.nonzero(np.append(True, mine[1:] != mine[:-1]))[0]
                sums = np.add.reduceat(part[order], starts, axis=0) if part.shape[1] else np.zeros((len(starts), 0))
                for e, n, s in zip(mine[starts].tolist(), np.diff(np.append(starts, len(mine))).tolist(), sums.tolist()):
                    now = held.setdefault((d, p, e), [0, [0] * len(s)])
                    now[0] += n
                    now[1] = [a + int(b) for a, b in zip(now[1], s)]
        if held:
            d, p, e = zip(*held)
            yield pa.RecordBatch.from_arrays(
                [pa.array(d, pa.int32()), pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array([h[0] for h in held.values()]),
                 pa.array([[str(x) for x in h[1]] for h in held.values()], pa.list_(pa.string()))],
                ["dim", "pos", "entry", "n", "sums"])

    kinds = "dim int, pos int, entry int, n long, sums array<string>"

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        """Sums of an entry's owners: one row per task that holds some of it."""
        sums = [list(map(int, s)) for s in rows["sums"].to_pylist()]
        total = [str(sum(c)) for c in zip(*sums)]
        return pa.table({"dim": rows["dim"].slice(0, 1), "pos": rows["pos"].slice(0, 1), "entry": rows["entry"].slice(0, 1),
                         "n": pa.array([sum(rows["n"].to_pylist())]), "sums": pa.array([total], pa.list_(pa.string()))})

    out = {k: [[int(x) for x in e] for e in b.tolist()] for k, b in books.items()}
    found = state.mapInArrow(run, kinds).groupBy("dim", "pos", "entry").applyInArrow(merge, kinds)
    for r in found.collect():                   # at most the codebooks' entries
        out[r["dim"], r["pos"]][r["entry"]] = [int(s) // r["n"] for s in r["sums"]]
    return {k: _book(b) for k, b in out.items()}


def _book(entries: list[list[int]]) -> np.ndarray:
    """A codebook as doubles, or as Python integers where doubles are not exact."""
    exact = all(abs(x) < 2 ** 53 for e in entries for x in e)
    return np.array(entries, float if exact else object).reshape(len(entries), -1)


def _moved(state: DataFrame, books: dict) -> DataFrame:
    """State rows with their new entry; ``moved`` where it is another one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column("entry").to_numpy()
            new = old.copy()
            for d, p, of, part in _spaces(batch):
                new[of] = _assign(part, books[d, p])[0]
            cols = {c: batch.column(c) for c in batch.schema.names} | {"entry": pa.array(new, pa.int32())}
            yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(new != old)], [*cols, "moved"])

    return state.mapInArrow(run, _STATE + ", moved boolean")


def _coded(state: DataFrame, books: dict) -> DataFrame:
    """(rid, vec_id, label, dim, code, error): the parts' last assignment, put together by row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            entry, far = np.zeros(n, np.int64), [0] * n
            for d, p, of, part in _spaces(batch):
                entry[of], some = _assign(part, books[d, p])
                for i, x in zip(of.tolist(), some):
                    far[i] = int(x)
            shift = (PARTS - 1 - batch.column("pos").to_numpy()).astype(np.int64) * 8
            far = [str(x) for x in far]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3),
                                              pa.array(entry << shift), pa.array(far, pa.string())],
                                             ["rid", "vec_id", "label", "dim", "code", "far"])

    parts = state.mapInArrow(run, "rid long, vec_id long, label string, dim int, code long, far string")
    far = F.expr("try_cast(far AS decimal(38,0))")
    # a squared distance beyond 38 digits has no place in a long either
    return parts.groupBy("rid").agg(
        F.max("vec_id").alias("vec_id"), F.max("label").alias("label"), F.max("dim").alias("dim"),
        F.lower(F.lpad(F.hex(F.sum("code")), 2 * PARTS, "0")).alias("code"),
        F.when(F.count(far) == F.count(F.lit(1)), F.sum(far)).alias("error"))


def digest(books: dict, dim: int) -> str:
    """sha256 of all entries' components by part, entry and place, as decimals."""
    numbers = [str(int(x)) for p in range(PARTS) for x in books[dim, p].ravel().tolist()]
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def train(rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, dict]:
    """(state, codebooks) after ``rounds`` rounds; rows is a ``clean`` table."""
    spark: SparkSession = rows.sparkSession
    books = first_books(rows, entries)
    first = materialise(_cut_rows(rows, books), "first-parts")
    salts = _salts(first)
    state = materialise(_place(first, salts), "resident-parts")
    for i in range(rounds):
        books = _updated(state, books)
        if i == rounds - 1:
            return state, books
        path = shared_path(spark, "parts-of-round")
        _moved(state, books).write.partitionBy("moved").parquet(path)
        now = spark.read.schema(_STATE + ", moved boolean").parquet(path)
        movers = now.filter("moved").drop("moved")
        arrived = materialise(_place(movers, _salts(now)), "arrived-parts")
        state = now.filter("NOT moved").drop("moved").unionByName(arrived)
    return state, books


def codes(embeddings: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id",
          vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per kept row its code, squared error, the error of its label and the
    digest of the codebooks of its length."""
    spark = embeddings.sparkSession
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits for each part")
    rows = clean(embeddings, id_col, vec_col, label_col)
    state, books = train(rows, entries, rounds)
    done = materialise(_coded(state, books), "vector-codes")
    per_label = done.groupBy("label").agg(F.when(F.count("error") == F.count(F.lit(1)), F.sum("error")).alias("label_error"))
    per_label = materialise(per_label.withColumnRenamed("label", "of_label"), "label-errors")
    sha = spark.createDataFrame([(d, digest(books, d)) for d in sorted({d for d, _ in books})], "dim int, codebooks_sha256 string")
    return done.join(per_label, F.col("label").eqNullSafe(F.col("of_label"))).join(F.broadcast(sha), "dim") \
        .select("vec_id", "code", F.expr("try_cast(error AS bigint)").alias("error"),
                F.expr("try_cast(label_error AS bigint)").alias("label_error"), "codebooks_sha256")


def oracle(entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB SQL of ``codes`` over the table embeddings (ids unique, one length)."""
    steps = [f"""
kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE}.0::DOUBLE * x::DOUBLE)::BIGINT) AS v, len(embedding) // {PARTS} AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (
  SELECT vec_id, i // w AS p, i % w AS j, c FROM (SELECT vec_id, w, unnest(range(len(v))) AS i, unnest(v) AS c FROM kept)),
first_ids AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {entries}),
book0 AS MATERIALIZED (SELECT p, e, j, c FROM x JOIN first_ids USING (vec_id))"""]
    for r in range(rounds + 1):
        steps.append(f"""
far{r} AS (
  SELECT x.vec_id, x.p, b.e, sum((x.c - b.c) * (x.c - b.c))::BIGINT AS d
  FROM x JOIN book{r} b ON b.p = x.p AND b.j = x.j GROUP BY x.vec_id, x.p, b.e),
near{r} AS MATERIALIZED (
  SELECT vec_id, p, min(d) AS d, arg_min(e, (d, e)) AS e FROM far{r} GROUP BY vec_id, p)""")
        if r < rounds:
            steps.append(f"""
sums{r} AS (
  SELECT x.p, n.e, x.j, sum(x.c) AS s, count(*) AS n FROM x JOIN near{r} n ON n.vec_id = x.vec_id AND n.p = x.p GROUP BY x.p, n.e, x.j),
book{r + 1} AS MATERIALIZED (
  SELECT b.p, b.e, b.j, CASE WHEN s.n IS NULL THEN b.c ELSE ((s.s - (((s.s % s.n) + s.n) % s.n)) // s.n)::BIGINT END AS c
  FROM book{r} b LEFT JOIN sums{r} s ON s.p = b.p AND s.e = b.e AND s.j = b.j)""")
    return "WITH " + ",".join(steps) + f""",
coded AS (
  SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id),
labelled AS (SELECT c.*, k.label FROM coded c JOIN kept k USING (vec_id))
SELECT vec_id, code, error,
       (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, j)) FROM book{rounds}) AS codebooks_sha256
FROM labelled
"""
