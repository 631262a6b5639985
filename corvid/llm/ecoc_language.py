"""Language identification by error-correcting output codes (operator 7).

Every language has a codeword; one binary n-gram classifier per codeword bit
predicts it.  Decoding adds, for each language, the logistic loss of every
predicted margin against the language's bit, weighted by how reliable that bit
is, and takes the codeword of least loss; a small gap to the next one flags the
answer as ambiguous.

Learning counts hashed character bigrams and trigrams per language over a
sample of at most ``max_docs`` documents of each language (chosen by a hash of
the id, a documented bound of the fit); the counts of a class are the sums of
its languages' counts, so one pass over the sample trains all bits.  What
reaches the driver is BUCKETS numbers per language.  Prediction is one pass
without a shuffle over every whole text, a slice of bounded size at a time.

Edge cases: a null text or one without a letter is ``und`` with score 0; with
no learnable document every text is ``und``; with one language all texts with
letters get it with score 1; null ids are held in no fold, are not learned from
and stay null; repeated rows count as often as they stand; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import fold_of, small_batches

BUCKETS = 1 << 15
MAX_DOCS = 4000            # per language, for the fit
MAX_LANGUAGES = 500
SLICE = 1 << 20            # characters that are worked on at once
UNKNOWN = "und"

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def grams(text: str) -> Iterator[np.ndarray]:
    """Hash buckets of the bigrams and trigrams of a whole text, slice by
    slice.  Letters are lower-cased; anything else counts as one blank."""
    for at in range(0, len(text), SLICE):
        part = text[max(0, at - 2):at + SLICE].lower()
        c = np.frombuffer(f" {part} ".encode("utf-32-le", "replace"), "<u4")
        c = np.where(_letters()[c], c, np.uint32(32))
        c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])].astype(np.uint32)
        if len(c) < 3:
            continue
        two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F)
        yield np.concatenate([two, three]) >> np.uint32(17)


def codebook(n: int) -> np.ndarray:
    """Codewords (+1/-1) of n languages: every split of the languages for up to
    six of them, else splits drawn from a fixed generator."""
    if n <= 6:
        cols = [[1 if (s >> i) & 1 else -1 for i in range(n)] for s in range(1, 2 ** (n - 1))]
    else:
        rng = np.random.default_rng(7)
        want, cols = max(15, int(np.ceil(10 * np.log2(n)))), []
        while len(cols) < want:
            c = rng.permutation(np.where(np.arange(n) < n // 2, 1, -1)).tolist()
            if c not in cols and [-x for x in c] not in cols:
                cols.append(c)
    return np.array(cols, np.float64).reshape(len(cols), n).T


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray        # bucket x bit: log odds of the bit per n-gram
    bit_weight: np.ndarray     # reliability of each bit
    code: np.ndarray           # language x bit

    def margins(self, text: str) -> tuple[np.ndarray, int]:
        total, n = np.zeros(self.weights.shape[1]), 0
        for g in grams(text):
            total += self.weights[g].sum(axis=0, dtype=np.float64)
            n += len(g)
        return (total / n if n else total), n

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, ambiguous)."""
        if not text or not self.languages:
            return UNKNOWN, 0.0, True
        f, n = self.margins(text)
        if not n:
            return UNKNOWN, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        sharp = 4.0 * min(n, 400) ** 0.5        # more text, surer margins
        loss = (np.logaddexp(0, -self.code * (sharp * f)) * self.bit_weight).sum(axis=1)
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        best = int(np.argmin(loss))
        second = np.partition(loss, 1)[1]
        return self.languages[best], float(p[best]), bool(second - loss[best] < 1.0)


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        max_docs: int = MAX_DOCS) -> Model:
    """Learn from (id, text, language) rows; null languages and ids are left out."""
    rows = train.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"),
                        F.col(lang_col).cast("string").alias("lang")).filter("id IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), np.zeros((0, 0)))
    share = F.create_map(*[x for l in languages for x in (F.lit(l), F.lit(min(1.0, max_docs / counts[l])))])
    small_batches(train.sparkSession)
    sample = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mine = held.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for g in grams(text or ""):
                    mine += np.bincount(g, minlength=BUCKETS)
        for lang, n in held.items():
            at = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()),
                                              pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    seen = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = np.zeros((len(languages), BUCKETS))
    got = seen.toPandas()
    table[[languages.index(l) for l in got["lang"]], got["bucket"]] = got["n"]
    share_of = (table + 0.5) / (table.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)   # languages weigh alike
    code = codebook(len(languages))
    yes, no = (code > 0).astype(float), (code < 0).astype(float)
    weights = np.log(yes.T @ share_of / np.maximum(yes.sum(0), 1)[:, None]) \
        - np.log(no.T @ share_of / np.maximum(no.sum(0), 1)[:, None])
    model = Model(languages, np.ascontiguousarray(weights.T.astype(np.float32)), np.ones(code.shape[1]), code)
    if len(languages) < 2:
        return model
    spark = train.sparkSession
    first = spark.sparkContext.broadcast(model)      # BUCKETS x bits numbers

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, wrong, n = first.value, np.zeros(code.shape[1], np.int64), 0
        where = {l: i for i, l in enumerate(m.languages)}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f, size = m.margins(text or "")
                if size:
                    wrong += np.sign(f) != m.code[where[lang]]
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(len(wrong)), pa.int32()), pa.array(wrong, pa.int64()),
                                          pa.array([n] * len(wrong), pa.int64())], ["bit", "wrong", "n"])

    errors = sample.mapInArrow(check, "bit int, wrong long, n long").groupBy("bit") \
        .agg(((F.sum("wrong") + 1) / (F.sum("n") + 2)).alias("e")).collect()
    first.unpersist()
    for r in errors:
        e = min(max(r["e"], 1e-3), 0.5)
        model.bit_weight[r["bit"]] = np.log((1 - e) / e) / np.log(999) + 1e-3
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language, score and ambiguity of every whole text."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)     # BUCKETS x bits numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = [m.predict(t) for t in batch.column(1).to_pylist()]
            lang, score, unsure = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                                              pa.array(unsure, pa.bool_())], ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def held_out_identify(docs: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    """Learn from all folds but one, predict every document, mark the held-out ones."""
    fold_no = fold_of("doc_id", folds)
    model = fit(docs.filter(fold_no != fold))
    return identify(docs, model).withColumn("held_out", F.coalesce(fold_no == fold, F.lit(False)))
