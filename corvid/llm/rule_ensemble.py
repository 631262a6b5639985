"""Quality classifier (operator 4): a sparse rule ensemble.

Statistics of a text are DataFrame expressions.  Shallow trees grown on a
labelled sample give paths; every path is a conjunctive rule over statistics
("symbols per word > 0.2 and words <= 300").  A lasso logistic regression over
the rules' indicators keeps few of them, and what is kept is compiled into one
column expression, so scoring is a projection inside the scan: no Python, no
shuffle, and the model is a line of SQL that can be read.

The fit uses at most about ``max_docs`` labelled documents (chosen by a hash of
the id, a documented bound), which alone bounds the broadcast of labels.

Edge cases: a null or empty text has all statistics zero and a score as any
other; labels that are null or of unknown documents teach nothing; of a
document's several labels the mean counts (at least one half: 1); without two
classes to learn from every score is the smoothed share of label 1; null ids
are held in no fold and teach nothing; an empty table gives an empty result;
other columns are kept, clashing names are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import WORD_GAP, fold_of, materialise, text_of

MAX_DOCS = 20_000
THRESHOLD = 0.3
_SIGNS = "#*$%&|<>"

STATISTICS = ("words", "word_length", "distinct_share", "echo_share", "symbols_per_word", "bars_per_word",
              "bangs_per_word", "upper_share", "digit_share", "letter_share", "line_repeats", "line_words")

#: A rule is a conjunction of (statistic, above?, threshold).
Rule = tuple[tuple[str, bool, float], ...]


def with_statistics(docs: DataFrame, text_col: str = "text", prefix: str = "_s_") -> DataFrame:
    """docs and the statistics of its texts, each computed over the whole text."""
    text = text_of(text_col)
    count = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    df = docs.withColumns({
        "_w": F.array_remove(F.split(text, WORD_GAP), ""),
        "_l": F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > 0),
        "_letters": F.length(F.regexp_replace(text, r"\P{L}+", "")),
    })
    n = F.greatest(F.size("_w"), F.lit(1)).cast("double")
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    lines = F.greatest(F.size("_l"), F.lit(1)).cast("double")
    echo = F.size(F.filter("_w", lambda x, i: F.get(F.col("_w"), i + 1) == x))
    values = {
        "words": F.size("_w").cast("double"),
        "word_length": (F.length(text) - F.size("_w")) / n,
        "distinct_share": F.size(F.array_distinct("_w")) / n,
        "echo_share": echo / n,
        "symbols_per_word": count(_SIGNS) / n,
        "bars_per_word": count("|") / n,
        "bangs_per_word": count("!?") / n,
        "upper_share": F.length(F.regexp_replace(text, r"\P{Lu}+", "")) / F.greatest(F.col("_letters"), F.lit(1)),
        "digit_share": count("0123456789") / chars,
        "letter_share": F.col("_letters") / chars,
        "line_repeats": (F.size("_l") - F.size(F.array_distinct("_l"))) / lines,
        "line_words": F.size("_w") / lines,
    }
    return df.withColumns({prefix + k: v.cast("double") for k, v in values.items()}).drop("_w", "_l", "_letters")


@dataclass
class Ensemble:
    bias: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self, prefix: str = "_s_") -> Column:
        """The compiled model: a logistic of the sum of the rules' weights."""
        z = F.lit(float(self.bias))
        for rule, weight in self.rules:
            z = z + F.when(condition(rule, prefix), F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-z))


def condition(rule: Rule, prefix: str = "_s_") -> Column:
    out = None
    for name, above, threshold in rule:
        c = F.col(prefix + name) > threshold if above else F.col(prefix + name) <= threshold
        out = c if out is None else out & c
    return out


def _paths(node, path: Rule = ()) -> list[Rule]:
    """Conjunctions that lead to the inner and leaf nodes below a tree node."""
    if not node.getClass().getSimpleName().startswith("Internal"):
        return []
    split = node.split()
    name, at, out = STATISTICS[split.featureIndex()], float(split.threshold()), []
    for above, child in ((False, node.leftChild()), (True, node.rightChild())):
        # a tighter bound on the same side replaces the looser one above it
        held = tuple(c for c in path if (c[0], c[1]) != (name, above)) + ((name, above, at),)
        out += [tuple(sorted(held))] + _paths(child, held)
    return out


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "quality", max_docs: int = MAX_DOCS, trees: int = 8,
        depth: int = 3, lasso: float = 0.0005, prefix: str = "_s_") -> Ensemble:
    """Learn from labels outside the held-out fold (fold ``held`` of ``folds``)."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")) \
        .filter("id IS NOT NULL AND y IS NOT NULL").filter(fold_of("id", folds) != held)
    known = known.groupBy("id").agg((F.avg("y") >= 0.5).cast("double").alias("label"))
    n = known.count()
    if n > max_docs:
        known = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(max_docs / n * (1 << 30)))
    mine = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sample = mine.join(F.broadcast(known), "id")        # about max_docs rows of 16 bytes
    table = with_statistics(sample, "text", prefix).select("label", *[prefix + s for s in STATISTICS])
    table = VectorAssembler(inputCols=[prefix + s for s in STATISTICS], outputCol="_stats").transform(
        materialise(table, "quality-sample").coalesce(4)).persist()
    try:
        got = table.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones")).collect()[0]
        ones = got["ones"] or 0.0
        if not 0 < ones < got["n"]:
            p = (ones + 1) / (got["n"] + 2)
            return Ensemble(math.log(p / (1 - p)))
        forest = RandomForestClassifier(featuresCol="_stats", labelCol="label", numTrees=trees, maxDepth=depth,
                                        maxBins=64, minInstancesPerNode=max(1, min(20, got["n"] // 50)),
                                        featureSubsetStrategy="0.6", seed=7).fit(table)
        rules = sorted({p for t in forest.trees for p in _paths(t._call_java("rootNode"))})
        if not rules:
            return Ensemble(math.log(ones / (got["n"] - ones)))
        hits = table.withColumns({f"_r{i}": condition(r, prefix).cast("double") for i, r in enumerate(rules)})
        hits = VectorAssembler(inputCols=[f"_r{i}" for i in range(len(rules))], outputCol="_hits") \
            .transform(hits).select("label", "_hits").persist()
        try:
            lr = LogisticRegression(featuresCol="_hits", labelCol="label", elasticNetParam=1.0, regParam=lasso,
                                    maxIter=60, standardization=False).fit(hits)
        finally:
            hits.unpersist()
        kept = [(r, float(w)) for r, w in zip(rules, lr.coefficients.toArray()) if abs(w) > 1e-6]
        return Ensemble(float(lr.intercept), kept)
    finally:
        table.unpersist()


def score(docs: DataFrame, model: Ensemble, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs, ``score`` and ``predicted``."""
    df = with_statistics(docs.drop("score", "predicted"), text_col).withColumn("score", model.score())
    return df.withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop(*["_s_" + s for s in STATISTICS])


def kept_rows(docs: DataFrame, model: Ensemble, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the model predicts to be of quality, all columns."""
    rows = with_statistics(docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text")))
    # the score passes an explode, so that the filter stays above the statistics
    return rows.select("row", F.explode(F.array(model.score())).alias("score")).filter(F.col("score") >= threshold).select("row.*")


def held_out_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """Scores of every document by a model that never saw the held-out fold's labels."""
    model = fit(docs, labels, folds, held)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(fold_of("doc_id", folds) == held, F.lit(False)).alias("held_out"), "score", "predicted")
