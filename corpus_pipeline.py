"""Corpus pipeline: quality classifier, quality rules, SimHash near-dedup,
substring dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet in the shared folder and reread as the next one's docs.  All
but the last return the columns that they were given.  Null ids and texts,
repeated rows, empty tables and further columns are treated as the operators'
docstrings say; a stage on an empty table returns an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corvid.llm import packing, rule_ensemble, rule_ledger, simhash, super_kmers
from corvid.llm.common import materialise, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go."""
    model = rule_ensemble.fit(docs, table(spark, sf_dir, "labels"), folds=5, held=0)
    return rule_ensemble.kept_rows(docs, model)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v2 of the rule ledger rejects go."""
    return rule_ledger.kept_rows(docs, policy="v2")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id."""
    return simhash.one_of_each(docs, shingle=4, distance=4)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside repeated windows of 35 words are taken out of the texts."""
    return super_kmers.without_repeats(docs, window=35, length_col="n_chars")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("best-fit packing", best_fit_packing),
]

#: SQL states neither the fit nor tokenizing and packing; the tests hold every
#: stage against a brute-force version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.lower().replace(" ", "-"))
    return docs
