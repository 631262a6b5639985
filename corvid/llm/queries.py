"""The registered queries of the corpus operators (one per operator) and the
pipeline, with their oracle SQL where SQL can state the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corvid.llm import (byte_bpe, ecoc_language, hash_forest, license_scan, lloyd_codes, packing, rule_ensemble,
                        rule_ledger, simhash, super_kmers, token_alignment, token_files, warc)
from corvid.llm.common import materialise, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(materialise(warc.merge_index(runs), "capture-index")).drop("urlkey")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = token_files.write_tokens(table(spark, sf_dir, "documents"),
                                     public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_tokens(index)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_decode(table(spark, sf_dir, "documents"),
                                  public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                                  public_tokenizers.PATTERN)


def op4_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.held_out_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=5, held=0)


def op5_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_forest.neighbours(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op6_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ledger.judge(table(spark, sf_dir, "documents"), policy="v2")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ecoc_language.held_out_identify(table(spark, sf_dir, "documents"), folds=4, fold=2) \
        .select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, distance=4)


def op9_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return super_kmers.dedup_report(table(spark, sf_dir, "documents"), window=35)


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment_report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                            public_tokenizers.path("piece_bpe_32k.model"))


def op12_lloyd_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd_codes.codes(table(spark, sf_dir, "embeddings"), entries=256, rounds=4)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_token_files": op2_token_files,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_rule_ensemble": op4_rule_ensemble,
    "op5_hash_forest": op5_hash_forest,
    "op6_rule_ledger": op6_rule_ledger,
    "op7_language": op7_language,
    "op8_simhash": op8_simhash,
    "op9_super_kmers": op9_super_kmers,
    "op10_best_fit": op10_best_fit,
    "op11_alignment": op11_alignment,
    "op12_lloyd_codes": op12_lloyd_codes,
    "op13_license_scan": op13_license_scan,
}

ORACLE: dict[str, str] = {
    "op1_warc": warc.oracle(),
    "op6_rule_ledger": rule_ledger.ORACLE,
    "op9_super_kmers": super_kmers.oracle(window=35),
    "op12_lloyd_codes": lloyd_codes.oracle(),
    "op13_license_scan": license_scan.oracle(),
}
