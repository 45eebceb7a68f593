"""One query per document operator, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from widestat.llm import alignment, decontaminate, licenses, line_dedup, lm_score, merkle, mixing, packing, pii, quality, simhash, span_dedup, token_count
from widestat.llm.common import table


def tokenizer_path(name: str) -> str:
    """The place of a file of the public tokenizers; without them an error."""
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary_path() -> str:
    """The unigram vocabulary of the token counts: pieces and scores."""
    return tokenizer_path("piece_bpe_32k.model")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), token_count.load_vocabulary(vocabulary_path()))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan_licenses(table(spark, sf_dir, "documents")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.duplicate_lines(table(spark, sf_dir, "documents")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4))


def op8_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.digest(span_dedup.repeated_spans(table(spark, sf_dir, "documents")))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_quality, op3_token_count, op4_license_scan, op5_line_dedup, op6_mixing, op7_simhash,
                                     op8_span_dedup, op9_pii, op10_lm_score, op11_packing, op12_merkle, op13_alignment)}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality": quality.oracle_sql(), "op12_merkle": merkle.oracle_sql()}
