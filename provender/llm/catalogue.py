"""The queries of this subpackage and their SQL equivalents."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provender.llm import byte_bpe, license_scan, line_dedup, near_dup, packing, quality_model, quality_rules, secret_scan, token_tables, topk
from provender.llm.common import table


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file is; PROVENDER_TOKENIZERS, if set, names another folder."""
    if folder := os.environ.get("PROVENDER_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.query(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"))


def op4_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_tables.digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.query(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_license_scan, op3_byte_bpe, op4_token_tables, op5_near_dup, op6_secret_scan, op7_quality_rules, op8_best_fit_packing, op9_exact_topk, op10_quality_model)}
ORACLES: dict[str, str] = {"op1_line_dedup": line_dedup.ORACLE, "op5_near_dup": near_dup.ORACLE, "op7_quality_rules": quality_rules.ORACLE, "op9_exact_topk": topk.ORACLE}
