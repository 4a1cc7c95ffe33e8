"""A training corpus from raw documents: each stage works on all that the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.

In every stage a null or empty text is defined: the classifier judges it as one without characters; line dedup,
near-dup and the secret scan keep its row as it is; packing gives it a piece of the end id alone. A null identifier
is kept and linked with nothing. Rows that repeat an identifier and a text become one in near-dup; with unlike texts
they are documents of their own there, and each is packed. Texts of any length are worked on whole. Extra columns,
whatever their names, go through all stages but the last. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provender.llm import line_dedup, near_dup, packing, quality_model, secret_scan
from provender.llm.catalogue import tokenizer_path
from provender.llm.common import made, remove_made_since, stored, table


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars, where there is one, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_model.accepted(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that came before go from the texts; a document that loses all its text goes; null and empty ones stay."""
    cleaned = line_dedup.dedup(docs, facts_as="_facts")
    return _measured(cleaned.filter("text IS NULL OR text <> '' OR _facts.n_removed = 0").drop("_facts"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return near_dup.first_of_class(docs)


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts."""
    return _measured(secret_scan.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens, with their places in sequences."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=1)


STAGES = [("quality_classifier", quality_classifier), ("line_dedup", dedup_lines), ("minhash_near_dedup", near_dedup), ("secret_scan", scan_secrets), ("best_fit_packing", pack)]

#: SQL can't express the classifier, the forest and the packing; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs, before = table(spark, sf_dir, "documents"), made()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        # What the stage was made of, with its predecessor's result, goes.
        remove_made_since(spark, before, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
