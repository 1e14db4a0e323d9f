"""From raw documents to token ids: five stages, each an operator of ``marketlake.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketlake.llm import byte_bpe, decontaminate, exact_dedup, jaccard_join, toxicity
from marketlake.llm.common import DOCUMENT, importable, materialize, table

#: SQL has neither the classifier of the first stage nor the tokenizer of the last.
ORACLE_SQL = None


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic stay."""
    importable(spark)
    return toxicity.accepted(docs, table(spark, sf_dir, "labels")).select(DOCUMENT)


def _exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    importable(spark)
    return exact_dedup.deduplicate(docs).select(DOCUMENT)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the document with the smallest doc_id stays."""
    importable(spark)
    return jaccard_join.representatives(docs, k=5, percent=80).select(DOCUMENT)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage stay."""
    importable(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(DOCUMENT)


def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the decoded bytes."""
    importable(spark)
    return byte_bpe.round_trip(docs.select("doc_id", "lang", "source", "text"))


STAGES = [
    ("toxicity", _toxicity),
    ("exact_dedup", _exact_dedup),
    ("near_duplicates", _near_duplicates),
    ("decontaminate", _decontaminate),
    ("tokens", _tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``; each result is written and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
