"""From raw documents to token counts: five stages, each over everything its predecessor kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``documents``.  :func:`run` writes each stage's result
as Parquet into the shared folder and reads it again for the next.  Nulls in any
column, empty and very long texts, repeated rows and empty tables pass through
as the operators' docstrings say; extra columns are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heliograph.llm.bpe import digests
from heliograph.llm.decontaminate import clean_documents
from heliograph.llm.language_id import known_language
from heliograph.llm.ngram_join import one_of_each
from heliograph.llm.quality_rules import kept_documents
from heliograph.llm.staging import small_batches, staged, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents go whose text is null or has no letter, or for which the field finds no language much likelier than the others."""
    small_batches(spark)
    return known_language(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the quality rules reject go."""
    small_batches(spark)
    return kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each group of linked documents one row stays, that with the least id."""
    small_batches(spark)
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that hold a near copy of a benchmark item go."""
    small_batches(spark)
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: number of tokens and hashes of the ids and the decoded bytes of each document."""
    import public_tokenizers

    small_batches(spark)
    return digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language),
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("byte_level_bpe", tokens),
]

#: The conditional random field and the rules' EM weights are learned, which SQL can't express; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
