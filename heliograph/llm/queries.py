"""The queries of the numbered operators over this repository's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import table


def crc_of(column: str) -> Column:
    """CRC-32 of an id as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def op1_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import linked

    return linked(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import scored

    return scored(table(spark, sf_dir, "documents"), crc_of("doc_id") % 5 == 1)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import rendered

    return rendered(table(spark, sf_dir, "conversations"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rulefit import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_of("doc_id") % 3 == 1)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judged

    return judged(table(spark, sf_dir, "pages"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scanned, summary

    return summary(scanned(table(spark, sf_dir, "documents")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judged

    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
    return judged(table(spark, sf_dir, "documents")).select(*columns)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import predicted

    docs = table(spark, sf_dir, "documents")
    held_out = crc_of("doc_id") % 5 == 0
    found = predicted(docs, held_out=held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "switches")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_count import counted, load_vocabulary

    return counted(table(spark, sf_dir, "documents"), load_vocabulary(public_tokenizers.path("piece_bpe_32k.model")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_middle import digested, transformed

    return digested(transformed(table(spark, sf_dir, "documents")))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audited

    return audited(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from . import chat_format, divergence, fill_middle

    return {"op4_chat_formatting": chat_format.ORACLE_SQL, "op12_fill_in_middle": fill_middle.ORACLE_SQL, "op13_source_divergence": divergence.ORACLE_SQL}
