"""The numbered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import bpe, divergence, langid, lines, media, negatives, packing, quality_rules, ranker, simhash, sketches, sstable, urls
from gleaner.llm.shared import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A public tokenizer's file; only queries fix one, operators take a path."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_broken", "host_verdict", "kept")
    return quality_rules.judged(table(spark, sf_dir, "documents")).select(*columns)


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.token_shards(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def op3_chunked_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_and_read(table(spark, sf_dir, "documents"))


def op4_quality_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ranker.scored(docs, ranker.trained(docs, table(spark, sf_dir, "labels")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.grouped(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), urls.rule_table(spark, urls.RULES))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, end_id=0)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduplicated(table(spark, sf_dir, "documents"), min_sites=10).select("doc_id", "text", "n_lines", "n_removed")


def op10_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predicted(docs, langid.trained(docs))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(table(spark, sf_dir, "documents"), min_docs=10, top=10)


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.compared(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mined(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality_rules.ORACLE, "op7_url_filter": urls.ORACLE, "op9_line_dedup": lines.ORACLE, "op11_source_audit": divergence.ORACLE, "op13_hard_negatives": negatives.ORACLE}
