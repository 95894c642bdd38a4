"""A corpus pipeline: each stage applies one operator to all that the stage before it kept."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import lines, packing, quality_rules, ranker, shared, simhash
from gleaner.llm.queries import tokenizer_path
from gleaner.llm.shared import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(f: Stage) -> Stage:
    """A stage whose work tables go when the next one begins, unless that one reads them.

    A stage's result is written before the next begins, so by then nothing needs its work tables.
    """

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shared.drop_left(spark, docs)
        with shared.leaving(spark):
            return f(spark, docs, sf_dir)

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host does, with all columns.

    Null and empty texts go; a null host is one of its own; of repeated rows all stay or go; an empty table stays empty.
    """
    return quality_rules.kept(docs)


@stage
def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranker, learned from the labelled ones among them, scores a half or more, with all columns.

    Without labels of both kinds every score is a half, and all stay. Null and empty texts score as texts without words; of
    repeated rows all stay or go; an empty table stays empty.
    """
    return ranker.kept(docs, ranker.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@stage
def boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that ten sites or more share; n_chars, if there, is that of the new text.

    Null texts stay null; texts of shared lines alone end empty; of equal lines the first of the smallest id stays; an empty
    table stays empty.
    """
    cleaned = lines.deduplicated(docs, min_sites=10, counts=False)
    return cleaned.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else cleaned


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies, that of the smallest id, with all columns.

    Null and empty texts are one group; of repeated rows one stays; of rows without an id one of each text; an empty table
    stays empty.
    """
    return simhash.kept(docs)


@stage
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens.

    Null and empty texts are one end token; repeated rows are packed each; an empty table gives no rows.
    """
    return packing.packed(docs, tokenizer_path(), capacity=2048, end_id=0)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("quality_ranker", classifier),
    ("line_dedup", boilerplate),
    ("simhash_dedup", near_copies),
    ("packing", sequences),
]

#: SQL cannot express fingerprints, a learned score or packing; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, for all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES[:-1]:
        docs = written(f(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
