"""The corpus pipeline: quality rules, language ID, near-duplicates, decontamination, SentencePiece, each over all that is left.

Stages take documents with any further columns, whatever their names, and all but the last return the same columns. Null and empty
texts go in the first stage; very long texts are read whole; repeated rows are kept or dropped together; an empty table gives
an empty table of the stage's columns.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apexrank.llm.common import checked, reclaim, settle, table
from apexrank.llm.decontamination import decontaminate
from apexrank.llm.language_id import filter_language
from apexrank.llm.near_dedup import near_duplicates
from apexrank.llm.quality_rules import filter_quality
from apexrank.llm.tokens import encode


def apart(stage):
    """The stage, begun without what the one before has left in the executors' heaps; see reclaim()."""

    @wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        reclaim(spark)
        return stage(spark, docs, sf_dir)

    return begun


@apart
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that a quality rule rejects go; see filter_quality()."""
    return filter_quality(docs)


@apart
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents go that the decoder finds to be in no language (`und`), between two, or like none that it has learned; see
    filter_language()."""
    return filter_language(docs)


@apart
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10 on shingles of five words, similarity 0.8: of each group of linked documents the one with the least doc_id
    stays. Rows that repeat a doc_id are one document and stay or go together; rows without a doc_id stay."""
    gone = settle(near_duplicates(docs).where("not kept").select("doc_id").distinct(), "copies")
    return docs.join(checked(gone, gone.count()), "doc_id", "left_anti").select(*docs.columns)


@apart
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that hold a copy of a benchmark item go; see decontaminate()."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


@apart
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: doc_id, n_tokens, ids of each document that is left, and round_trip, whether they decode to its text; see encode()."""
    return encode(docs).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "round_trip")


STAGES = [("quality_rules", quality), ("language_id", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("sentencepiece", tokens)]

#: The classifier and the tokenizer can't be told in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of what all stages keep of documents. Each stage's result is written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
