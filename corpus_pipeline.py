"""A corpus pipeline: documents by quality, without near copies and benchmark text, mixed and sharded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontam, forest, mixing, quality, shards
from quillspark.llm.common import Tables
from quillspark.llm.queries import LEAST_QUALITY, SHARDS, quality_model, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    Each row is judged by its own whole text; a null or empty one has a score like any other, and a
    very long one is read whole. Rows that repeat, and ties, stay or go together. The classifier
    learns from labelled rows of ``docs``; without any it keeps or drops all alike. An empty table
    gives an empty one; the columns stay, whatever they are called.
    """
    return quality.keep_quality(docs, quality_model(docs, spark, sf_dir), LEAST_QUALITY)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id.

    Null texts, texts without words and rows without doc_id are in no group and stay. Of rows that
    repeat a doc_id with the same text one stays; with other texts each is judged by its own, ties go
    to the text that hashes lowest. Very long texts are compared whole. An empty table gives an empty
    one; the columns stay, whatever they are called.
    """
    return forest.one_of_each(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark.

    Null and empty texts hold none and stay; very long ones are compared whole. Rows that repeat stay
    or go together, with or without doc_id. An empty table gives an empty one; the columns stay,
    whatever they are called.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix uses them, in training order.

    A null source is a source. Null and empty texts cost nothing and stay, once, at the start; a very
    long text counts whole. Rows that repeat a doc_id have places of their own, by size and a hash of
    their texts. An empty table gives an empty one; the columns stay, whatever they are called.
    """
    return mixing.mixed(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard, which doc_id and the number of shards decide.

    Texts aren't read, so null, empty and very long ones make no difference. Rows that repeat a
    doc_id, and rows without one, go to one shard each. A column ``shard`` is replaced, all others
    stay. An empty table gives an empty one.
    """
    return shards.add_shard(docs, SHARDS)


STAGES = [("quality", good), ("near copies", distinct), ("benchmark", clean), ("mix", mixed), ("shards", sharded)]

#: The classifier, the forest and the shards' hash have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; a stage's table goes when the next is written."""
    made, last = Tables(), None
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = made(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        made.drop(last)
        last = docs
    return docs
