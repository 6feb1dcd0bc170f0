"""A corpus from documents to token shards: quality, near duplicates, benchmark passages, mixture, token ids.

Each stage gets what the stage before it kept and lets its decisions take effect; all but the last return the columns of documents.
Options of the operators are those of their own queries, but that near duplicates are found on five-word shingles.

Null and empty texts are scored as any text, have no duplicates, hold no benchmark item, and take no part in the mixture (they have no
words), so none reaches the shards. A null doc_id is kept as such, and with others of its group it is the last to be chosen. Repeated
rows are one after the second stage. Texts are never cut. Extra columns with any names pass all stages but the last. Of an empty table
every stage makes an empty one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ampliflow.llm import leaks, mixing, near_duplicates, quality, token_shards
from ampliflow.llm.shared import new_path, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. It learns from the labelled documents of the whole table."""
    return quality.keep_good(docs, quality.model_of(spark, sf_dir, table(spark, sf_dir, "documents")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_duplicates.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return leaks.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of the sources: each document as often as it is taken."""
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the mixture's ORC shards; what a reader finds in them."""
    path = new_path(spark, "corpus-token-ids")
    token_shards.write_shards(docs, path)
    return token_shards.digest(token_shards.read_shards(spark, path))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_ids", token_stage),
]

#: SQL can't express the classifier, the sketches or the tokens: the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
