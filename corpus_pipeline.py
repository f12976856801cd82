"""A corpus pipeline of five stages, each on all rows that the stage before it kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from tidegrid.llm.common import table, written
from tidegrid.workers import STAGE, importable

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def ready(stage: Stage) -> Stage:
    """The stage with a session made ready for its workers first, so that one that is run alone bounds its batches and gives memory back, too."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(importable(spark, STAGE), docs, sf_dir)

    return run


@ready
def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage toxicity: documents that the chain rejects go. Nulls, empty texts, repeated rows and empty tables as in toxicity.keep_clean()."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


@ready
def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage exact_dedup: of equal texts one row stays. Nulls, empty texts, ties, repeated rows and empty tables as in exact_dedup.keep_one()."""
    return exact_dedup.keep_one(docs)


@ready
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage ngram_join: one document of each group of near copies stays. Nulls, empty texts, rows that share a doc_id and empty tables as in ngram_join.keep_one()."""
    return ngram_join.keep_one(docs)


@ready
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage mixing: each row as often as the mix takes it. Nulls, empty texts, repeated rows and empty tables as in mixing.repeated()."""
    return mixing.repeated(docs)


@ready
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage bpe: doc_id, n_tokens, ids_sha256, decoded_sha256 of each row. Nulls, empty texts, repeated rows and empty tables as in bpe.round_trip()."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("ngram_join", without_near_copies),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: SQL can't express a trained classifier, set similarity at this size or BPE; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's rows are written and read again as the next one's."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
