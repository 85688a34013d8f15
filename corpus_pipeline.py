"""The training-data pipeline: documents through five stages, each written as Parquet and read again for the next."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from veridoc.llm.common import discard, release_heaps, shared_dir, staging
from veridoc.llm.exact_dedup import drop_exact_duplicates
from veridoc.llm.language_id import fit, keep_identified
from veridoc.llm.packing import pack_documents
from veridoc.llm.queries import table, tokenizer
from veridoc.llm.simhash import drop_near_duplicates
from veridoc.llm.window_dedup import drop_repeated_windows

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Words whose ids a packing worker keeps: fewer than alone, as executors hold much from the stages before.
PIPELINE_WORDS = 150_000
#: Bytes of text that a packing worker tokenises at once: fewer than alone, for the same reason.
PIPELINE_BLOCK = 2 << 20

#: For each thread, the tables that its last stage has staged.
_staged = threading.local()


def _stage(function: Stage) -> Stage:
    """The stage, after the tables that this thread's stage before it had staged are deleted, as far as `docs` doesn't read them.

    A stage's output has to be written before the thread begins another stage; two pipelines at a time take two threads.
    """

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        past = getattr(_staged, "paths", [])
        read = docs.inputFiles() if past else []
        live = [p for p in past if any(p.split(":")[-1] in f for f in read)]
        discard(spark, [p for p in past if p not in live])
        release_heaps(spark)
        with staging() as paths:
            out = function(spark, docs, sf_dir)
        _staged.paths = live + paths
        return out

    return run_stage


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a learned language stay; those without a letter (null and empty ones too), or in which no language is likely, go."""
    return keep_identified(docs, fit(docs))


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts stays: that with the most characters, then of the smallest id; null and empty texts are equal."""
    return drop_exact_duplicates(docs)


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each component of near duplicates stays: texts whose sets of five-word shingles have a similarity of 0.8 or more.

    Texts without words are one component.
    """
    return drop_near_duplicates(docs, similarity=0.8)


@_stage
def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that a document with a smaller id has too are cut out of the texts; rows all stay, a null text stays null."""
    return drop_repeated_windows(docs)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies among the training sequences; a null or empty text is a piece of its end alone."""
    return pack_documents(docs, tokenizer("word_bpe_49k.json"), cached=PIPELINE_WORDS, block=PIPELINE_BLOCK)


STAGES: list[tuple[str, Stage]] = [("language", language), ("exact", exact), ("near", near), ("windows", windows), ("packing", packing)]

#: Language, near-duplicate and packing stages can't be written in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
    discard(spark, [f"{path}/{name}" for name, _ in STAGES[:-1]] + _staged.paths)
    _staged.paths = []
    return docs
