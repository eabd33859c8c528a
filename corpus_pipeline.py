"""Corpus pipeline: the stages that turn documents into packed training sequences.

Each stage takes what the one before it kept, written as Parquet and read again.
All but the last return the columns of documents; the last returns pieces of
sequences. Rows, not ids, are followed, so null and repeated ids, null texts and
further columns pass through; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seamline.llm import decontamination, minhash_dedup, packing, substring_dedup
from seamline.llm import toxicity as toxicity_grammar
from seamline.llm.queries import crc_is, tokenizer_path
from seamline.session import scratch


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. Labels of a fifth of the ids are never learned."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity_grammar.remove(docs, labels, ~crc_is("doc_id", 5, 0))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a similarity of 0.8 stays: the one with the smallest id."""
    return minhash_dedup.dedup(docs, percent=80)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 35 that occur elsewhere are removed; ``n_chars`` follows the text."""
    return substring_dedup.trimmed(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens, with their ids."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("minhash_near_dedup", near_duplicates),
    ("substring_dedup", substrings),
    ("benchmark_decontamination", benchmark),
    ("packing", packed),
]

#: Learned scores and tokens have no SQL twin. Tests hold the operators against brute force, and
#: the stages against them by rows and columns.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
