"""From raw documents to token ids: language, near copies, benchmark passages, personal data, encoding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of documents; the last returns the encoded
documents. What a stage returns is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treeledger.llm.common import Scratch, prepare, read
from treeledger.llm.op5_language import in_known_languages
from treeledger.llm.op6_pii import without_personal
from treeledger.llm.op7_jaccard import one_of_each
from treeledger.llm.op9_decontaminate import without_items
from treeledger.llm.op10_bpe import encode


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; the rest go."""
    return in_known_languages(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: Jaccard similarity 0.8 or more over five-word shingles."""
    return one_of_each(docs, words=5, threshold=(80, 100))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return without_items(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced."""
    return without_personal(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document."""
    return encode(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark", benchmark), ("personal_data", personal_data), ("tokens", tokens)]

#: SQL can't express the stages. Tests hold near copies against brute force, the others and the whole against rows with a known outcome.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    prepare(spark)
    scratch, docs = Scratch(spark), read(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name, "zstd")
        if before:
            scratch.drop(before)
        before = name
    return docs
