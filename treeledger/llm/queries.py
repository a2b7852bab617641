"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from treeledger.llm.common import read
from treeledger.llm.oracle import ORACLE_SQL  # noqa: F401  (for the entry)


def op1_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treeledger.llm.op1_license import licenses

    return licenses(read(spark, sf_dir, "documents"))


def op2_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treeledger.llm.op2_extract import extract

    return extract(read(spark, sf_dir, "pages"))


def op3_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treeledger.llm.op3_hnsw import nearest

    return nearest(read(spark, sf_dir, "embeddings"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treeledger.llm.op4_quality import quality

    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treeledger.llm.op5_language import languages

    return languages(read(spark, sf_dir, "documents")).drop("spans")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treeledger.llm.op6_pii import personal

    return personal(read(spark, sf_dir, "documents"), digests=True)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treeledger.llm.op7_jaccard import near

    return near(read(spark, sf_dir, "documents"))


def op8_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treeledger.llm.op8_hilbert import shards

    return shards(read(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treeledger.llm.op9_decontaminate import contaminated

    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treeledger.llm.op10_bpe import encode

    return encode(read(spark, sf_dir, "documents"), digests=True, with_ids=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license": op1_license,
    "op2_extract": op2_extract,
    "op3_hnsw": op3_hnsw,
    "op4_quality": op4_quality,
    "op5_language": op5_language,
    "op6_pii": op6_pii,
    "op7_jaccard": op7_jaccard,
    "op8_hilbert": op8_hilbert,
    "op9_decontaminate": op9_decontaminate,
    "op10_bpe": op10_bpe,
}
