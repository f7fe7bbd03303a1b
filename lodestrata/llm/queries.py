"""The registered queries of this subpackage: thin digests over its operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import embeddings, shards
from lodestrata.llm.ctw import lm_scores
from lodestrata.llm.decontaminate import contamination_report
from lodestrata.llm.packing import pack_documents
from lodestrata.llm.pii import pii_report
from lodestrata.llm.quality import fit_quality, quality_scores
from lodestrata.llm.shared import documents
from lodestrata.llm.simhash import simhash_groups
from lodestrata.llm.suffixes import string_report
from lodestrata.llm.toxicity import fit_toxicity, toxicity_scores


def vocabulary() -> str:
    """The file that the packing query counts tokens by; another is a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(documents(spark, sf_dir))


def op3_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(documents(spark, sf_dir))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return string_report(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity_scores(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_scores(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), vocabulary())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_pii": op2_pii,
    "op3_extendible_shards": op3_extendible_shards,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_lm_score": op9_lm_score,
    "op10_pack": op10_pack,
}

ORACLES: dict[str, str] = {"op3_extendible_shards": shards.ORACLE, "op4_embedding_dedup": embeddings.ORACLE}
