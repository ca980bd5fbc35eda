"""The corpus operators as registered queries.

Each `opN_<name>(spark, sf_dir)` applies one operator with production parameters to its
whole table and returns the columns of its contract.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from playsight.llm import collocations, sharding, winnowing
from playsight.llm.common import scratch_folder, table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from playsight.llm.pii import find_personal_data

    return find_personal_data(table(spark, sf_dir, "documents"))


def op2_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.extendible_shards(table(spark, sf_dir, "documents"))


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from playsight.llm.kneser_ney import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from playsight.llm.ngram_jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from playsight.llm.toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from playsight.llm import token_store

    folder = scratch_folder(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), folder, token_store.default_tokenizer())
    return token_store.digests(spark, folder)


def op7_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from playsight.llm.pivot_index import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from playsight.llm.suffix_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents")).drop("th")


def op9_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from playsight.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).drop("source", "th")


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from playsight.llm.alignment import alignments

    return alignments(table(spark, sf_dir, "documents"))


def op13_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from playsight.llm.subword_lattice import text_scores

    return text_scores(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_extendible_sharding": op2_extendible_sharding,
        "op3_kneser_ney": op3_kneser_ney,
        "op4_ngram_jaccard": op4_ngram_jaccard,
        "op5_toxicity": op5_toxicity,
        "op6_token_store": op6_token_store,
        "op7_pivot_index": op7_pivot_index,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_entropy_mixing": op9_entropy_mixing,
        "op10_winnowing": op10_winnowing,
        "op11_collocations": op11_collocations,
        "op12_token_alignment": op12_token_alignment,
        "op13_subword_lattice": op13_subword_lattice,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_extendible_sharding": sharding.ORACLE_SQL,
        "op10_winnowing": winnowing.ORACLE_SQL,
        "op11_collocations": collocations.ORACLE_SQL,
    }
