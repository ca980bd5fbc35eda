"""From raw documents to a deduplicated, decontaminated, mixed and tokenized corpus.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; run()
writes each result as Parquet into the shared checkpoint folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playsight.llm import kneser_ney, mixing, token_store, winnowing
from playsight.llm.common import cut, if_small, scratch_folder, table
from playsight.llm.ngram_jaccard import jaccard_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _key() -> Column:
    """Names a row by its id and text, also where one of them is null; rows that repeat both are one document."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit("")), F.col("text").isNull())


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with the key of each row in place of its id."""
    return docs.select(_key().alias("doc_id"), "text")


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs but the rows whose key is in `dropped` (key)."""
    kept = docs.select(*COLUMNS, _key().alias("_key")).join(if_small(cut(dropped.select("key").distinct())), F.col("_key") == F.col("key"), "left_anti")
    return kept.select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the language model of trusted text rejects.

    Each row is judged by its own text: of an id with several texts, those that pass stay.  Null and
    empty texts stay, as do texts of a language (null is one) without trusted text.
    """
    found = kneser_ney.quality(docs, table(spark, sf_dir, "labels"), name=_key())
    return _without(docs, found.where("not keep").select(F.col("doc_id").alias("key")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that of the smallest id, null last.

    Rows that repeat id and text are one document, of which one row stays.  Texts without words are
    near to nothing and stay.  Other columns don't matter.
    """
    found = cut(jaccard_components(_keyed(docs)).where("n_shingles > 0").select(F.col("doc_id").alias("key"), "component_id").distinct())
    groups = found.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1")
    many = cut(found.join(if_small(cut(groups)), "component_id").select("key", "component_id"))
    named = docs.select(_key().alias("key"), "doc_id").join(if_small(many), "key")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))["key"].alias("first"))
    dropped = many.join(if_small(cut(first)), "component_id").where("key <> first").select("key")
    kept = _without(docs, dropped).withColumn("_key", _key())
    again = if_small(cut(docs.groupBy(_key().alias("_key")).agg(F.count("*").alias("n")).where("n > 1").select("_key")))
    return kept.join(again, "_key", "left_anti").select(*COLUMNS).unionAll(kept.join(again, "_key", "left_semi").dropDuplicates(["_key"]).select(*COLUMNS))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages; each row by its own text, null ids too."""
    found = winnowing.decontaminate(_keyed(docs), table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("contaminated").select(F.col("doc_id").alias("key")))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources meet their target weights; null and empty texts are dropped."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token store and returns what is read back, a row a document, repeated ones too."""
    folder = scratch_folder(spark, "token-store")
    token_store.write_store(docs, folder, token_store.default_tokenizer())
    return token_store.digests(spark, folder)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: The language model and the rounding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    folder = scratch_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
