"""Corpus pipeline: five stages over `documents`, each one operator of the llm subpackage.

A stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame, which is written
as Parquet and read again as the next stage's input.  All but the last return the columns of documents.

Rows are told apart by a key of their own, so repeated rows, rows that share an identifier and rows without one are each
a document: copies among them go, and the mix takes each at most twice.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, exact, langid, minhash, mixing
from tidemark.shipping import ship
from tidemark.session import TEXT_SETTINGS, apply_settings, cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def prepare(spark: SparkSession) -> SparkSession:
    """Settings and package, for a stage that runs by itself as for all of them."""
    return ship(apply_settings(spark, TEXT_SETTINGS))


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus itself teaches; others go."""
    prepare(spark)
    learned = langid.learn_profiles(docs.where(~langid.held_out(F.col("doc_id"), 4, 2)))
    return langid.known_language(docs.select(*COLUMNS), learned)


def with_key(docs: DataFrame) -> DataFrame:
    """The columns of documents and `_key`: the identifier if every row has its own, else numbers in the order of identifiers, nulls last."""
    docs = docs.select(*COLUMNS)
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        return docs.withColumn("_key", F.col("doc_id"))
    # Ranges of (identifier, content, place) split any group; written, so that a row has one number however often it is read.
    order = [F.col("doc_id").asc_nulls_last(), F.col("_content"), F.col("_place")]
    dealt = docs.withColumn("_content", F.xxhash64(*COLUMNS)).withColumn("_place", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut_lineage(dealt.select(*COLUMNS, F.monotonically_increasing_id().alias("_key")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    prepare(spark)
    return exact.drop_copies(with_key(docs), "_key").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    prepare(spark)
    return minhash.drop_near_copies(with_key(docs), "_key").select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document as often as it is taken, at most twice."""
    docs = with_key(docs)
    copies = mixing.mix_sources(docs, "_key").where("copies > 0").select(F.col("doc_id").alias("_taken"), "copies")
    taken = docs.join(copies, F.col("_key") == F.col("_taken"))
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and decoded texts as digests, one row per taken copy."""
    prepare(spark)
    return bpe.encoding_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language identification", known_languages),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("source mix", source_mix),
    ("bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages are models, sketches and a tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None
