"""The corpus pipeline: toxicity, exact dedup, near duplicates, mixing, packing, each stage on what the one before kept.

Every stage but the last returns the columns of its input, whatever they are called. Null and empty texts pass the first stage (score 0), are one group of exact copies, have no near
copies, take no words in the mix and are packed as their end id. Null ids and sources are values of their own. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from groupwise.llm import exact_dedup, mixing, ngram_join, packing, queries, toxicity
from groupwise.session import settle

ORACLE_SQL = None  # the first stage is a trained model, which SQL cannot express


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; ties with it go. Without labels of both kinds nothing is rejected."""
    return toxicity.keep_clean(docs, queries.toxicity_model(spark, sf_dir, docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id (null is the smallest); of rows that repeat id and text one stays."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near duplicates (null is the largest), and every document without words."""
    return ngram_join.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; rows alike in id, text and source are told apart by their other columns."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the sequences."""
    packed = packing.pack_documents(docs, queries.tokenizer_path(), keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
