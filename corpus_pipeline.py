"""A training corpus from ``documents``: toxic texts go, copies and near copies go, sources are mixed, windows are packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheaf.llm import exactdedup, mixing, packing, shingles, toxicity
from sheaf.llm.queries import toxicity_model, word_vocabulary
from sheaf.session import stage


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scoring under the operator's threshold; the model learns from labelled rows that aren't held out."""
    return toxicity.drop_toxic(docs, toxicity_model(spark, docs, sf_dir))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the one with the most code points, then the smallest id."""
    return exactdedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a similarity of 0.8 or more on 5-word shingles, the document with the smallest id.

    SimHash fingerprints of the shingles propose links, and bands those that differ in more bits."""
    return shingles.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, zero to two times."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training windows."""
    return packing.pack_documents(docs, word_vocabulary())


STAGES = [
    ("toxicity", without_toxic), ("exact_dedup", without_copies), ("near_dedup", without_near_copies), ("mixing", mixed), ("packing", packed),
]
#: Learned scores, hashes and tokenizers aren't SQL; tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
