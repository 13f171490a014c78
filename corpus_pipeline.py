"""Corpus pipeline: quality, near-dedup, personal data, mixing, token ids.

Each stage reads what the one before it kept, as a written table, and its
decisions take effect in what it returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import mixing, pieces, pii, quality, simhash
from weftgraph.llm._base import cut, table
from weftgraph.session import ship


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier does not reject; it learns from the labels of those it is given."""
    ship(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more), the one with the smallest id."""
    ship(spark)
    return simhash.keep_one(docs, words=5, similarity=0.8)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind."""
    ship(spark)
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, whole; none more than three times."""
    ship(spark)
    return mixing.mix_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, and whether they decode to it."""
    ship(spark)
    return pieces.encode(docs, ["doc_id", "source"])


STAGES = [
    ("quality classifier", good),
    ("simhash near-dedup", single),
    ("pii", private),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

#: Learned models, xxhash64 fingerprints and token ids are not for SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
