"""A corpus pipeline of five stages; each one's rows are written and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trailweave.llm import bpe, mixing, near_dups, secrets, toxicity
from trailweave.workspace import discard, materialize


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labelled ones scores as toxic go."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return toxicity.reject(docs, toxicity.fit(docs, labels), threshold=0.3)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates on five-word shingles stays."""
    return near_dups.keep_one(docs, words=5, similarity=0.8)


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secret spans in their texts are replaced."""
    return secrets.redact(docs, secrets.fit(docs))


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the mix of their sources takes them."""
    return mixing.mixed(docs)


def _bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, as number and hash, and the hash of what they decode to."""
    return bpe.digests(docs)


STAGES = [
    ("toxicity", _toxicity),
    ("near_duplicates", _near_duplicates),
    ("secrets", _secrets),
    ("mixing", _mixing),
    ("bpe", _bpe),
]

#: Model scores, signatures and merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all ``documents`` of ``sf_dir``."""
    docs, before = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:  # what the stage before wrote has been read
            discard(before)
        before = docs
    return docs
