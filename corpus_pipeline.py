"""From raw documents to training data: each stage works on what the one before it kept."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession

from plantlens.llm import exact_dedup, jaccard, mixing, quality, sentencepiece_fst
from plantlens.llm.common import stored, table
from plantlens.llm.queries import SENTENCEPIECE_MODEL, quality_model


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled rows of ``docs``, does not reject."""
    return quality.keep_good(docs, quality_model(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is connected by a Jaccard similarity of 0.85 or more of four-word shingles."""
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with the hash of what they decode to."""
    return sentencepiece_fst.encode_documents(docs, sentencepiece_fst.read_model(SENTENCEPIECE_MODEL))


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

# The classifier and the seeded draws have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every result is written as Parquet and read again."""
    docs = spark.read.parquet(posixpath.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return stored(STAGES[-1][1](spark, docs, sf_dir), "pipeline")
