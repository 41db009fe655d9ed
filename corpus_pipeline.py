"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from winnow.llm import mixing, order_minhash, packing, quality_classifier, quality_rules
from winnow.llm.common import remainder_of_crc, stored
from winnow.llm.queries import SOURCE_WEIGHTS, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    usable = remainder_of_crc(F.col("doc_id"), 5) != 0
    done = quality_classifier.classify(docs, read(spark, sf_dir, "labels"), usable)
    return done.filter("predicted = 1").select("row.*")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return order_minhash.drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their weights; a document may repeat, up to three times."""
    return mixing.mix(docs, SOURCE_WEIGHTS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in sequences of 4096 tokens."""
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality),
    ("quality rules", rules),
    ("near duplicates", near_duplicates),
    ("mixing", mixture),
    ("packing", sequences),
]
# Scores of a trained model and a sampled mixture are beyond SQL; tests/llm holds the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
