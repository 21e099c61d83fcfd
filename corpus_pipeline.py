"""From raw documents to packed training sequences: quality, toxicity, near-duplicates, source mix, packing.

Every stage takes what its predecessor kept; its result is written as Parquet and read again as the documents of the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from reviewloom.llm import mixing, ngram_join, packing, quality, toxicity
from reviewloom.llm.common import staged, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose n-grams are near enough to those of trusted documents."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a network trained on the labelled ones among them scores below 0.5."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each group of near copies."""
    return ngram_join.one_of_each_group(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents left out or repeated, so that the sources' words come near their targets."""
    return mixing.draw(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 ids."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("toxicity", toxicity_filter), ("n-gram Jaccard join", near_duplicates),
          ("mixing sources", source_mix), ("packing", pack_sequences)]

# Trained scores, hashes and token ids cannot be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the documents that pass all stages. No documents give no pieces. Without trusted or toxic labels the stages that
    learn from them reject nothing beyond their fixed rules. Every row counts by itself, whatever its doc_id."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
