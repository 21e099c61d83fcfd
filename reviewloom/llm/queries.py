"""The registered queries of the numbered operators, each over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm import (class_model, divergence, licenses, mixing, ngram_join, packing, quality, resampling, sharding, token_counts, token_files,
                            topk, toxicity)
from reviewloom.llm.common import table
from reviewloom.sources.workspace import fresh_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def digested(pieces: DataFrame) -> DataFrame:
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@register
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


@register
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@register
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, size = fresh_path(spark, "token-files"), 49_408
    token_files.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path, vocabulary_size=size, end_id=2)
    return digested(token_files.read_tokens(spark, path, vocabulary_size=size))


@register
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


@register
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@register
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


ORACLE_SQL["op7_license_scan"] = licenses.SCAN_SQL


@register
def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


ORACLE_SQL["op8_topk_search"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::HUGEINT) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id, x FROM v WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, q.x, v.vec_id, list_sum(list_transform(range(1, len(v.x) + 1), lambda i: q.x[i] * v.x[i]))::BIGINT AS score
      FROM q JOIN v ON q.vec_id <> v.vec_id AND len(q.x) = len(v.x)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, x ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


@register
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


@register
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLE_SQL["op11_source_divergence"] = divergence.AUDIT_SQL


@register
def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL["op12_resampling"] = resampling.RESAMPLE_SQL


@register
def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_model.score_documents(table(spark, sf_dir, "documents"))


@register
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
