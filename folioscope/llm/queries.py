"""The registered queries of the text operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, covertree, langid, licenses, lm, mixing, neighbours, sharding, simhash, toxicity
from .common import table


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.duplicates(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.choose(table(spark, sf_dir, "documents"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm.score(docs, lm.train(docs))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.classes(table(spark, sf_dir, "embeddings"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), every=50)


QUERIES = {
    "op8_language_id": op8_language_id,
    "op10_toxicity": op10_toxicity,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op4_source_mixing": op4_source_mixing,
    "op6_bpe_round_trip": op6_bpe_round_trip,
    "op3_license_scan": op3_license_scan,
    "op7_lm_scores": op7_lm_scores,
    "op9_sharding": op9_sharding,
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_nearest_neighbours": op2_nearest_neighbours,
}
ORACLE_SQL: dict[str, str] = {
    "op4_source_mixing": mixing.oracle_sql(),
    "op1_embedding_near_dedup": covertree.oracle_sql(),
}
