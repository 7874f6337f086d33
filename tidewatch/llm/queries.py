"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import bpe, divergence, language, lm, media, merkle, packing, sharding, simhash, suffix, token_files, url_filter, whitening
from tidewatch.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(documents(spark, sf_dir))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_rows(documents(spark, sf_dir))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(documents(spark, sf_dir))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(documents(spark, sf_dir))


def op5_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited_fingerprints(documents(spark, sf_dir))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeat_rows(documents(spark, sf_dir))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(documents(spark, sf_dir))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_rows(documents(spark, sf_dir))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(documents(spark, sf_dir))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_rows(documents(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_lm, op2_language, op3_bpe, op4_media, op5_merkle, op6_suffix_dedup, op7_sharding, op8_packing, op9_url_filter, op10_simhash, op11_whitening, op12_divergence, op13_token_files)}


def oracle_sql() -> dict[str, str]:
    return {"op9_url_filter": url_filter.SQL, "op12_divergence": divergence.SQL}
