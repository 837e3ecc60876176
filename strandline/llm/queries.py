"""The registered queries of this subpackage and their SQL, where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import chat_format, decontaminate, embedding_dedup, jaccard_join, language_id, lm_score, merkle, near_vectors, packing, ranked_search, secret_scan, suffix_dedup, url_filter
from strandline.llm.common import bound_batches


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_read(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(_read(spark, sf_dir, "conversations"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_read(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup_embeddings(_read(spark, sf_dir, "embeddings"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_texts(_read(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_read(spark, sf_dir, "pages"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_read(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_read(spark, sf_dir, "documents"))


def op12_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.nearest(_read(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_decontamination, op3_chat_format, op4_jaccard_join, op5_suffix_dedup, op6_embedding_dedup, op7_lm_score, op8_url_filter, op9_secret_scan, op10_best_fit_packing, op11_merkle_manifest, op12_nearest_vectors, op13_ranked_search)}
ORACLE: dict[str, str] = {"op3_chat_format": chat_format.SQL, "op4_jaccard_join": jaccard_join.SQL, "op5_suffix_dedup": suffix_dedup.SQL, "op6_embedding_dedup": embedding_dedup.SQL, "op11_merkle_manifest": merkle.SQL, "op13_ranked_search": ranked_search.SQL}
