"""The corpus pipeline: language ID, near duplicates, benchmark decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as Parquet to the shared folder and
reads it again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontaminate, jaccard_join, language_id, packing, secret_scan
from strandline.llm.common import Scratch, bound_batches


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the others go, null, empty and letter-free texts among them.

    Null ids and labels don't matter, and repeated rows are judged alike. An empty table stays empty, as in every stage.
    """
    bound_batches(spark)
    return language_id.keep_identified(docs)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group linked by word-shingle similarity; ties of an id go to one of its rows.

    Null and empty texts are linked with nothing and stay.
    """
    bound_batches(spark)
    return jaccard_join.keep_one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs; null and empty texts stay, repeated rows are judged alike."""
    bound_batches(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced and n_chars counted again; null texts stay null, and their n_chars becomes null."""
    bound_batches(spark)
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(clean.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences; null and empty texts are the end id alone, repeated rows documents of their own."""
    bound_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("jaccard_join", keep_one_copy),
    ("decontamination", drop_benchmark),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: Models, edit budgets and tokenizers are beyond SQL; the tests hold each stage to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the stages keep of documents. A stage's table is deleted once the next one's is written."""
    scratch, before = Scratch(spark, "pipeline"), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
