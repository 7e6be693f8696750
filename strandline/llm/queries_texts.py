"""Queries of the operators on documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.encoding import encode_corpus, token_counts
from strandline.llm.mixing import mix_sources, reached_shares
from strandline.llm.truncation import truncated
from strandline.session import checkpointed
from strandline.tables import table


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(table(spark, sf_dir, "documents"), key="doc_id", text="text")


def _token_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document, worked out once."""
    documents = table(spark, sf_dir, "documents")
    counts = token_counts(documents, key="doc_id", text="text")
    return checkpointed(counts.join(documents.select("doc_id", "source"), "doc_id").withColumnRenamed("n_tokens", "size"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix, each copy with its place in it."""
    mix, _ = mix_sources(_token_sizes(spark, sf_dir), table(spark, sf_dir, "source_targets"), key="doc_id")
    return mix.select("doc_id", "source", "copy_no", F.col("size").alias("n_tokens"), F.round("finish", 3).alias("finish"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of tokens asked for and reached."""
    mix, plan = mix_sources(_token_sizes(spark, sf_dir), table(spark, sf_dir, "source_targets"), key="doc_id")
    return reached_shares(mix, plan).withColumnRenamed("size", "n_tokens")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text was cut off."""
    return truncated(table(spark, sf_dir, "documents"), key="doc_id", text="text").select("doc_id")


def p10_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source truncates."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    cut = truncated(documents, key="doc_id", text="text")
    return (
        documents.join(cut, "doc_id", "left")
        .groupBy("source")
        .agg(
            F.count("*").alias("n_documents"),
            F.count("evidence").alias("n_truncated"),
            F.count(F.when(F.col("evidence") == "copy", 1)).alias("n_by_copy"),
        )
        .withColumn("share", F.round(F.col("n_truncated") / F.col("n_documents"), 6))
    )


QUERIES = {"p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_sources": p10_sources}
SQL = {}
