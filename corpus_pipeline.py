"""A corpus pipeline over documents: each stage works on all that the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import jaccard, langid, lines, mixing, packing
from millrace.llm.common import crc_bucket, materialize

#: No SQL states the language model or the packing search; tests hold the pipeline against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter, or with a calibrated probability under a half, go. Learns from those whose crc32(doc_id) mod 4 is not 2."""
    return langid.reject_unknown(docs, docs.where(crc_bucket(F.col("doc_id"), 4) != 2))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the multi-line chunks that repeat earlier ones, and with n_chars counted anew; those of which nothing is left go."""
    removed = "removed_lines"
    while removed in docs.columns:
        removed += "_"
    cut = lines.dedup_lines(docs, removed_out=removed)
    left = cut.where((F.col(removed) == 0) | (F.length(F.trim("text")) > 0)).drop(removed)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8 or more."""
    return jaccard.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as brings each source near its target."""
    return mixing.mix_sources(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, packing.default_tokenizer())


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; each one's rows are written as Parquet and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
