"""A training corpus in five stages, each an operator of ``gradeflow.llm`` over all documents its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gradeflow.llm import decontaminate, language, line_dedup, sentencepiece_codec, weighted_minhash
from gradeflow.llm.common import stored

#: Documents below this share of words in their main language are rejected.
LEAST_LANGUAGE_SHARE = 0.25


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with letters and one main language."""
    return language.of_one_language(docs, language.train(docs), LEAST_LANGUAGE_SHARE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines that have a similar earlier line, and documents left without lines."""
    return line_dedup.without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group of near duplicates."""
    return weighted_minhash.first_of_class(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of the benchmark out of the texts."""
    return decontaminate.without_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every document; digests of its ids and of the decoded text."""
    return sentencepiece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), pieces=False)


STAGES = [("language", languages), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontaminate", benchmark), ("sentencepiece", tokens)]

#: Encoding and weighted sampling can't be said in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a Parquet table that the next stage reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"corpus_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
