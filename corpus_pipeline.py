"""A corpus pipeline over `documents`: five stages, each written as Parquet and read again by the next.

toxicity        documents with a score of 0.5 or more go
line dedup      repeated lines go, except in the last document that holds them
similar         of each component of similar documents the one with the smallest id stays
contamination   documents that hold a passage of the benchmark go
tokens          the rest is encoded

A stage keeps the rows it doesn't reject and their columns as they are; line dedup changes text and brings n_chars up to
date. The last stage returns doc_id, ids, n_tokens and digests of ids and decoded text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catadrift.llm import leaks, lines, similar, tokens, toxicity
from catadrift.llm.frames import scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.clean(docs)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.drop_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return leaks.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.tokenised(docs, tokens.default_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_similar),
    ("benchmark decontamination", decontaminate),
    ("BPE encoding and decoding", encode),
]

#: The first stage is a trained classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            path = scratch(spark, f"stage-{number}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
