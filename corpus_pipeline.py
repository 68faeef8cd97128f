"""Corpus preparation, stage by stage; each takes what the one before it kept.

1. language_id: documents whose language cannot be told are dropped.
2. near_duplicates: of each group linked by 5-word shingles (Jaccard 0.75) one stays.
3. repeated_passages: strings of 200 bytes that start twice are cut out of the texts.
4. find_secrets: secrets are replaced by the name of their kind.
5. pack: the texts become pieces of 1024-token sequences, one row a piece.

A document that loses its whole text in stage 3 stays as an empty one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillmill.llm import jaccard, language, packing, secret_scan, suffixes
from quillmill.llm.common import cut


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_confident(spark, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.strip(docs)


def find_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(packing.VOCABULARY))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("find_secrets", find_secrets),
    ("pack", pack),
]

#: The stages run code that SQL does not have; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
