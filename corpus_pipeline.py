"""Corpus pipeline: documents through four of the training-data operators, one after another.

toxicity: documents that the classifier's verdict rejects go. near_dedup: of each group of near
copies (five-word shingles, similarity 0.8) the document of the smallest id stays. mixing: sources
are interleaved to tempered target weights, every document once. bpe: every text is encoded and
decoded again, in small blocks, as the executors of earlier stages leave Python less room; `place` is
where the mix has put the text, so that the encoded rows can be taken in its order.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from movelog.llm import op02_near_dedup, op03_bpe, op04_toxicity, op08_mixing
from movelog.llm.common import materialise, placed_in_files


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return op04_toxicity.keep_clean(docs, op04_toxicity.fit(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op02_near_dedup.keep_one(docs, op02_near_dedup.near_duplicates(docs, width=5, percent=80))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op08_mixing.mix(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op03_bpe.round_trip(placed_in_files(docs), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, block=5_000_000, keep=("place",))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("mixing", mixing), ("bpe", bpe)]

#: The classifier and the merges cannot be said in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; each one's result is written once, as the next one reads it several times."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
