"""A training-corpus pipeline of five stages over the text operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it in the
shared folder and hands the rows read back to the next. Stages one to four return
documents' columns for the rows they keep; the last one returns token ids' digests.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe_frames, decontaminate, jaccard, quality, store, toxicity

TOKENIZER = "word_bpe_49k.json"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality scorer rejects."""
    return quality.keep_good(docs, quality.train(docs))


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops toxic documents; the model learns from the labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(toxicity.labelled(docs, labels)))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of near-duplicates (five words, 0.8)."""
    return jaccard.keep_one(docs, k=5, num=80, den=100)


def keep_unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a window like a benchmark item."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes what is left."""
    return bpe_frames.round_trip(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", keep_quality),
    ("toxicity", keep_civil),
    ("near_duplicates", keep_distinct),
    ("decontamination", keep_unleaked),
    ("bpe", encode),
]

#: The learned stages and the tokenizer can't be written in SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what a stage read and wrote on its way goes once the next table is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        with store.scope():
            docs = store.table(stage(spark, docs, sf_dir), f"stage-{name}")
            store.keep(docs)
        if before:
            store.drop(before, spark)
        before = docs.table_path
    return docs
