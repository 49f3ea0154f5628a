"""The registered queries of the text operators: thin contracts over the operators' own results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import align, bpe_frames, decontaminate, jaccard, licenses, oracles, piecewise, quality, setsketch, spelling, store, token_count, tokenbin, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_warc", oracles.WARC)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back."""
    manifest = warc.write_archives(load(spark, sf_dir, "pages"), store.shared_dir(spark, "warc"))
    return warc.read_archives(spark, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


WORD_BPE, BYTE_BPE, PIECE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"
WORD_BPE_SIZE, END_ID = 49408, 2


@query("op2_token_files")
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written to bit-packed files and read back."""
    docs = load(spark, sf_dir, "documents")
    manifest = tokenbin.write_tokens(docs, store.shared_dir(spark, "tokens"), public_tokenizers.path(WORD_BPE), END_ID, WORD_BPE_SIZE)
    return tokenbin.read_tokens(spark, manifest)


@query("op3_bpe")
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded by the transducers."""
    return bpe_frames.round_trip(load(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_count.count_tokens(load(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


@query("op9_jaccard_join", oracles.JACCARD)
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents by three-word shingles and a similarity of 0.9."""
    return jaccard.join_classes(load(spark, sf_dir, "documents"), k=3, num=90, den=100)


@query("op10_fingerprints")
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piecewise fingerprints of all documents, their edits and their neighbours."""
    return piecewise.neighbours(load(spark, sf_dir, "documents"))


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned from the labels that are not held out."""
    docs = load(spark, sf_dir, "documents")
    model = toxicity.train(toxicity.labelled(docs, load(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents from weak labels."""
    docs = load(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs))


@query("op8_licenses")
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families of all documents: a row for each family found in a document."""
    docs = load(spark, sf_dir, "documents")
    return licenses.scan(docs)


@query("op5_decontamination", oracles.LEAKS)
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that leaked into documents."""
    return decontaminate.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query("op11_alignment")
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of two tokenizers over all documents."""
    return align.align(load(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))


@query("op12_near_duplicates", oracles.NEAR)
def op12_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents by five-word shingles and a similarity of 0.85, found by sketches."""
    return setsketch.near_duplicates(load(spark, sf_dir, "documents"), k=5, num=85, den=100)


@query("op13_spelling", oracles.SPELLING)
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spelling.variants(load(spark, sf_dir, "documents"))
