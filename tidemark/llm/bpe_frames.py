"""BPE encoding and decoding over DataFrames: one pass over the texts, no shuffle."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import vocab
from tidemark.llm.bpe import Decoder, Encoder


def _tools(path: str):
    encoder = vocab.worker_value(("encoder", path), lambda: Encoder(path))
    return encoder, vocab.worker_value(("decoder", path), lambda: Decoder(encoder.model))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, the SHA-256 of the ids and of the decoded text of every whole text.

    Ids go to both digests and to the decoder part by part as they are final, so a very
    long text or word never lies in memory as ids. A null text is empty; a null doc_id
    stays null; repeated rows get a row each; other columns are ignored.
    """
    vocab.small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        encoder, decoder = _tools(path)
        for batch in batches:
            n, ids_hash, text_hash = [], [], []
            for text in batch.column("text").to_pylist():
                count, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
                for data in encoder.stream(text):
                    count += len(data) // 4
                    of_ids.update(data)
                    of_text.update(decoder.feed(np.frombuffer(data, "<u4").tolist()))
                of_text.update(decoder.finish())
                n.append(count)
                ids_hash.append(of_ids.hexdigest())
                text_hash.append(of_text.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids themselves (array of int; a null text has none; repeated rows get a row each)."""
    vocab.small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        encoder, _ = _tools(path)
        for batch in batches:
            ids = [np.frombuffer(encoder.encode_bytes(t), "<u4").astype(np.int32) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str) -> DataFrame:
    """doc_id and the text that the library's decode gives for the ids (null ids: empty text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.string())])

    def run(batches):
        _, decoder = _tools(path)
        for batch in batches:
            out = [(decoder.feed(x or []) + decoder.finish()).decode("utf-8") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], schema=schema)

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")
