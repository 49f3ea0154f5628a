"""Token counts by a map-side two-tier lookup.

Tier one is a table of frequent pre-tokens and their token counts, counted in a bounded
sample of documents (``SAMPLE_ROWS``) and broadcast; it has at most ``TABLE_ENTRIES`` entries
of at most ``vocab.CACHE_LENGTH`` characters, so its size is bounded. Tier two is each
worker's bounded cache, filled by encoding what the table misses with the tokenizer itself.
The table only saves work: whatever is or isn't in it, every count is the tokenizer's own.
No pre-token is ever shuffled: the sample's few tasks each report their most frequent ones.

A pre-token here is a blank and the run up to the next blank: a lone blank between two
other characters always starts a pre-token of the byte-level pattern, so such runs are
encoded on their own. Texts with other white space next to blanks, and characters
outside ``vocab.PLAIN``, are cut by the tokenizer's pattern or go through it whole.

Defined cases: a null text is empty (0 bytes, 0 tokens, not over the limit); special
strings inside a text count as one token, the library's default.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import store, vocab

TABLE_ENTRIES = 32768
#: Documents that the table is counted in, tasks that count them, and entries that a task keeps and reports.
SAMPLE_ROWS, TASKS, REPORT = 20_000, 8, 65_536

#: The byte-level pattern over PLAIN characters.
_WORDS = re.compile("'(?:[sdmt]|ll|ve|re)| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\\s+(?!\\S)|\\s+")


def pre_tokens(text: str) -> list[str] | None:
    """Runs that are encoded on their own and together make the text; None if only the tokenizer can cut it."""
    if not vocab.PLAIN.fullmatch(text):
        return None
    if "  " in text or " \n" in text or "\n " in text or "\t" in text or "\r" in text or "\x0b" in text or "\x0c" in text or text[:1] == " " or text[-1:] == " ":
        return None if "<|" in text else _WORDS.findall(text)
    head, *rest = text.split(" ")
    return [head, *(" " + x for x in rest)] if head else []


def frequent(docs: DataFrame, path: str, entries: int = TABLE_ENTRIES, rows: int = SAMPLE_ROWS) -> dict[str, int]:
    """The table of tier one: token counts of the most frequent pre-tokens in a sample of documents, by a hash of id and text."""
    sample = store.bounded_sample(docs.where("text is not null").select("doc_id", "text"), docs.count(), rows, "doc_id", "text")
    sample = store.table(sample.select("text"), "count-sample").repartition(TASKS)

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(k for k in pre_tokens(text) or () if len(k) <= vocab.CACHE_LENGTH)
            if len(seen) > 4 * REPORT:
                seen = Counter(dict(seen.most_common(REPORT)))
        top = seen.most_common(REPORT)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([v for _, v in top], pa.int64())], names=["piece", "n"])

    total: Counter = Counter()
    for piece, n in sample.mapInArrow(count, "piece string, n long").collect():
        total[piece] += n
    pieces = sorted(total, key=lambda k: (-total[k], k))[:entries]
    tok = vocab.library_tokenizer(path)
    return {p: len(e.ids) for p, e in zip(pieces, tok.encode_batch(pieces, add_special_tokens=False), strict=True)}


def shaped_as_expected(path: str) -> bool:
    """Whether the file is byte-level BPE without normalizer or prefix blank, whose special strings hold "<|": only then are texts cut here."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    added = [t["content"] for t in spec.get("added_tokens") or []]
    plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    return plain and model.get("type") == "BPE" and not model.get("end_of_word_suffix") and all("<|" in a for a in added)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text; a file of another shape than this module's cuts goes through the library whole."""
    spark = docs.sparkSession
    vocab.small_batches(spark)
    shaped = shaped_as_expected(path)
    table, key = spark.sparkContext.broadcast(frequent(docs, path) if shaped else {}), uuid.uuid4().hex
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        tok = vocab.library_tokenizer(path)
        model, shown = tok.model, vocab.byte_symbols()

        def encode(piece: str) -> int:
            if "<|" in piece:
                return len(tok.encode(piece, add_special_tokens=False).ids)
            return sum(len(model.tokenize("".join([shown[b] for b in word.encode()]))) for word in _WORDS.findall(piece))

        look = vocab.worker_value(("counts", path, key), lambda: vocab.PieceCache(encode, table.value)).__getitem__
        for batch in batches:
            texts, n, size = batch.column("text").to_pylist(), [], []
            for text in texts:
                text = text or ""
                found = pre_tokens(text) if shaped else None
                n.append(sum(map(look, found)) if found is not None else len(tok.encode(text, add_special_tokens=False).ids))
                size.append(len(text.encode("utf-8")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
