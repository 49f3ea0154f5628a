"""Context-triggered piecewise hashes of documents, and their likeness.

A rolling hash over the last ``WINDOW`` bytes ends a chunk wherever it is -1 modulo the
block size, so boundaries depend on the text around them only and come back after an
insertion or deletion. Each chunk gives one of 64 characters. The block size is
``LEAST_BLOCK`` times a power of two such that a signature has at most ``LENGTH``
characters or so, halved while fewer than half of that come out. Signatures are whole,
also those of texts of one repeated period, where every repetition is a chunk. The fingerprint
``block:signature:signature at twice the block`` can be compared with any of the same
block size, or half or twice that. All sizes are tested on whole texts, vectorised over
a batch of them.

Likeness (0 to 1): equal signatures at a shared block size are 1; others that share no
run of ``RUN`` characters are 0; else 2 * lcs / (sum of lengths), that is 1 minus the
insert-delete edit distance over the sum of lengths; the larger of the shared sizes.

Defined cases: null and empty texts have the fingerprint ``3::`` and are like each
other only; equal texts have equal fingerprints; neighbours follow ascending doc_id
(null first, repeated ids by their text), the last is followed by the first, and a
single document by itself; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import store, vocab, words

WINDOW, LEAST_BLOCK, LENGTH, RUN = 7, 3, 64, 5
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
TEXT_PER_PART = 16 << 20

_TABLE = np.random.default_rng(77).integers(1, 2**32, 256, dtype=np.uint64).astype(np.uint32)
_STEP = np.uint32(0x9E3779B1)


def _rolling(data: np.ndarray) -> np.ndarray:
    """A hash of the last WINDOW bytes at each byte."""
    value = _TABLE[data]
    out = np.zeros(len(data), np.uint32)
    for k in range(WINDOW):
        out[k:] = out[k:] + value[: len(value) - k] * np.uint32(pow(int(_STEP), k, 2**32))
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    return out ^ (out >> np.uint32(13))


class _Batch:
    """Rolling hash and byte sums of some texts laid end to end, each after WINDOW zero bytes."""

    def __init__(self, texts: list[bytes]):
        gap = b"\0" * WINDOW
        data = np.frombuffer(gap + gap.join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(sizes + WINDOW) - sizes
        self.sizes = sizes
        self.roll = _rolling(data)
        up, self.down = words._powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=self.sums[1:])

    def signature(self, i: int, block: int) -> bytes:
        a, n = int(self.starts[i]), int(self.sizes[i])
        ends = np.flatnonzero(self.roll[a : a + n] % np.uint32(block) == np.uint32(block - 1)) + a + 1
        if not n:
            return b""
        if not len(ends) or ends[-1] != a + n:
            ends = np.append(ends, a + n)
        begins = np.concatenate([[a], ends[:-1]])
        h = words.mix((self.sums[ends] - self.sums[begins]) * self.down[begins])
        return ALPHABET[(h >> np.uint64(58)).astype(np.int64)].tobytes()

    def fingerprint(self, i: int) -> str:
        n = int(self.sizes[i])
        block = LEAST_BLOCK
        while block * LENGTH < n:
            block *= 2
        one = self.signature(i, block)
        while block > LEAST_BLOCK and len(one) < LENGTH // 2:
            block //= 2
            one = self.signature(i, block)
        return f"{block}:{one.decode()}:{self.signature(i, 2 * block).decode()}"


def fingerprints(texts: list[bytes]) -> list[str]:
    """Fingerprints of whole texts in UTF-8."""
    out, k = [], 0
    while k < len(texts):
        j, size = k, 0
        while j < len(texts) and (j == k or size + len(texts[j]) < words.CHUNK_BYTES):
            size += len(texts[j]) + WINDOW
            j += 1
        batch = _Batch(texts[k:j])
        out += [batch.fingerprint(i) for i in range(j - k)]
        k = j
    return out


def _lcs(a: str, b: str) -> int:
    """Longest common subsequence, bit-parallel over a without what both begin and end with."""
    same = len(os.path.commonprefix([a, b]))
    a, b = a[same:], b[same:]
    tail = len(os.path.commonprefix([a[::-1], b[::-1]]))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return same + tail + len(a) - row.bit_count()


def _signature_likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    runs = {a[i : i + RUN] for i in range(len(a) - RUN + 1)}
    if not any(b[i : i + RUN] in runs for i in range(len(b) - RUN + 1)):
        return 0.0
    return 2 * _lcs(a, b) / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """Likeness of two fingerprints, 0 to 1."""
    if x == y:
        return 1.0
    (bx, x1, x2), (by, y1, y2) = x.split(":"), y.split(":")
    bx, by = int(bx), int(by)
    if not x1 or not y1:
        return 0.0
    if bx == by:
        return max(_signature_likeness(x1, y1), _signature_likeness(x2, y2))
    if bx == 2 * by:
        return _signature_likeness(x1, y2)
    if by == 2 * bx:
        return _signature_likeness(x2, y1)
    return 0.0


def edited(text: str, following: str) -> str:
    """The text with its last floor(n / 2) code points replaced by as many of the following text's first, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _rows(ids: list, texts: list[str]) -> list[tuple]:
    """Results of all documents but the last, which only follows."""
    own = fingerprints([t.encode("utf-8") for t in texts])
    changed = [edited(a, b).encode("utf-8") for a, b in zip(texts, texts[1:], strict=False)]
    other = fingerprints(changed)
    return [(ids[i], len(texts[i]), hashlib.sha256(changed[i]).hexdigest(), own[i], other[i], likeness(own[i], other[i]), likeness(own[i], own[i + 1])) for i in range(len(changed))]


def neighbours(docs: DataFrame, text_bytes: int = TEXT_PER_PART) -> DataFrame:
    """Fingerprint, edited text's fingerprint and likenesses of every document and its follower.

    One range shuffle brings the texts into order. A partition's last document follows
    into the next partition: each partition writes its first and last text beside its
    results, and these few are paired by partition number afterwards.
    """
    vocab.small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, round(size / text_bytes))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    schema = pa.schema([*_ARROW, ("part", pa.int32()), ("side", pa.string()), ("text", pa.string())])

    def run(batches):
        part, held = TaskContext.get().partitionId(), None

        def edge(side, doc_id, text):
            return pa.RecordBatch.from_pylist([{"doc_id": doc_id, "part": part, "side": side, "text": text}], schema)

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            if not ids:
                continue
            if held is None:
                yield edge("first", ids[0], texts[0])
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
            held = ids[-1], texts[-1]
            if found := _rows(ids, texts):
                yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), _ARROW, strict=True)), *(pa.nulls(len(found), f.type) for f in list(schema)[-3:])], schema=schema)
        if held is not None:
            yield edge("last", *held)

    done = store.table(rows.mapInArrow(run, f"{SCHEMA}, part int, side string, text string"), "piecewise")
    used = sorted(r[0] for r in done.where("side = 'first'").select("part").collect())
    after = dict(zip(used, used[1:] + used[:1], strict=True))
    order = docs.sparkSession.createDataFrame(list(after.items()), "part int, next_part int")
    last = done.where("side = 'last'").select("doc_id", "part", "text").join(order, "part")
    first = done.where("side = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("following"))

    def pair(batches):
        for batch in batches:
            found = [_rows([i, None], [a, b])[0] for i, a, b in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "following")), strict=True)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), _ARROW, strict=True)], schema=_ARROW)

    ends = last.join(first, "next_part").select("doc_id", "text", "following").mapInArrow(pair, SCHEMA)
    return done.where("side is null").select(*_ARROW.names).union(ends)
