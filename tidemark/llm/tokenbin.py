"""Token ids in bit-packed files with block offsets and random access.

A file holds the ids of consecutive documents, each id in the fewest bits that hold the
vocabulary's largest id. Ids are packed in blocks of ``BLOCK`` ids; a block starts on a
byte and its offset is in the index, so any range of ids is read by unpacking only its
blocks, with numpy over whole blocks.

Layout, little-endian: magic ``TMTB0001``; packed blocks; index (uint64 block offsets,
int64 document ids, uint8 null marks of the ids, uint64 first token of each document);
then a footer of uint64 numbers: width, block, tokens, documents, offset of the index;
and the magic again.

Defined cases: a null text is empty; each document ends with the end id; rows are in
ascending order of doc_id (null first, then by text), so repeated ids lie side by
side; an empty table gives no file and no row; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import store, vocab

MAGIC = b"TMTB0001"
BLOCK = 4096
MANIFEST = "part int, path string, documents long, tokens long"
#: Uncompressed text that a file's task handles, about.
TEXT_PER_FILE = 32 << 20


def bits_for(vocabulary_size: int) -> int:
    return max(1, int(vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids in ``width`` bits each, least significant bit first; eight ids fill ``width`` bytes."""
    n = len(ids)
    lanes = np.zeros((-(-n // 8), 8), np.uint64)
    lanes.reshape(-1)[:n] = ids
    out = np.zeros((len(lanes), width + 8), np.uint8)
    for j in range(8):
        byte, shift = divmod(j * width, 8)
        value = lanes[:, j] << np.uint64(shift)
        for k in range((shift + width + 7) // 8):
            out[:, byte + k] |= ((value >> np.uint64(8 * k)) & np.uint64(255)).astype(np.uint8)
    return out[:, :width].tobytes()[: -(-n * width // 8)]


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    """The first n ids of packed bytes, as uint32."""
    if width == 16:
        return np.frombuffer(data, "<u2", n).astype(np.uint32)
    groups = -(-n // 8)
    raw = np.zeros((groups, width + 8), np.uint8)
    flat = np.zeros(groups * width, np.uint8)
    flat[: min(len(data), len(flat))] = np.frombuffer(data, np.uint8)[: len(flat)]
    raw[:, :width] = flat.reshape(groups, width)
    out, mask = np.empty((groups, 8), np.uint32), np.uint64((1 << width) - 1)
    for j in range(8):
        byte, shift = divmod(j * width, 8)
        value = np.zeros(groups, np.uint64)
        for k in range((shift + width + 7) // 8):
            value |= raw[:, byte + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, j] = (value >> np.uint64(shift)) & mask
    return out.reshape(-1)[:n]


class TokenWriter:
    """Writes documents' ids to a stream; holds less than two blocks of ids and the index."""

    def __init__(self, stream, width: int, block: int = BLOCK):
        assert block % 8 == 0 and 1 <= width <= 32
        self.stream, self.width, self.block = stream, width, block
        self.at = stream.write(MAGIC) or len(MAGIC)
        self.offsets, self.docs, self.firsts, self.tokens = [], [], [], 0
        self.held, self.n_held = [], 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.width:
            raise ValueError(f"an id of document {doc_id} needs more than {self.width} bits")
        self.docs.append(doc_id)
        self.firsts.append(self.tokens)
        self.tokens += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block * 16:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        whole = len(ids) if last else len(ids) // self.block * self.block
        size = self.block * self.width // 8
        if whole:
            data = pack(ids[:whole], self.width)
            self.offsets += range(self.at, self.at + len(data), size)
            self.stream.write(data)
            self.at += len(data)
        self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        docs = [0 if d is None else d for d in self.docs]
        nulls = [d is None for d in self.docs]
        for part in (np.array(self.offsets, "<u8"), np.array(docs, "<i8"), np.array(nulls, "u1"), np.array(self.firsts, "<u8"), np.array([self.width, self.block, self.tokens, len(docs), self.at], "<u8")):
            self.stream.write(part.tobytes())
        self.stream.write(MAGIC)
        self.stream.close()


class TokenFile:
    """Random access to a file: ``doc(k)`` and ``tokens(first, last)`` read only the blocks they need."""

    def __init__(self, source):
        self.source, size = source, source.size()
        end = source.read_at(48, size - 48)
        if end[-8:] != MAGIC or source.read_at(8, 0) != MAGIC:
            raise ValueError("not a token file")
        self.width, self.block, self.n_tokens, self.n_docs, index = (int(x) for x in np.frombuffer(end[:40], "<u8"))
        raw = source.read_at(size - 48 - index, index)
        n_blocks = -(-self.n_tokens // self.block)
        cut = np.cumsum([0, 8 * n_blocks, 8 * self.n_docs, self.n_docs, 8 * self.n_docs])
        self.offsets, self.docs, self.nulls, self.firsts = (np.frombuffer(raw[a:b], t) for a, b, t in zip(cut, cut[1:], ("<u8", "<i8", "u1", "<u8"), strict=False))
        self.index = index

    def tokens(self, first: int, last: int) -> np.ndarray:
        """Ids first .. last-1 of the file."""
        if first >= last:
            return np.empty(0, np.uint32)
        a, b = first // self.block, -(-last // self.block)
        begin, end = int(self.offsets[a]), int(self.offsets[b]) if b < len(self.offsets) else self.index
        n = min(b * self.block, self.n_tokens) - a * self.block
        return unpack(self.source.read_at(end - begin, begin), n, self.width)[first - a * self.block : last - a * self.block]

    def span(self, k: int) -> tuple[int, int]:
        return int(self.firsts[k]), int(self.firsts[k + 1]) if k + 1 < self.n_docs else self.n_tokens

    def doc(self, k: int) -> np.ndarray:
        return self.tokens(*self.span(k))

    def scan(self, step: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first token, ids) of all documents, unpacked about ``step`` ids at a time."""
        k = 0
        while k < self.n_docs:
            first = int(self.firsts[k])
            j = max(k + 1, int(np.searchsorted(self.firsts, first + step, "right")) - 1)
            last = int(self.firsts[j]) if j < self.n_docs else self.n_tokens
            ids = self.tokens(first, last)
            for i in range(k, j):
                a, b = self.span(i)
                yield None if self.nulls[i] else int(self.docs[i]), a, ids[a - first : b - first]
            k = j


_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")


#: Texts on which the pieces' ids are compared with the library's before a file's pieces are used at all.
PROBES = ("It's a test of The-x1 y2z, don't!", "naïve CAFÉ über ß 12 345 ... -- '' 'S", "a<|endoftext|>b <|startoftext|> c", "\tx\n\r\x0b\x0c y  z ")


def text_encoder(path: str):
    """text -> uint32 ids by the tokenizers library, with the library's model run once for each distinct piece of a worker's texts.

    Pieces are used only for files whose ids for PROBES are the sums of their pieces';
    any other goes through the library whole.
    """
    tok = vocab.library_tokenizer(path)
    model, shown = tok.model, vocab.byte_symbols()

    def piece(text: str) -> bytes:
        if "<|" in text:
            ids = tok.encode(text, add_special_tokens=False).ids
        else:
            ids = []
            for word in _WORDS.findall(text.lower()):
                word = word if word.isascii() else "".join([shown[b] for b in word.encode()])
                ids += [t.id for t in model.tokenize(word)]
        return np.array(ids, "<u4").tobytes()

    cache = vocab.worker_value(("pieces", path), lambda: vocab.PieceCache(piece))
    look, plain = cache.__getitem__, vocab.PLAIN.fullmatch

    def by_pieces(text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(piece, text.split())), "<u4")

    def fits() -> bool:
        try:
            return all(by_pieces(t).tolist() == tok.encode(t, add_special_tokens=False).ids for t in PROBES)
        except Exception:  # a vocabulary without byte symbols cannot tokenize pieces at all
            return False

    usable = vocab.worker_value(("pieces fit", path), fits)

    def encode(text: str) -> np.ndarray:
        if usable and plain(text):
            return np.frombuffer(b"".join(map(look, text.split())), "<u4")
        return np.array(tok.encode(text, add_special_tokens=False).ids, "<u4")

    return encode


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int, vocabulary_size: int, text_bytes: int = TEXT_PER_FILE) -> list:
    """Encodes all documents and writes a file for each range of doc_id; manifest rows in order of the ranges.

    The ranges come from Spark's sampled range partitioner over (doc_id, hash of the
    text), so even one id that holds a third of the rows is spread. Rows arrive sorted
    and are written as they come. The driver gets a row for each file.
    """
    vocab.small_batches(docs.sparkSession)
    width = bits_for(vocabulary_size)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, round(size / text_bytes))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")

    def write(batches):
        encode, writer, target = text_encoder(path), None, f"{folder}/{uuid.uuid4().hex}.tok"
        end = np.array([end_id], "<u4")
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                writer = writer or TokenWriter(store.open_out(target), width)
                writer.add(doc_id, np.concatenate([encode(text), end]))
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "path": [target], "documents": [len(writer.docs)], "tokens": [writer.tokens]}, pa.schema([("part", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())]))

    return sorted(tuple(r) for r in rows.mapInArrow(write, MANIFEST).collect())


def read_tokens(spark: SparkSession, manifest: list) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and the crc32 of the ids, read from the files."""
    rows, start = [], 0
    for _, path, documents, tokens in manifest:
        rows.append((path, documents, start))
        start += tokens
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches):
        for batch in batches:
            for path, documents, base in zip(*(batch.column(c).to_pylist() for c in ("path", "documents", "base")), strict=True):
                out, seen = [], 0
                with store.open_random(path) as source:
                    for doc_id, first, ids in TokenFile(source).scan():
                        out.append((doc_id, base + first, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        seen += 1
                        if len(out) >= 8192:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                            out = []
                if seen != documents:
                    raise ValueError(f"{path} holds {seen} documents; its manifest says {documents}")
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return store.manifest_frame(spark, rows, "path string, documents long, base long").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
