"""Alignment of two tokenizers' tokens of the same text.

The ends of a side's tokens are cumulative byte lengths, and the ends of the two sides meet.
Where both sides end the text is cut, and the cuts number the groups. Between two
neighbouring ends lies exactly one overlap of an A and a B token, so each different end is
a link, with the next token of either side that ends there or later: a document of a and b
tokens has fewer than a + b of them, even where one group spans all of it, and no group is
multiplied out.

Both sides cut at a single blank between two other characters, so a text's groups and links
are those of its runs between blanks, one after the other. The tasks that encode (``aligned``)
let the ends of different runs meet once, keep the last runs' links and groups within bounds
(``KEPT``), and put the documents together: a row a document, with its different id pairs
and how often it links them. No token is a row there. ``token_table`` and ``links`` are the
same alignment by rows, for whoever needs each link with its place: tokens are exploded,
their ends are windowed sums that meet in a grouping by (document, end), and all of it keeps
the table's buckets.

Corpus-wide counts of linked id pairs are grouped from the documents' pairs with partial
sums. Pairs that hold at least one in ``HOT_PAIRS`` of all links, so at most that many, are
broadcast; all others are joined by their ids, where a document has one row for a pair.

Defined cases: null and empty texts, and texts whose joined token bytes differ from blank +
text (a character that a vocabulary rewrites), have no tokens: zeros, and '' for the digest.
Special strings inside texts are plain text. Each of repeated rows, and each row of a
repeated or null doc_id, is aligned by itself. Ties for the highest count all count as best.
Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import store, token_count, vocab

#: Documents of a bucket of tokens, and most buckets.
BUCKET_ROWS, MOST_BUCKETS = 1000, 100_000
#: Runs that are encoded at once.
ENCODED = 4096
#: Aligned runs that a worker's younger generation holds before it becomes the older, and the longest run kept: some 250 bytes each, 1 KB at most.
KEPT, KEPT_LENGTH = 120_000, 24
#: White space that is not a single blank between two other characters.
_BESIDE = re.compile("^ | $|  |[\t\r\x0b\x0c]| \n|\n ")
#: A pair of ids is broadcast if it holds at least one in so many of all links.
HOT_PAIRS = 250_000


class Sides:
    """Both tokenizers with the bytes of each id: A a byte-level file of the tokenizers library, B a sentencepiece model.

    Neither goes on over a single blank between two other characters, so the texts of a batch
    are cut there and each different run is encoded once. Texts with other white space beside
    blanks, or with characters beyond ``vocab.PLAIN``, are encoded whole. ``encode`` holds
    nothing from batch to batch; ``align`` keeps the last batches' runs, within bounds.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = {c: i for i, c in enumerate(vocab.byte_symbols())}
        entries = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in entries]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        # no entry of B may go on beyond a blank, and A must have the pattern that starts a pre-token there
        self.runs = token_count.shaped_as_expected(a_path) and not any("▁" in p.lstrip("▁") for p in pieces)

        self.ranked = self._ranked(a_path) if self.runs else None
        self.size = [np.array([len(x) for x in of], np.int64) for of in (self.a_bytes, self.b_bytes)]
        # an id as it stands in a group and at its end: entry 2 * id + whether the group ends
        self.marks = [m for of, ends in ((self.a_bytes, "|"), (self.b_bytes, ";")) for i in range(len(of)) for m in (b"%d," % i, f"{i}{ends}".encode())]
        self.young, self.older = {}, {}

    def _ranked(self, path: str):
        """A's own entries and merges as the faster encoder by ranks, where ids after the single bytes follow the merges' order; else None."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if [model["vocab"].get(m) for m in merged] != list(range(256, 256 + len(merged))):
            return None
        ranks = {self.a_bytes[i]: i for i in range(256 + len(merged))}
        return tiktoken.Encoding("a", pat_str=token_count._WORDS.pattern, mergeable_ranks=ranks, special_tokens={})

    def _runs(self, runs: list[str]) -> list[tuple | None]:
        """(A's ids of blank + run, B's ids of run) of each run of plain characters, or None where B's bytes are others."""
        a = map(self.ranked.encode_ordinary, [f" {r}" for r in runs]) if self.ranked else (e.ids for e in self.a.encode_batch_fast([f" {r}" for r in runs], add_special_tokens=False))
        return [(x, y) if self._joined(y, self.b_bytes, r) else None for r, x, y in zip(runs, a, self.b.encode(runs, num_threads=1), strict=True)]

    def _whole(self, text: str) -> tuple | None:
        a, b = self.a.encode(f" {text}", add_special_tokens=False).ids, self.b.encode(text)
        return (a, b) if self._joined(a, self.a_bytes, text) and self._joined(b, self.b_bytes, text) else None

    @staticmethod
    def _joined(ids, of: list[bytes], text: str) -> bool:
        return b"".join([of[i] for i in ids]) == f" {text}".encode()

    def _cut(self, text: str | None) -> list[str] | None:
        """The runs of a text that may be cut at its blanks, else None."""
        return text.split(" ") if text and self.runs and vocab.PLAIN.fullmatch(text) and not _BESIDE.search(text) else None

    def meet(self, units: list[tuple | None]) -> list[tuple]:
        """(links, groups, n_a) of each unit's ids: a * B's entries + b of each overlap as 8 bytes, ``a1,a2|b1;`` of each group; () for None."""
        own = [u for u in units if u is not None]
        if not own:
            return [()] * len(units)
        n = [np.array([len(u[k]) for u in own], np.int64) for k in (0, 1)]
        ids = [np.fromiter(chain.from_iterable([u[k] for u in own]), np.int64, int(n[k].sum())) for k in (0, 1)]
        # the units stand one after the other, so both sides end where a unit does
        a_end, b_end = (np.cumsum(self.size[k][ids[k]]) for k in (0, 1))
        ends = np.sort(np.concatenate([a_end, b_end]), kind="stable")
        ends = ends[np.append(ends[1:] != ends[:-1], True)]
        at = [np.searchsorted(e, ends) for e in (a_end, b_end)]
        both = (a_end[at[0]] == ends) & (b_end[at[1]] == ends)
        links = (ids[0][at[0]] * len(self.b_bytes) + ids[1][at[1]]).tobytes()
        # tokens of either side up to each cut; a group has its A ids, then its B ids
        upto = [x[both] + 1 for x in at]
        marks, base = np.empty(len(ids[0]) + len(ids[1]), np.int64), (0, 2 * len(self.a_bytes))
        for k, others in ((0, np.append(0, upto[1][:-1])), (1, upto[0])):
            last = np.zeros(len(ids[k]), np.int64)
            last[upto[k] - 1] = 1
            marks[np.arange(len(last)) + others[np.cumsum(last) - last]] = base[k] + 2 * ids[k] + last
        shown = [self.marks[i] for i in marks.tolist()]
        upto_unit = np.cumsum(n[0])
        cut_link = np.append(0, np.searchsorted(ends, a_end[upto_unit - 1]) + 1) * 8
        cut_link, cut_mark = cut_link.tolist(), np.append(0, upto_unit + np.cumsum(n[1])).tolist()
        made = iter([(links[cut_link[i] : cut_link[i + 1]], b"".join(shown[cut_mark[i] : cut_mark[i + 1]]), len(own[i][0])) for i in range(len(own))])
        return [next(made) if u is not None else () for u in units]

    def align(self, texts: list[str | None]) -> list[tuple[list, list, int]]:
        """(links of each unit, groups of each unit, n_a) of each text, as ``meet`` has them; empty where a text has no tokens."""
        cut = [self._cut(t) for t in texts]
        known, new = {}, []
        for run in {r for runs in cut if runs for r in runs}:
            value = self.young.get(run)
            if value is None:
                value = self.older.get(run)
            if value is None:
                new.append(run)
            else:
                known[run] = value
        for i in range(0, len(new), ENCODED):
            some = new[i : i + ENCODED]
            known.update(zip(some, self.meet(self._runs(some)), strict=True))
        self.young.update((r, v) for r, v in known.items() if len(r) <= KEPT_LENGTH)
        if len(self.young) > KEPT:
            self.young, self.older = {}, self.young
        out = []
        for text, runs in zip(texts, cut, strict=True):
            units = [known[r] for r in runs] if runs is not None else self.meet([self._whole(text)]) if text else []
            out.append(([], [], 0) if not all(units) else ([u[0] for u in units], [u[1] for u in units], sum([u[2] for u in units])))
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ends, ids): A's ids of blank + text, then B's ids of text, counted on from A's, of each text in turn.

        A text has no ids where either's bytes are not those of blank + text, or there is no text.
        """
        cut = [self._cut(t) for t in texts]
        index: dict = {r: i for i, r in enumerate({r for runs in cut if runs for r in runs})}
        names, units = list(index), []
        for i in range(0, len(names), ENCODED):
            units += self._runs(names[i : i + ENCODED])
        parts = []
        for text, runs in zip(texts, cut, strict=True):
            if runs is not None:
                parts.append([index[r] for r in runs])
            elif text:
                parts.append([len(units)])
                units.append(self._whole(text))
            else:
                parts.append([])
        parts = [[] if any(units[i] is None for i in own) else own for own in parts]
        unit = np.fromiter(chain.from_iterable(parts), np.int64)
        doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        sides = [_gathered([u[k] if u else () for u in units], unit, doc, len(parts)) for k in (0, 1)]
        (n_a, a), (n_b, b) = sides
        ends = np.concatenate([[0], np.cumsum(n_a + n_b)])
        ids = np.empty(ends[-1], np.int32)
        at = np.arange(len(ids)) - np.repeat(ends[:-1], n_a + n_b) < np.repeat(n_a, n_a + n_b)
        ids[at], ids[~at] = a, b + len(self.a_bytes)
        return ends, ids


def _gathered(lists: list, unit: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(length of each document, all ids): the lists of the units one after the other."""
    size = np.array([len(x) for x in lists], np.int64)
    flat = np.fromiter(chain.from_iterable(lists), np.int32, int(size.sum()))
    start, own = np.cumsum(size) - size, size[unit]
    at = np.repeat(start[unit] - (np.cumsum(own) - own), own) + np.arange(own.sum())
    return np.bincount(doc, own, docs).astype(np.int64), flat[at]


def entry_lengths(spark: SparkSession, a_path: str, b_path: str) -> DataFrame:
    """tok, side, id, bytes of the entries of both vocabularies; B's toks go on where A's end."""
    sides = Sides(a_path, b_path)
    rows = [(i, 0, i, len(x)) for i, x in enumerate(sides.a_bytes)]
    rows += [(len(rows) + i, 1, i, len(x)) for i, x in enumerate(sides.b_bytes)]
    return spark.createDataFrame(rows, "tok int, side int, id int, bytes int")


def token_table(docs: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, str]:
    """(row, doc_id, toks (ids of A, then those of B, counted on from A's vocabulary) of each row of docs, the table's name): written, so row numbers are fixed, and bucketed by row."""
    vocab.small_batches(docs.sparkSession)
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("toks", pa.list_(pa.int32()))])

    def run(batches):
        sides = vocab.worker_value(("sides", a_path, b_path), lambda: Sides(a_path, b_path))
        for batch in batches:
            ends, ids = sides.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))], schema=schema)

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark, rows = docs.sparkSession, docs.count()
    buckets = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // BUCKET_ROWS))
    name = f"align_{uuid.uuid4().hex}"
    # dealt as the buckets are, so each task writes one file
    made = numbered.repartition(buckets, "row").mapInArrow(run, "row long, doc_id long, toks array<int>")
    made.write.bucketBy(buckets, "row").option("path", f"{store.shared_dir(spark, 'align-tokens')}").option("compression", "zstd").saveAsTable(name)
    return spark.table(name), name


def links(tokens: DataFrame, lengths: DataFrame) -> DataFrame:
    """row, end, a, b, a_end, b_end, cut, group: each overlap of an A and a B token, by the byte where it ends.

    a_end and b_end hold the id if the token itself ends there, else null; cut is true where
    both do. Groups are counted from the last one of a document.
    """
    each = tokens.select("row", F.posexplode("toks").alias("pos", "tok"))
    # both vocabularies' entries, so bounded by the files
    each = each.join(F.broadcast(lengths), "tok")
    upto = Window.partitionBy("row", "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = each.select("row", "side", "id", F.sum("bytes").over(upto).alias("end"))
    side = lambda k: F.max(F.when(F.col("side") == k, F.col("id")))
    met = ends.groupBy("row", "end").agg(side(0).alias("a_end"), side(1).alias("b_end")).withColumn("cut", F.col("a_end").isNotNull() & F.col("b_end").isNotNull())
    # from the last end on, the latest seen id of a side is that of the token around
    back = Window.partitionBy("row").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    around = lambda c: F.last(c, ignorenulls=True).over(back)
    return met.select("row", "end", around("a_end").alias("a"), around("b_end").alias("b"), "a_end", "b_end", "cut", F.sum(F.col("cut").cast("long")).over(back).alias("group"))


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links (pair, times) of each row of docs: ``links`` has the different pairs, as a * B's entries + b."""
    vocab.small_batches(docs.sparkSession)
    pairs = pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int32())]))
    names = ("n_a", "n_b", "n_groups", "n_links")
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in names), ("groups_sha256", pa.string()), ("links", pairs)])

    def run(batches):
        sides = vocab.worker_value(("sides", a_path, b_path), lambda: Sides(a_path, b_path))
        many = len(sides.a_bytes) * len(sides.b_bytes)
        for batch in batches:
            found = sides.align(batch.column("text").to_pylist())
            groups = [b"".join(g)[:-1] for _, g, _ in found]
            flat = [b"".join(x) for x, _, _ in found]
            n_a, n_links = np.array([n for *_, n in found], np.int64), np.array([len(x) // 8 for x in flat], np.int64)
            n_groups = np.array([g.count(b"|") for g in groups], np.int64)
            # an end is one of A, of B, or of both
            n_b = n_links + n_groups - n_a
            keys, times = np.unique(np.repeat(np.arange(len(found)), n_links) * many + np.frombuffer(b"".join(flat), np.int64), return_counts=True)
            ends = np.searchsorted(keys, np.arange(len(found) + 1) * many).astype(np.int32)
            each = pa.StructArray.from_arrays([pa.array(keys % many), pa.array(times.astype(np.int32))], fields=list(pairs.value_type))
            digests = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
            columns = [batch.column("row"), batch.column("doc_id"), *map(pa.array, (n_a, n_b, n_groups, n_links)), pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(ends), each).cast(pairs)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = numbered.mapInArrow(run, f"row long, doc_id long, {', '.join(f'{c} long' for c in names)}, groups_sha256 string, links array<struct<pair: long, times: int>>")
    # written, so row numbers are fixed and texts are encoded once
    return store.table(made, "align-links")


def pair_counts(each: DataFrame, b_entries: int) -> DataFrame:
    """pair, n, best: how many links hold a pair of ids, and whether no other pair of its B id has more."""
    n = store.table(each.groupBy("pair").agg(F.sum("times").alias("n")), "align-pairs")
    b = F.col("pair") % b_entries
    # a row for each of B's entries at most
    top = F.broadcast(n.groupBy(b.alias("b")).agg(F.max("n").alias("top")))
    return store.table(n.withColumn("b", b).join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "align-counts")


def align(docs: DataFrame, a_path: str, b_path: str, hot: int = HOT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of docs."""
    with store.scope():
        found = aligned(docs, a_path, b_path)
        each = found.select("row", F.inline("links"))
        counts = pair_counts(each, len(Sides(a_path, b_path).b_bytes))
        total = counts.agg(F.sum("n")).first()[0] or 0
        often = F.col("n") * hot >= total
        summed = (F.sum(F.col("n") * F.col("times")).alias("n"), F.sum(F.when(F.col("best"), F.col("times"))).alias("best"))
        # a row's broadcast pairs are summed at once, under null; each other pair stays a row
        known = each.join(F.broadcast(counts.where(often)), "pair", "left").withColumn("pair", F.when(F.col("n").isNull(), F.col("pair")))
        known = store.table(known.groupBy("row", "pair").agg(*summed, F.sum("times").alias("times")), "align-known")
        seldom = known.where("pair is not null").select("row", "pair", "times").join(counts.where(~often), "pair").groupBy("row").agg(*summed)
        sums = known.where("pair is null").select("row", "n", "best").union(seldom).groupBy("row").agg(F.sum("n").alias("n"), F.sum("best").alias("best"))
        count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
        out = found.drop("links").join(sums, "row", "left")
        out = out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", count("best").alias("n_best"), count("n").alias("count_sum"), "groups_sha256")
        out = store.table(out, "align-documents")
        store.keep(out)
    return out


def drop_tokens(spark: SparkSession, name: str) -> None:
    """Deletes a table of tokens with its files."""
    path = spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").first()["data_type"]
    spark.sql(f"DROP TABLE {name}")
    store.drop(path, spark)
