"""Spelling variants of words: pairless wildcard groups for replacements, deletions joined with the vocabulary for indels.

Words that differ by one replaced code point are the members of one wildcard group
(position, prefix, suffix); a group keeps its size and its two best words, which is all
that a member needs: how many near words it has there, and the best one that is not itself.
Words that differ by one inserted or deleted code point meet where a deletion of the longer
one is a word: deletions are grouped for the shorter word and look it up for the longer one.
No pair of words is ever a row of its own beside those; the rows are vocabulary x length.

Groups and deletions are named by 128 bits of two polynomial hashes whose prefix sums give
all positions of a word in linear time, so a run of a million letters costs a million short
rows and no text is repeated. A vocabulary of V words of length l has V l of them, so equal
names of unequal groups are not expected below 10^15 rows.

Word ids are ranks: the vocabulary is written sorted by falling count, then by code points,
so the best of some words is the one with the smallest id.

Defined cases: null, empty and letterless texts hold no word; a null doc_id is written as an
empty string before the colon; repeated rows count as often as they come; other columns are
ignored; an empty table gives an empty result. Ties of the count go to the smaller word in
code-point order.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import store, vocab, words

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}
#: One run in so many loses a code point.
NOISE = 199
#: Distinct words, and their characters, that a task counts before it reports them.
HELD_WORDS, HELD_CHARS = 200_000, 8_000_000

WILDCARD, DELETION, WHOLE = 0, 1, 2
_BASES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]


def noisy(doc_id: int | None, run: str, noise: int = NOISE) -> str:
    """The run, less one code point if the checksum of id and run says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % noise:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, shortest: int = 6, noise: int = NOISE) -> DataFrame:
    """word, n: how often each word of at least ``shortest`` code points occurs in all whole texts."""
    vocab.small_batches(docs.sparkSession)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        held, chars = Counter(), 0

        def report():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for word, n in Counter(RUN.findall((text or "").translate(LOWER))).items():
                    word = noisy(doc_id, word, noise)
                    if len(word) >= shortest:
                        if word not in held:
                            chars += len(word)
                        held[word] += n
                if len(held) > HELD_WORDS or chars > HELD_CHARS:
                    yield report()
                    held, chars = Counter(), 0
        yield report()

    # tasks report each of their words once, so a frequent word is as many rows as there are tasks
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n"))


def name_rows(spelled: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word's index, kind, two 64-bit hashes) of each word's wildcard groups, different deletions and whole."""
    length = np.array([len(w) for w in spelled], np.int64)
    points = np.frombuffer("".join(spelled).encode("utf-32-le"), np.uint32)
    ends = np.cumsum(length)
    starts = ends - length
    word = np.repeat(np.arange(len(spelled)), length)
    at = np.arange(len(points)) - starts[word]
    last = at == length[word] - 1
    # of a run of equal code points only the last one is taken out, so each deletion comes once
    differs = last.copy()
    differs[:-1] |= points[:-1] != points[1:]
    keys = []
    for j, base in enumerate(_BASES):
        base = base | 1
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(length.max(initial=0)), base, np.uint64)]))
        term = words.mix(points.astype(np.uint64) * np.uint64(4) + np.uint64(2 * j + 1)) * up[at]
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(term, out=sums[1:])
        total = sums[ends] - sums[starts]
        size = words.mix(length.astype(np.uint64) + np.uint64(j << 32))
        shorter = words.mix(length.astype(np.uint64) - np.uint64(1) + np.uint64(j << 32))
        hole = words.mix(at.astype(np.uint64) + np.uint64((j + 2) << 32))
        wild = words.mix(total[word] - term + size[word] + hole)
        i = np.flatnonzero(differs)
        before, after = sums[i] - sums[starts[word[i]]], sums[ends[word[i]]] - sums[i + 1]
        gone = words.mix(before + after * np.uint64(pow(base, -1, 2**64)) + shorter[word[i]])
        keys.append(np.concatenate([wild, gone, words.mix(total + size)]))
    kind = np.concatenate([np.full(len(points), WILDCARD), np.full(int(differs.sum()), DELETION), np.full(len(spelled), WHOLE)])
    return np.concatenate([word, word[differs], np.arange(len(spelled))]), kind, *keys


def _names(known: DataFrame) -> DataFrame:
    """id, kind, h1, h2: a row for each wildcard group, deletion and whole of each word."""
    schema = pa.schema([("id", pa.int64()), ("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                row, kind, h1, h2 = name_rows(batch.column("word").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(batch.column("id").to_numpy()[row]), pa.array(kind.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], schema=schema)

    return known.select("id", "word").mapInArrow(run, "id long, kind int, h1 long, h2 long")


def near_words(known: DataFrame) -> DataFrame:
    """id, n_near, best (the near word of the smallest id) of words that have near words."""
    names = store.table(_names(known), "spelling-names")
    key = ["h1", "h2"]
    # a wildcard stands for one letter of the alphabet that words are made of (90 code points), so a list holds 90 ids at most
    groups = names.where(F.col("kind") == WILDCARD).groupBy(*key).agg(F.array_sort(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1)
    groups = groups.select((F.size("ids") - 1).cast("long").alias("near"), F.col("ids")[0].alias("top"), F.col("ids")[1].alias("second"), F.explode("ids").alias("id"))
    replaced = groups.select("id", "near", F.when(F.col("id") == F.col("top"), F.col("second")).otherwise(F.col("top")).alias("best"))
    gone = names.where(F.col("kind") == DELETION).select("id", *key)
    whole = names.where(F.col("kind") == WHOLE).select(F.col("id").alias("short"), *key)
    longer = gone.join(whole, key).select("id", F.lit(1).cast("long").alias("near"), F.col("short").alias("best"))
    met = gone.groupBy(*key).agg(F.count("*").alias("near"), F.min("id").alias("best"))
    shorter = met.join(whole, key).select(F.col("short").alias("id"), "near", "best")
    return replaced.union(longer).union(shorter).groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """id, root: the end of the path of forms (id, form) from each id.

    Paths double in each round. A form is several times as frequent as its word, so a path
    has as many steps as the logarithm of the largest count, and the rounds are few.
    """
    at = store.table(forms.select("id", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = at.select(F.col("id").alias("root"), F.col("root").alias("further"))
        step = at.join(on, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        nxt = store.table(step, "spelling-roots")
        at = nxt.select("id", "root")
        if not nxt.where("moved").limit(1).count():
            return at


def variants(docs: DataFrame, shortest: int = 6, least: int = 5, factor: int = 5, noise: int = NOISE) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words with ``least`` occurrences: see the module's text."""
    with store.scope():
        counted = store.table(count_words(docs, shortest, noise).where(F.col("n") >= least), "spelling-counts")
        # ids follow the order of the sorted partitions, and stay as they are once written
        known = store.table(counted.orderBy(F.desc("n"), "word").withColumn("id", F.monotonically_increasing_id()), "spelling-words")
        near = store.table(near_words(known), "spelling-near")
        form = known.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
        found = known.join(near, "id").join(form, "best").where(F.col("form_n") >= factor * F.col("n"))
        forms = store.table(found.select("id", F.col("best").alias("to"), "form", "form_n"), "spelling-forms")
        last = roots(forms.select("id", F.col("to").alias("form")))
        root = last.join(known.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
        out = known.join(near.select("id", "n_near"), "id", "left").join(forms.select("id", "form", "form_n"), "id", "left").join(root, "id", "left")
        out = out.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
        out = store.table(out, "spelling-variants")
        store.keep(out)
    return out
