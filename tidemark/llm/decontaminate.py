"""Benchmark decontamination in DataFrame functions only.

A document leaks an item if a window of as many words as the item has a weighted
shingle similarity to it of at least the threshold: sum of the smaller over sum of the
larger counts of each five-word shingle, both taken as multisets.

1. Starts. Sliding a window right to its first shingle that the item has drops none that
   counts, so some best window starts at a shared shingle, or is the document's last.
   Each shared shingle (a join on its hash, done for every shingle of every document)
   proposes that start, held inside the document. A window at the threshold holds at
   least t / (1 + t) of both sizes in places with a shingle of the item; starts whose
   window has fewer with a shingle of any item of the size leave. Both steps lose no
   window that reaches the threshold, in whatever order the item's parts stand.
2. Fingerprints. Distinct windows of each size get a 128-bit SimHash of their shingles,
   and so do the items.
3. Multi-index. With ``RADIUS`` bits allowed to differ, fingerprints are cut into
   RADIUS + 1 blocks: two within the radius agree on a whole block, so the joins on
   (size, block, bits) find all of them. Others leave by their Hamming distance.
4. Verification by the exact similarity.

At a similarity of 0.8 the cosine of the shingle vectors is at least 0.89, so 15 % of
the bits differ on average (19 of 128); the radius of 38 is 4.7 standard deviations
above, where less than one window in 100 000 at the very threshold is lost.

A passage that many documents share is one distinct window; documents meet it again in
a join of written tables whose hot keys AQE may split. The items' shingles and lists of
document ids are broadcast only below ``store.BROADCAST_ROWS`` rows; beyond, Spark's shuffle
joins take over.

Words are runs of letters and digits, in lower case. Defined cases: null and empty
texts and texts or items of fewer than five words never match; rows with a null
doc_id are not reported (and stay in ``keep_clean``); repeated rows are reported once;
items with equal text are reported each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import store

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 38
BITS = 128


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingles_of(words: Column, k: int = SHINGLE) -> Column:
    """Hashes of all windows of k words, in order; none if there are fewer words."""
    count = F.size(words) - (k - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64(F.slice(words, i + 1, k)))).otherwise(F.array().cast("array<bigint>"))


def simhash(shingles: Column) -> list[Column]:
    """Two 64-bit halves: bit b is set if most shingles have it set, where the k-th occurrence of one votes as a feature of its own."""

    def half(values: Column) -> Column:
        def bit(b):
            votes = F.aggregate(values, F.lit(0), lambda acc, x: acc + F.call_function("getbit", x, b).cast("int") * 2 - 1)
            return F.when(votes > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))

        return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(x))

    def numbered(values: Column) -> Column:
        again = lambda x, i: F.size(F.filter(F.slice(values, 1, i), lambda y: y == x))
        each = F.transform(values, lambda x, i: F.when(again(x, i) > 0, F.xxhash64(x, again(x, i), F.lit(2))).otherwise(x))
        return F.when(F.size(F.array_distinct(values)) < F.size(values), each).otherwise(values)

    # bound by a lambda, so that the features are made once and not for each bit
    bound = lambda values: F.get(F.transform(F.array(values), half), F.lit(0))
    return [bound(numbered(shingles)), bound(F.transform(numbered(shingles), lambda x: F.xxhash64(x, F.lit(1))))]


def block_bounds(radius: int = RADIUS) -> list[tuple[int, int, int]]:
    """(half, first bit, bits) of radius + 1 blocks, none across the halves."""
    n = radius + 1
    left = (n + 1) // 2
    out = []
    for half, count in ((0, left), (1, n - left)):
        edges = [64 * i // count for i in range(count + 1)]
        out += [(half, a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    return out


def _blocks(halves: list[Column]) -> Column:
    """An array of (block, bits) structs."""
    return F.array(*(F.struct(F.lit(j).alias("block"), F.shiftrightunsigned(halves[h], a).bitwiseAND(F.lit((1 << n) - 1).cast("bigint")).alias("bits")) for j, (h, a, n) in enumerate(block_bounds())))


def _similarity(a: Column, b: Column) -> Column:
    """Sum of smaller over sum of larger counts of the values of two arrays."""
    same = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, x: acc + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))
    return same / (F.size(a) + F.size(b) - same)


def _starts(at: Column, size: Column, n: Column, threshold: float) -> Column:
    """Starts of the windows of n words that can reach the threshold, from the ascending places of shingles of items of n words."""
    whole = F.least(size, n) - (SHINGLE - 1)
    need = F.greatest(F.lit(1), F.ceil((whole + n - (SHINGLE - 1)) * (threshold / (1 + threshold)) - 1e-6).cast("int"))
    start = lambda p: F.greatest(F.lit(0), F.least(p, size - n))
    full = F.filter(at, lambda p, k: F.get(at, k + need - 1) < start(p) + whole)
    return F.array_distinct(F.transform(full, start))


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, similarity, start (word) of the best window, for each leaked item of each document."""
    with store.scope():
        known = items.where("item_id is not null").select("item_id", words_of(F.col("text")).alias("w"))
        known = known.select("item_id", F.size("w").alias("n"), shingles_of(F.col("w")).alias("own")).where("n >= 5")
        known = store.table(known.select("item_id", "n", "own", *(c.alias(x) for c, x in zip(simhash(F.col("own")), ("g0", "g1"), strict=True))), "items")
        parts = store.table(known.select("n", F.explode("own").alias("h")).distinct(), "item-shingles")

        texts = docs.where("doc_id is not null and text is not null").select("doc_id", words_of(F.col("text")).alias("w"))
        shingled = texts.select("doc_id", F.size("w").alias("size"), shingles_of(F.col("w")).alias("all"))
        # the outer form: the optimiser would push a filter on a plain one's array below the projections and compute the words anew for each shingle
        every = shingled.select("doc_id", "size", F.posexplode_outer("all").alias("pos", "h"))
        hits = every.join(store.checked_broadcast(parts), "h")
        places = hits.groupBy("doc_id", "size", "n").agg(F.sort_array(F.collect_set("pos")).alias("at"))
        starts = store.table(places.select("doc_id", "size", "n", F.explode(_starts(F.col("at"), F.col("size"), F.col("n"), threshold)).alias("start")), "windows")

        ids = store.table(starts.select("doc_id").distinct(), "window-docs")
        # only the documents with windows are cut into words again
        held = docs.where("doc_id is not null and text is not null").select("doc_id", "text").join(store.checked_broadcast(ids), "doc_id", "left_semi")
        again = held.select("doc_id", words_of(F.col("text")).alias("w")).select("doc_id", F.size("w").alias("size"), shingles_of(F.col("w")).alias("all"))
        cut = starts.join(again, ["doc_id", "size"]).select("doc_id", "n", "start", F.slice("all", F.col("start") + 1, F.col("n") - (SHINGLE - 1)).alias("part"))
        cut = store.table(cut.withColumn("key", F.xxhash64("n", "part")), "window-shingles")

        once = cut.groupBy("key", "n").agg(F.any_value("part").alias("part"))
        marked = once.select("key", "n", "part", *(c.alias(x) for c, x in zip(simhash(F.col("part")), ("f0", "f1"), strict=True)))
        marked = store.table(marked, "window-marks")
        probe = marked.select("key", "n", "f0", "f1", F.inline(_blocks([F.col("f0"), F.col("f1")])))
        index = known.select("item_id", "n", "g0", "g1", F.inline(_blocks([F.col("g0"), F.col("g1")])))
        near = probe.join(index, ["n", "block", "bits"])
        distance = F.bit_count(F.col("f0").bitwiseXOR(F.col("g0"))) + F.bit_count(F.col("f1").bitwiseXOR(F.col("g1")))
        near = near.where(distance <= RADIUS).select("key", "n", "item_id").distinct()
        found = near.join(marked.select("key", "n", "part"), ["key", "n"]).join(known.select("item_id", "own"), "item_id")
        found = found.withColumn("similarity", _similarity(F.col("part"), F.col("own"))).where(F.col("similarity") >= threshold)
        found = store.table(found.select("key", "n", "item_id", "similarity"), "window-leaks")
        store.keep(cut, found)

    told = cut.select("doc_id", "n", "start", "key").join(found, ["key", "n"])
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "start"))
    told = told.groupBy("doc_id", "item_id").agg(best.alias("best"))
    return told.select("doc_id", "item_id", (-F.col("best.s")).alias("similarity"), F.col("best.start").alias("start"))


def keep_clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that leak no item."""
    with store.scope():
        bad = store.table(leaks(docs, items, threshold).select("doc_id").distinct(), "leaky")
        store.keep(bad)
    return docs.join(store.checked_broadcast(bad), "doc_id", "left_anti").select(docs.columns)
