"""N-gram Jaccard join: classes of documents linked by the exact Jaccard similarity of their shingle sets.

Set relations decide what need not be computed:

1. Equal sets share their answers: each class of equal sets has one representative.
2. A set needs company to have a linked set: of the first n (1 - t) + k shingles of linked
   sets, by their hashes, at least k are the same (``_company``). One grouping of these
   prefixes tells how many of a set's are its alone; sets with too many leave.
3. Index lists are blocked by position: sets of a size class are cut, in the order of
   their shingle hashes, into more position blocks than linked sets can differ in
   shingles, so linked sets agree on several whole blocks. A list holds the sets that
   agree on one block; all blocks on which sets differ are skipped together. A set
   writes a row for each block, so the lists grow in proportion to the texts.
4. A set that does not find company in as many lists as linked sets must share leaves,
   and so does one with more than its share of shingles that no other remaining set has
   (if J(x, y) >= t, at least t of x's shingles are y's too).
5. Answers are derived from a similar set's answers: in each list the set that
   meets most others, over all its lists, leads. First each set is compared with one
   leader. Sets linked to one leader are one class; then only pairs of a list that are
   not yet in one class are open. Two sets of one leader are looked up by their few
   differences from it, rarest first (``_within``), and their similarity follows from
   those differences alone (``_derived``); only sets of different leaders are taken from
   the lists themselves (``_across``) and compared in full.

No group is collected anywhere: lists are joined, hot lists meet as rows in joins that
AQE may split, and classes are found by label propagation over written tables.

Defined cases: null, empty and white-space texts have an empty set, size 0, and are
their own class (component_id is their own id); repeated rows are rows of one class;
rows with a null doc_id link others like any row, but are ignored when the smallest id
of a class is taken (their component_id is null only if the whole class has no id); an
empty table gives an empty result; other columns are ignored. Sets count as equal when
their 64-bit digests are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import store, vocab, words


def _differ(n, num: int, den: int):
    """The most shingles that a set of n and a larger linked set don't share: |x ^ y| = |x | y| - |x & y| <= n (1 - t) / t."""
    return n * (den - num) // num


def _spare(n, num: int, den: int):
    """Blocks that a set of n writes beyond the number at which a linked set must agree on one."""
    return np.maximum(3, _differ(n, num, den) // 5)


class SizeClasses:
    """Size classes such that linked sets are in one or in neighbouring classes, and the position blocks of each."""

    def __init__(self, num: int, den: int):
        low = [1]
        while low[-1] < 1 << 40:
            low.append(low[-1] * den // num + 1)
        self.num, self.den, self.low = num, den, np.array(low)

    def of(self, n):
        """The class of a set of n shingles."""
        return np.searchsorted(self.low, n, "right") - 1

    def written(self, n):
        """Blocks that a set of n writes: the first so many of its class."""
        return _differ(n, self.num, self.den) + 1 + _spare(n, self.num, self.den)

    def blocks(self, c):
        """Blocks of class c: as many as its largest sets write."""
        return self.written(self.low[np.asarray(c) + 1] - 1)


def block_keys(rows: np.ndarray, tokens: np.ndarray, n: np.ndarray, c: np.ndarray, sizes: SizeClasses) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, need of each row) for the blocks that rows write in classes c: equal keys mean equal blocks.

    Of the blocks that both of two linked sets write they differ in at most ``_differ`` of
    the smaller one, so they agree on 1 + ``_spare`` or more. A set with at most so many
    empty blocks, less one, agrees with each linked set on a block that is not empty, and
    leaves its empty ones out; only a set with more writes them too. ``need`` is the number
    of written blocks on which a linked set agrees at least.
    """
    count, most = sizes.blocks(c), sizes.written(n)
    part = ((tokens >> np.uint64(32)) * count[rows].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (part[1:] != part[:-1])]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words.mix(tokens + np.uint64(7)))])
    total = np.diff(np.concatenate([sums[first], sums[-1:]]))
    held = np.diff(np.concatenate([first, [len(tokens)]])).astype(np.uint64)
    row, part = rows[first], part[first]
    own = part < most[row]
    row, part, total, held = row[own], part[own], total[own], held[own]
    empty = most - np.bincount(row, minlength=len(n))
    agreed = 1 + _spare(-(-n * sizes.num // sizes.den), sizes.num, sizes.den)
    extra = [(np.full(len(gap), r), gap) for r in np.flatnonzero(empty >= agreed) for gap in [np.setdiff1d(np.arange(most[r]), part[row == r])]]
    if extra:
        at, gap = (np.concatenate(x) for x in zip(*extra, strict=True))
        row, part = np.concatenate([row, at]), np.concatenate([part, gap])
        total, held = (np.concatenate([x, np.zeros(len(gap), np.uint64)]) for x in (total, held))
    key = words.mix(words.mix(total + c[row].astype(np.uint64) * np.uint64(2) + np.uint64(1)) + part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + held)
    return row, key, np.where(empty >= agreed, agreed, agreed - empty)


def _sets(column: pa.Array, k: int):
    """(first row, last row, bounds, shingle hashes): row i of the chunk has the sorted distinct hashes bounds[i] to bounds[i + 1]."""
    for a, b, data, offsets in words.chunks(column):
        r, h, _ = words.shingles(*words.words(data, offsets)[:2], k)
        r, h = words.distinct(r, h)
        yield a, b, np.searchsorted(r, np.arange(b - a + 1)), h, r


def _digest(own: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def set_table(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, cls (equal for equal sets; null for empty ones)."""
    vocab.small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.int64())])

    def run(batches):
        for batch in batches:
            n, cls = [], []
            for a, b, bounds, h, _ in _sets(batch.column("text"), k):
                n += np.diff(bounds).tolist()
                cls += [_digest(h[bounds[i] : bounds[i + 1]]) if bounds[i] < bounds[i + 1] else None for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(cls, pa.int64())], schema=schema)

    return store.table(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, cls long"), "jaccard-sets")


def _heads(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """doc_id and text of one row of each class; rows without an id, and other texts of a head's id, may come too."""
    head = store.table(sets.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("head")), "jaccard-heads")
    copies = sets.join(head, "cls").groupBy("doc_id").agg(F.min(F.col("doc_id") != F.col("head")).alias("copy")).where("copy").select("doc_id")
    return docs.select("doc_id", "text").join(store.checked_broadcast(store.table(copies, "jaccard-copies")), "doc_id", "left_anti")


def _texts_of(heads: DataFrame, sets: DataFrame, leave: DataFrame) -> DataFrame:
    """text of the heads with a class that does not leave; rows without an id stay."""
    rest = sets.where("cls is not null and doc_id is not null").join(leave, "cls", "left_anti").select("doc_id").distinct()
    rest = store.checked_broadcast(store.table(rest, "jaccard-rest"))
    return heads.where("doc_id is not null").join(rest, "doc_id", "left_semi").union(heads.where("doc_id is null")).select("text")


def _company(texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """cls of the sets of which enough of the first shingles occur in other sets' first shingles too.

    With x's shingles in order of their hashes, x and a linked y share at least t |x|; of
    these, the k-th in order is among the first |x| - t |x| + k of x, and so for y. Hence the
    prefixes of that length share k. k grows with the size, and a linked set may be smaller
    by t. A shingle of one prefix only is counted for its set when prefixes are grouped by
    shingle, so nothing goes back to the sets but those counts.
    """
    schema = pa.schema([("token", pa.int64()), ("cls", pa.int64()), ("most", pa.int32())])

    def run(batches):
        for batch in batches:
            for a, b, bounds, h, r in _sets(batch.column("text"), k):
                n = np.diff(bounds)
                cls = np.array([_digest(h[bounds[i] : bounds[i + 1]]) for i in range(b - a)], np.int64)
                length = np.minimum(n, n - -(-n * num // den) + _common(n))
                # how many of its prefix a set may have alone; sets that cannot differ from a linked one are equal to it and leave
                most = np.where(_differ(n, num, den) > 0, length - np.minimum(_common(-(-n * num // den)), length), -1)
                first = (np.arange(len(h)) - bounds[r] < length[r]) & (most[r] >= 0)
                if first.any():
                    at = r[first]
                    yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(cls[at]), pa.array(most[at].astype(np.int32))], schema=schema)

    each = texts.mapInArrow(run, "token long, cls long, most int")
    # where there is one row, the least values are its own
    met = each.groupBy("token").agg(F.count("*").alias("sets"), F.min("cls").alias("cls"), F.min("most").alias("most"))
    alone = met.where("sets = 1").groupBy("cls").agg((F.count("*") > F.max("most")).alias("leaves"))
    return alone.where("leaves").select("cls")


def _common(n):
    """Shingles that the prefixes of linked sets share at least, if the smaller has n."""
    return np.maximum(2, n // 10)


def _lists(texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """sig, cls, c, n, need: a row for each block that a set writes, in its own size class c and, if it has linked sets there, in the next."""
    schema = pa.schema([("sig", pa.int64()), ("cls", pa.int64()), ("c", pa.int32()), ("n", pa.int32()), ("need", pa.int32())])

    def run(batches):
        sizes = SizeClasses(num, den)
        for batch in batches:
            for a, b, bounds, h, r in _sets(batch.column("text"), k):
                n = np.diff(bounds)
                cls = np.array([_digest(h[bounds[i] : bounds[i + 1]]) for i in range(b - a)], np.int64)
                c = sizes.of(np.maximum(n, 1))
                for at, here in ((c, _differ(n, num, den) > 0), (c + 1, n * den // num >= sizes.low[c + 1])):
                    # sets that cannot differ from a linked one are equal to it: they have no lists
                    here &= _differ(n, num, den) > 0
                    keep = here[r]
                    if not keep.any():
                        continue
                    row, key, need = block_keys(r[keep], h[keep], n, at, sizes)
                    row, key = row[here[row]], key[here[row]]
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (key.view(np.int64), cls[row], at[row].astype(np.int32), n[row].astype(np.int32), need[row].astype(np.int32))], schema=schema)

    return texts.mapInArrow(run, "sig long, cls long, c int, n int, need int")


def _tokens(docs: DataFrame, sets: DataFrame, live: DataFrame, k: int) -> DataFrame:
    """cls, n, tokens (sorted hashes) of each class of live."""
    heads = sets.join(store.checked_broadcast(live), "cls", "left_semi").groupBy("cls").agg(F.min("doc_id").alias("live_id"))
    heads = store.table(heads, "jaccard-live-heads")
    texts = docs.select("doc_id", "text").join(store.checked_broadcast(heads), F.col("doc_id") == F.col("live_id")).select("cls", "text")
    unnamed = store.table(heads.where("live_id is null").select(F.col("cls").alias("seen")), "jaccard-unnamed")
    schema = pa.schema([("cls", pa.int64()), ("n", pa.int32()), ("tokens", pa.binary()), ("seen", pa.int64())])

    def run(batches):
        for batch in batches:
            n, blob, seen = [], [], []
            for a, b, bounds, h, _ in _sets(batch.column("text"), k):
                for i in range(b - a):
                    own = h[bounds[i] : bounds[i + 1]]
                    n.append(len(own))
                    seen.append(_digest(own))
                    blob.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("cls").cast(pa.int64()), pa.array(n, pa.int32()), pa.array(blob, pa.binary()), pa.array(seen, pa.int64())], schema=schema)

    kind = "cls long, n int, tokens binary, seen long"
    found = texts.mapInArrow(run, kind).where("cls = seen").select("cls", "n", "tokens")
    if unnamed.count():
        bare = docs.where("doc_id is null").select(F.lit(None).cast("long").alias("cls"), "text").mapInArrow(run, kind)
        found = found.union(bare.join(unnamed, "seen", "left_semi").select(F.col("seen").alias("cls"), "n", "tokens"))
    return store.table(found.dropDuplicates(["cls"]), "jaccard-tokens")


def _shared(tokens: DataFrame) -> DataFrame:
    """cls, own: how many of its shingles no other set has; only sets that have some."""
    schema = pa.schema([("token", pa.int64()), ("cls", pa.int64())])

    def run(batches):
        for batch in batches:
            own = [np.frombuffer(v.as_buffer(), np.int64) for v in batch.column("tokens")]
            if own:
                cls = np.repeat(batch.column("cls").to_numpy(), [len(x) for x in own])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), pa.array(cls)], schema=schema)

    each = tokens.select("cls", "tokens").mapInArrow(run, "token long, cls long")
    once = each.groupBy("token").agg(F.count("*").alias("sets"), F.min("cls").alias("cls")).where("sets = 1")
    return once.groupBy("cls").agg(F.count("*").alias("own"))


def _compare(pairs: DataFrame, live: DataFrame) -> DataFrame:
    """a, b and common, union of each pair's sets."""
    sets = live.select("cls", "tokens")
    both = pairs.join(sets.withColumnsRenamed({"cls": "a", "tokens": "x"}), "a").join(sets.withColumnsRenamed({"cls": "b", "tokens": "y"}), "b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("common", pa.int64()), ("either", pa.int64())])

    def run(batches):
        for batch in batches:
            common, either = [], []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                same = len(np.intersect1d(x, y, assume_unique=True))
                common.append(same)
                either.append(len(x) + len(y) - same)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(either, pa.int64())], schema=schema)

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, common long, either long")


def components(links: DataFrame) -> DataFrame:
    """node, comp: the smallest node reachable over links (a, b); only nodes that have a link.

    Labels go to neighbours and jump along labels until nothing changes; each round is a
    written table, so a lost executor costs no more than a task.
    """
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    edges = store.table(both, "links")
    labels = store.table(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("seen"))
        step = labels.join(near, "node").select("node", F.least("comp", "seen").alias("to"), F.col("comp").alias("was"))
        jump = labels.select(F.col("node").alias("to"), F.col("comp").alias("further"))
        nxt = store.table(step.join(jump, "to").select("node", F.least("to", "further").alias("comp"), "was"), "labels")
        changed = nxt.where("comp <> was").limit(1).count()
        labels = nxt.select("node", "comp")
        if not changed:
            return labels


def _members(docs: DataFrame, sets: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Index lists (sig, cls, n, shared) and token sets (cls, n, tokens) of the classes that can have a linked class."""
    heads = _heads(docs, sets)
    leave = store.table(_company(heads.select("text"), k, num, den), "jaccard-alone")
    lists = store.table(_lists(_texts_of(heads, sets, leave), k, num, den), "jaccard-lists")
    many = store.table(lists.groupBy("sig").agg(F.count("*").alias("size")).where("size > 1").select("sig"), "jaccard-many")
    met = store.table(lists.join(store.checked_broadcast(many), "sig", "left_semi").dropDuplicates(["sig", "cls"]), "jaccard-met")
    live = met.groupBy("cls", "c").agg(F.count("*").alias("lists"), F.max("need").alias("need")).where("lists >= need")
    live = store.table(live.select("cls").distinct(), "jaccard-live")
    tokens = _tokens(docs, sets, live, k)
    least = tokens.select("cls", "n").join(_shared(tokens), "cls", "left").select("cls", (F.col("n") - F.coalesce("own", F.lit(0))).cast("int").alias("shared"), "n")
    least = store.table(least.where(f"shared * {den}L >= n * {num}L").select("cls", "shared"), "jaccard-shared")
    return store.table(met.select("sig", "cls", "n").join(store.checked_broadcast(least), "cls"), "jaccard-members"), tokens


def _links(members: DataFrame, live: DataFrame, num: int, den: int, screen=None) -> DataFrame:
    """Links (a, b) between classes that connect all classes that links connect.

    ``screen(pairs, live)`` may leave out pairs (a, b) that it knows not to be linked.
    """
    size = members.groupBy("sig").agg(F.count("*").alias("size")).where("size > 1")
    members = store.table(members.join(size, "sig"), "jaccard-sized")
    met = members.groupBy("cls").agg(F.sum("size").alias("met"))
    lead = members.select("sig", "cls").join(met, "cls").groupBy("sig").agg(F.max(F.struct("met", "cls")).alias("lead"))
    lead = store.table(lead.select("sig", F.col("lead.cls").alias("leader"), F.col("lead.met").alias("leader_met")), "jaccard-leaders")
    first = members.select("sig", "cls").join(lead, "sig").where("cls <> leader").groupBy(F.col("cls").alias("a")).agg(F.max(F.struct("leader_met", "leader")).getField("leader").alias("b"))
    if screen:
        first = store.table(first, "jaccard-first")
    near = store.table(_compare(screen(first, live) if screen else first, live), "jaccard-near")
    linked = near.where(f"common * {den} >= either * {num}")
    comp = components(linked.select("a", "b"))

    own = members.select("sig", "cls", "n", "shared").join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    own = own.join((first if screen else near).select(F.col("a").alias("cls"), F.col("b").alias("of")), "cls", "left")
    split = own.groupBy("sig").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most").select("sig")
    open_ = store.table(own.join(split, "sig").withColumn("family", F.coalesce("of", "cls")), "jaccard-open")
    across = _across(open_, num, den).distinct()
    rest = _compare(screen(across, live) if screen else across, live).union(_within(open_, live, num, den))
    more = store.table(rest.where(f"common * {den} >= either * {num}"), "jaccard-more")
    return linked.select("a", "b").union(more.select("a", "b"))


def _fits(num: int, den: int):
    """Whether sets x and y can be linked by their sizes and by how many of their shingles occur elsewhere."""
    both = F.col("x.n") + F.col("y.n")
    sizes = (F.col("x.n") * den >= F.col("y.n") * num) & (F.col("y.n") * den >= F.col("x.n") * num)
    return (F.col("x.comp") != F.col("y.comp")) & sizes & (F.least("x.shared", "y.shared") * (num + den) >= both * num)


def _across(open_: DataFrame, num: int, den: int) -> DataFrame:
    """Open pairs (a, b) of a list whose sets are of different families: members of one family do not meet here."""
    families = open_.groupBy("sig", "family").agg(F.count("*").alias("size"))
    x, y = families.alias("x"), families.alias("y")
    facing = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.family") < F.col("y.family"))).select("x.sig", F.col("x.family").alias("one"), F.col("y.family").alias("other"))
    facing = store.table(facing, "jaccard-facing").alias("f")
    x, y = open_.alias("x"), open_.alias("y")
    met = facing.join(x, (F.col("f.sig") == F.col("x.sig")) & (F.col("f.one") == F.col("x.family"))).join(y, (F.col("f.sig") == F.col("y.sig")) & (F.col("f.other") == F.col("y.family")) & _fits(num, den))
    known = F.coalesce((F.col("x.of") == F.col("y.cls")) | (F.col("y.of") == F.col("x.cls")), F.lit(False))
    return met.where(~known).select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b"))


def _differences(sets: DataFrame, live: DataFrame) -> DataFrame:
    """of, cls, n, apart: the sorted shingles that a set of n and its leader do not both have."""
    tokens = live.select("cls", "tokens")
    both = sets.select("cls", "of", "n").join(tokens.withColumnRenamed("tokens", "x"), "cls").join(tokens.withColumnsRenamed({"cls": "of", "tokens": "y"}), "of")
    schema = pa.schema([("of", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("apart", pa.binary())])

    def run(batches):
        for batch in batches:
            apart = [np.setxor1d(*(np.frombuffer(v.as_buffer(), np.uint64) for v in pair), assume_unique=True).tobytes() for pair in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("of", "cls", "n")), pa.array(apart, pa.binary())], schema=schema)

    return both.select("of", "cls", "n", "x", "y").mapInArrow(run, "of long, cls long, n int, apart binary")


def _each(apart: DataFrame) -> DataFrame:
    """of, cls, n, d, token: a row for each of the d differences of a set."""
    schema = pa.schema([("of", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("d", pa.int32()), ("token", pa.int64())])

    def run(batches):
        for batch in batches:
            own = [np.frombuffer(v.as_buffer(), np.int64) for v in batch.column("apart")]
            d = np.array([len(x) for x in own], np.int32)
            if d.sum():
                same = [np.repeat(batch.column(c).to_numpy(), d) for c in ("of", "cls", "n")]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (*same, np.repeat(d, d), np.concatenate(own))], schema=schema)

    return apart.mapInArrow(run, "of long, cls long, n int, d int, token long")


def _derived(pairs: DataFrame, apart: DataFrame) -> DataFrame:
    """a, b, common, either of pairs of one family, from their differences from the leader only: |x ^ y| = |D(x)| + |D(y)| - 2 |D(x) & D(y)|."""
    one = apart.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("apart").alias("x"))
    other = apart.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("apart").alias("y"))
    both = pairs.join(one, "a").join(other, "b").select("a", "b", "na", "nb", "x", "y")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("common", pa.int64()), ("either", pa.int64())])

    def run(batches):
        for batch in batches:
            held = batch.column("na").to_numpy().astype(np.int64) + batch.column("nb").to_numpy()
            sets = [[np.frombuffer(v.as_buffer(), np.uint64) for v in pair] for pair in zip(batch.column("x"), batch.column("y"), strict=True)]
            differ = np.array([len(x) + len(y) - 2 * len(np.intersect1d(x, y, assume_unique=True)) for x, y in sets], np.int64)
            common = (held - differ) // 2
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common), pa.array(held - common)], schema=schema)

    return both.mapInArrow(run, "a long, b long, common long, either long")


def _within(open_: DataFrame, live: DataFrame, num: int, den: int) -> DataFrame:
    """a, b, common, either of open pairs of one family, from how each of its sets differs from their leader.

    With D(x) the symmetric difference of x and the leader, |x ^ y| = |D(x)| + |D(y)| -
    2 |D(x) & D(y)|, and linked sets have |x ^ y| <= r (|x| + |y|) with r = (1 - t) / (1 + t).
    So D(x) and D(y) share at least (|D(x)| + |D(y)| - r (|x| + |y|)) / 2 shingles, which is
    more than none unless both are linked to the leader and thus in one class. As the
    sizes of D(x) and D(y) differ by |x ^ y| at most, the first shared shingle, rarest in the
    family first, is among the first |x| (1 - t) / t + 1 of each; only those are
    indexed, and two sets meet where as many shingles are left in both as they must share.
    """
    sets = open_.where("of is not null").select("cls", "of", "n", "shared", "comp").distinct()
    sets = store.table(sets, "jaccard-family")
    apart = store.table(_differences(sets, live), "jaccard-differences")
    rows = _each(apart)
    often = rows.groupBy("of", "token").agg(F.count("*").alias("often")).where("often > 1")
    at = F.row_number().over(Window.partitionBy("cls").orderBy("often", "token")) - 1
    # shingles that one set alone has come first in its order; they only count
    once = rows.join(often, ["of", "token"], "left").withColumn("often", F.coalesce("often", F.lit(1))).withColumn("at", at)
    index = once.where(f"often > 1 and at <= n * {den - num} div {num}").select("token", "cls", "d", "at")
    index = store.table(index.join(sets, "cls"), "jaccard-index")
    x, y = index.alias("x"), index.alias("y")
    need = (F.col("x.d") + F.col("y.d")) * (num + den) - (F.col("x.n") + F.col("y.n")) * (den - num)
    left = F.least(F.col("x.d") - F.col("x.at"), F.col("y.d") - F.col("y.at"))
    met = x.join(y, (F.col("x.of") == F.col("y.of")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.cls") < F.col("y.cls")) & _fits(num, den) & (left * (2 * (num + den)) >= need))
    return _derived(met.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct(), apart)


def join_classes(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, members=_members, screen=None) -> DataFrame:
    """doc_id, n_shingles, component_id for each row: sets are linked when den * |x & y| >= num * |x | y|.

    ``members`` makes the lists in which sets meet, ``screen`` may rule pairs of them out.
    """
    sets = set_table(docs, k)
    with store.scope():
        with store.scope():
            met, live = members(docs, sets, k, num, den)
            store.keep(met, live)
        comp = components(_links(met, live, num, den, screen))
        of = sets.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"))
        # only linked classes need a name other than their own least id
        linked = store.table(of.join(comp.withColumnRenamed("node", "cls"), "cls"), "jaccard-linked")
        small = store.checked_broadcast(store.table(linked.groupBy("comp").agg(F.min("least").alias("component")), "jaccard-components"))
        other = linked.join(small, "comp").select("cls", "component")
        name = store.table(of.join(other, "cls", "left").select("cls", F.coalesce("component", "least").alias("component")), "jaccard-names")
        store.keep(name)
    return sets.join(name, "cls", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The document of each class with the smallest id, all of documents' columns.

    Rows that share an id are one document: the smallest of them by all columns stays.
    Documents without words are not linked with anything and stay, as do all rows
    without an id.
    """
    with store.scope():
        named = join_classes(docs, k, num, den)
        heads = store.table(named.where("doc_id is null or doc_id = component_id").select("doc_id").distinct(), "jaccard-stay")
        again = store.table(named.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "jaccard-again")
        store.keep(heads, again)
    kept = docs.join(heads, docs.doc_id.eqNullSafe(heads.doc_id), "left_semi")
    if not again.count():
        return kept
    again = store.checked_broadcast(again)
    one = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).union(one.select(docs.columns))
