"""Jaccard classes, decontamination and the filtering stages against plain versions."""

import re
import uuid
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import ODD, SCHEMA, documents
from tidemark.llm import decontaminate, jaccard, store, words


def classes(rows, k, num, den):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where, both = defaultdict(list), Counter()
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    for ds in where.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                both[a, b] += 1
    for (a, b), c in both.items():
        if den * c >= num * (len(sets[a]) + len(sets[b]) - c):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def near_copies(n=60, size=220, seed=3):
    """Copies of one text with some words changed; neighbours in a chain are close, ends are not."""
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 5000, size)]
    rows, chain = [], list(base)
    for d in range(n):
        own = list(base)
        for i in rng.integers(0, size, rng.integers(0, 6)):
            own[i] = f"x{rng.integers(0, 9)}"
        rows.append((1000 + d, " ".join(own)))
        if d < 12:
            chain[int(rng.integers(0, size))] = f"c{d}"
            rows.append((3000 + d, " ".join(chain)))
    return rows


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_classes_equal_all_pairs(spark, sf, k, num):
    rows = [(d, t) for d, t in ODD if d != 8] + [(8, "one two three")] + [(r.doc_id + 10_000, r.text) for r in documents(spark, sf).limit(120).collect()] + near_copies()
    rows += [(9, "One TWO three"), (20_001, "short one"), (20_002, "SHORT one"), (20_003, "é É")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("cls", F.lit("clash")).withColumn("n", F.lit(1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_classes(df, k, num, 100).collect()}
    assert got == classes(rows, k, num, 100)


def test_classes_of_repeated_rows(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for d in range(40):
        own = list(base)
        for i in rng.choice(24, 6, replace=False):
            own[8 * int(i) + 3] = f"x{rng.integers(0, 2)}"
        rows.append((d, " ".join(own)))
    for rows_ in (rows, near_copies()):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_classes(spark.createDataFrame(rows_ * 2, SCHEMA), 5, 80, 100).collect()}
        assert got == classes(rows_, 5, 80, 100)


def test_rows_without_an_id_link_others(spark):
    base = [f"w{i}" for i in range(120)]
    text = lambda n: " ".join("x" if i in (10, 40, 70, 100)[:n] else w for i, w in enumerate(base))
    rows = [(1, text(0)), (None, text(2)), (None, text(2)), (3, text(4)), (None, "a text that nobody else has at all")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard.join_classes(df, 3, 90, 100).collect())
    assert got == [(0, 0), (0, 1), (0, 1), (1, 1), (3, 1)]
    assert classes([(1, text(0)), (3, text(4))], 3, 90, 100)[3][1] == 3


def test_keep_one_and_empty(spark):
    rows = [(3, "a b c d e f g h"), (1, "A b c d e f g h"), (1, "A b c d e f g h"), (7, ""), (8, None), (None, "z"), (9, "other words in a text of its own")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("extra", F.lit("x"))
    kept = jaccard.keep_one(df)
    assert kept.columns == ["doc_id", "text", "extra"]
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 7, 8, 9]
    assert jaccard.join_classes(df.where("doc_id > 99")).count() == 0


def test_word_hashes_follow_words():
    texts = ["The cat", "the\tCAT  sat", "", "é x y"]
    import pyarrow as pa

    _, _, data, offsets = next(words.chunks(pa.array(texts)))
    rows, h, a, b = words.words(data, offsets)
    assert rows.tolist() == [0, 0, 1, 1, 1, 3, 3] and h[0] == h[2] and h[1] == h[3]
    assert data[a[-2] : b[-2]].tobytes().decode() == "é x"


def leaks(docs, items, threshold=0.8):
    """Every window of every document against every item."""
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    out = {}
    for i, t in items:
        own = split(t)
        if len(own) < 5:
            continue
        g = grams(own)
        for d, text in docs:
            w, best = split(text), 0.0
            for s in range(max(1, len(w) - len(own) + 1)):
                x = grams(w[s : s + len(own)])
                same = sum((x & g).values())
                best = max(best, same / (sum(x.values()) + sum(g.values()) - same))
            if best >= threshold:
                out[d, i] = round(best, 9)
    return out


def test_leaks_equal_all_windows(spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").limit(8).collect()] + [(90, "one two"), (91, None), (92, "a b c d e f a b c d e f")]
    docs = [(d, t) for d, t in ODD if d != 8] + [(100 + r.doc_id, r.text[:1500]) for r in documents(spark, sf).limit(40).collect()]
    w = items[0][1].split()
    docs += [(500, "start here " + items[0][1].upper() + " and more text follows"), (501, " ".join(["x", *w[:-1], "changed"])), (502, " ".join([*w[: len(w) // 2], "in", "between", *w[len(w) // 2 :]])), (503, " ".join(w[: len(w) // 2])), (504, "A b c d e f a b c d e f a b"), (505, items[1][1] + "\n" + items[2][1])]
    df = spark.createDataFrame(docs, SCHEMA).withColumn("start", F.lit("clash"))
    found = decontaminate.leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in found} == leaks(docs, items)
    assert (500, items[0][0]) in {(r.doc_id, r.item_id) for r in found}
    kept = decontaminate.keep_clean(df, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == df.columns and 500 not in {r.doc_id for r in kept.collect()}


def test_leaks_of_exchanged_parts(spark):
    word = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    items = [(1, word(0, 45)), (2, word(100, 160)), (3, word(200, 280)), (4, word(300, 330))]
    around = "some other text stands before and after it here"
    docs = [(1, f"{around} {word(22, 45)} {word(0, 22)} {around}"), (2, f"{around} {word(130, 160)} {word(100, 130)} {around}"), (3, f"{word(253, 280)} {word(226, 253)} {word(200, 226)}"), (4, f"{around} {word(240, 280)} {word(200, 240)}"), (5, f"{word(315, 330)} {word(300, 315)} {around}"), (6, word(2, 44))]
    found = decontaminate.leaks(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    expected = leaks(docs, items)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in found} == expected
    assert {(1, 1), (2, 2), (4, 3), (6, 1)} <= set(expected)


def test_marks_of_repeated_shingles_stay_near(spark):
    rng = np.random.default_rng(4)
    pairs = []
    for _ in range(20):
        own = [int(x) for x in rng.integers(-(2**62), 2**62, 100)]
        pairs.append((own, own[:90] + [own[0] ^ 12345] * 10))
    df = spark.createDataFrame(pairs, "a array<long>, b array<long>")
    df = df.select(*(c.alias(f"{x}{i}") for x in "ab" for i, c in enumerate(decontaminate.simhash(F.col(x)))))
    apart = [((r.a0 ^ r.b0) % 2**64).bit_count() + ((r.a1 ^ r.b1) % 2**64).bit_count() for r in df.collect()]
    assert max(apart) <= decontaminate.RADIUS


def test_no_items_or_documents(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e f")], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(docs, items).count() == 0 and decontaminate.keep_clean(docs, items).count() == 1
    assert decontaminate.leaks(docs.where("doc_id > 5"), items).count() == 0


def test_blocks_cover_all_bits():
    bounds = decontaminate.block_bounds()
    assert len(bounds) == decontaminate.RADIUS + 1
    assert sorted((h, a + i) for h, a, n in bounds for i in range(n)) == [(h, i) for h in (0, 1) for i in range(64)]


def test_prefixes_lose_no_linked_set(spark):
    """Sets of many sizes at the very threshold, and sets that share a passage only."""
    rng = np.random.default_rng(11)
    rows, d = [], 0
    passage = [f"p{i}" for i in range(40)]
    for size in (9, 12, 20, 33, 60, 150, 400):
        for t in range(4):
            base = [f"{size}-{t}-{i}" for i in range(size)]
            for change in range(0, max(2, size // 18)):
                own = list(base)
                for i in rng.integers(0, size, change):
                    own[i] = f"y{rng.integers(0, 10**6)}"
                rows.append((d, " ".join(own)))
                d += 1
            rows.append((d, " ".join([*base[: size // 3], *passage])))
            d += 1
    for k, num in ((3, 90), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_classes(spark.createDataFrame(rows, SCHEMA), k, num, 100).collect()}
        assert got == classes(rows, k, num, 100)
    empty = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], SCHEMA)
    assert sorted(r.component_id for r in jaccard.join_classes(empty, 3, 90, 100).collect()) == [1, 1, 2]


def test_scratch_tables_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "shared_dir", lambda _, name: f"file://{tmp_path}/{name}-{uuid.uuid4().hex}")
    rows = near_copies(12)
    found = jaccard.join_classes(spark.createDataFrame(rows, SCHEMA))
    assert sorted(x.name.partition("-")[2].rpartition("-")[0] for x in tmp_path.iterdir()) == ["names", "sets"]
    assert found.count() == len(rows)
    with store.scope():
        store.table(spark.range(3), "gone")
    assert len(list(tmp_path.iterdir())) == 2


def test_leaks_in_repeated_long_and_clashing_rows(spark):
    item = " ".join(f"w{i}" for i in range(40))
    long = " ".join(f"z{i % 977}" for i in range(150_000))
    rows = [(1, f"{long} {item} {long}"), (2, item), (2, item), (None, item), (3, "x" * 500_000), (4, "")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("similarity", F.lit("clash")).withColumn("h", F.lit(1))
    items = spark.createDataFrame([(7, item), (8, item)], "item_id long, text string").withColumn("n", F.lit("clash"))
    got = sorted((r.doc_id, r.item_id, r.similarity) for r in decontaminate.leaks(df, items).collect())
    assert got == [(d, i, 1.0) for d in (1, 2) for i in (7, 8)]
    assert sorted(r.doc_id or 0 for r in decontaminate.keep_clean(df, items).collect()) == [0, 3, 4]
