"""SetSketch registers, their estimates, and near-duplicate classes against all pairs."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import ODD, SCHEMA, documents
from tests.llm.test_groups import classes, near_copies
from tidemark.llm import jaccard, oracles, setsketch


def sketch(*sets):
    n = np.array([len(s) for s in sets])
    return setsketch.sketches(np.repeat(np.arange(len(sets)), n), np.concatenate([np.sort(s) for s in sets]) if n.sum() else np.empty(0, np.uint64), n)


def random_set(rng, n):
    return rng.integers(0, 2**64, n, dtype=np.uint64)


def test_a_sketch_depends_on_its_set_alone_and_merges():
    rng = np.random.default_rng(1)
    a, b = random_set(rng, 700), random_set(rng, 40)
    alone, together = sketch(a), sketch(b, a, random_set(rng, 3), np.empty(0, np.uint64))
    assert (alone[0] == together[1]).all() and not together[3].any()
    union = np.concatenate([a, b])
    assert (setsketch.merge(alone[0], together[0]) == sketch(union)[0]).all()
    assert (alone[0] == sketch(rng.permutation(a))[0]).all() and sketch(b[:1]).min() > 0


@pytest.mark.parametrize(("n", "j"), [(12, 0.85), (200, 0.85), (200, 0.5), (5000, 0.9)])
def test_registers_agree_as_often_as_the_sets_and_the_estimate_follows(n, j):
    rng = np.random.default_rng(n)
    pairs = []
    for _ in range(60):
        common = round(2 * n * j / (1 + j))
        x = random_set(rng, 2 * n - common)
        pairs += [x[:n], np.concatenate([x[:common], x[n:]])]
    s = sketch(*pairs)
    true = common / (2 * n - common)
    x, y, size = s[::2], s[1::2], np.full(60, n)
    agreed = (x == y).mean()
    assert agreed == pytest.approx(np.log1p(true * (setsketch.BASE - 1)) / np.log(setsketch.BASE), abs=0.02)
    best, short = setsketch.joint_estimate(x, y, size, size, true)
    assert best.mean() == pytest.approx(true, abs=0.02) and short.max() <= setsketch.DOUBT
    _, far = setsketch.joint_estimate(x, y, size, size, min(1.0, true + 0.3))
    assert far.min() > 0
    # pairs at the threshold meet in a band
    if j >= 0.85:
        assert ((setsketch.bands(x) == setsketch.bands(y)).any(axis=1)).all()
    # sizes that cannot be so similar are ruled out whatever the registers say
    assert np.isinf(setsketch.joint_estimate(x, y, size, size * 2, 0.85)[1]).all()


@pytest.mark.parametrize("num", [80, 85])
def test_classes_equal_all_pairs(spark, sf, num):
    rows = [(d, t) for d, t in ODD if d != 8] + [(8, "one two three")] + [(r.doc_id + 10_000, r.text) for r in documents(spark, sf).limit(120).collect()] + near_copies()
    rows += [(9, "One TWO three"), (20_001, "short one"), (20_002, "SHORT one"), (20_003, "é É"), (20_004, "a b c d e f g h i j k"), (20_005, "a b c d e f g h i j k l"), (20_006, " ".join(f"w{i}" for i in range(20_000)))]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"cls": F.lit("clash"), "n": F.lit(1), "sig": F.lit(0), "kept": F.lit("no")})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setsketch.near_duplicates(df, 5, num, 100).collect()}
    assert got == classes(rows, 5, num, 100)


def test_pairs_of_different_leaders_are_screened_and_kept(spark):
    # chains: neighbours are close, ends are not, so links lie across leaders
    rng = np.random.default_rng(8)
    rows = []
    for c in range(4):
        words = [f"c{c}w{i}" for i in range(150)]
        for d in range(25):
            words = list(words)
            words[int(rng.integers(0, 150))] = f"c{c}x{d}"
            rows.append((100 * c + d, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setsketch.near_duplicates(spark.createDataFrame(rows, SCHEMA), 5, 85, 100).collect()}
    assert got == classes(rows, 5, 85, 100)


def test_repeated_rows_rows_without_id_and_an_empty_table(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C d e f"), (None, "a b c d e f"), (3, None), (None, "z y x w v u"), (4, "")]
    got = setsketch.near_duplicates(spark.createDataFrame(rows, SCHEMA), 5, 85, 100)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, 1, False), (3, 0, 3, True), (None, 2, None, False), (4, 0, 4, True)], key=str)
    none = setsketch.near_duplicates(spark.createDataFrame([], SCHEMA), 5, 85, 100)
    assert none.count() == 0 and none.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_equals_the_sql(spark, sf):
    docs = documents(spark, sf)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.sql(f"select doc_id, n_shingles, component_id, kept from ({oracles.NEAR})").fetchall())
    assert sorted(tuple(r) for r in setsketch.near_duplicates(docs, 5, 85, 100).collect()) == want
    assert jaccard.join_classes(docs, 5, 85, 100).count() == len(want)
