"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import ODD, SCHEMA, documents
from tidemark.llm import oracles, spelling


def near(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def plain(rows, noise=199, shortest=6, least=5, factor=5):
    seen = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    n = {w: c for w, c in seen.items() if len(w) >= shortest and c >= least}
    close = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, others in close.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(close[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def rows_of(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_variants_equal_all_pairs(spark, sf):
    rnd = random.Random(4)
    base = ["committee", "necessary", "Straße", "élèvement", "bookkeeper", "aaaaaaa", "abcdefgh"]
    rows = [(r.doc_id, r.text) for r in documents(spark, sf).limit(60).collect()] + list(ODD)
    for d in range(400, 700):
        out = []
        for _ in range(30):
            w = rnd.choice(base)
            for _ in range(rnd.choice([0, 0, 0, 0, 1, 1, 2])):
                i = rnd.randrange(len(w))
                w = rnd.choice([w[:i] + w[i + 1 :], w[:i] + rnd.choice("abeé") + w[i:], w[:i] + rnd.choice("abeé") + w[i + 1 :]])
            out.append(rnd.choice([w, w.upper(), w.capitalize()]))
        rows.append((d, rnd.choice([" ", ", ", "1"]).join(out)))
    rows += [(None, "necessary Necessary"), (None, None), (3, "x" * 5000)] * 5
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"word": F.lit("clash"), "n": F.lit(1), "id": F.lit(2)})
    want = plain(rows)
    assert any(w[1] for w in want) and any(w[0] == "x" * 5000 for w in want)
    assert rows_of(spelling.variants(df.repartition(3))) == want
    # a share of noise at which the deleted code point matters
    assert rows_of(spelling.variants(df, noise=3)) == plain(rows, noise=3)


def test_ties_go_to_the_smaller_word(spark):
    rows = [(1, "zbcdef abcdef " * 30), (2, "xbcdef " * 5)]
    got = {w: (f, n) for w, f, _, _, n, _ in rows_of(spelling.variants(spark.createDataFrame(rows, SCHEMA), noise=10**12))}
    assert got["xbcdef"] == ("abcdef", 2) and got["zbcdef"] == (None, 2)


def test_paths_of_forms_end_at_the_root(spark):
    sizes = [5, 25, 125, 625]
    spelled = ["aaaaaabbbb", "aaaaaabbb", "aaaaaabb", "aaaaaab"]
    rows = [(i, f"{w} " * n) for i, (w, n) in enumerate(zip(spelled, sizes, strict=True))]
    got = {w: (f, r) for w, f, r, *_ in rows_of(spelling.variants(spark.createDataFrame(rows, SCHEMA), noise=10**12))}
    assert got == {spelled[0]: (spelled[1], spelled[3]), spelled[1]: (spelled[2], spelled[3]), spelled[2]: (spelled[3], spelled[3]), spelled[3]: (None, spelled[3])}


def test_empty_table(spark):
    out = spelling.variants(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and out.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_names_of_groups_tell_words_apart():
    rnd = random.Random(2)
    spelled = sorted({"".join(rnd.choice("abé") for _ in range(rnd.randint(1, 7))) for _ in range(400)})
    row, kind, h1, h2 = spelling.name_rows(spelled)
    at = {}
    for r, k, a, b in zip(row, kind, h1, h2, strict=True):
        at.setdefault((int(k), int(a), int(b)), []).append(spelled[r])
    pairs = {frozenset(p) for (k, *_), ws in at.items() if k == spelling.WILDCARD for p in ((x, y) for x in ws for y in ws if x < y)}
    assert pairs == {frozenset((x, y)) for x in spelled for y in spelled if x < y and len(x) == len(y) and near(x, y)}
    whole = {(a, b): ws[0] for (k, a, b), ws in at.items() if k == spelling.WHOLE}
    gone = sorted((w, whole[a, b]) for (k, a, b), ws in at.items() if k == spelling.DELETION and (a, b) in whole for w in ws)
    assert gone == sorted((x, y) for x in spelled for y in spelled if len(x) == len(y) + 1 and near(x, y)) and len(gone) == len(set(gone))
    assert len(np.unique(h1)) > len(spelled)


def test_equals_the_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(f"select word, form, root, n, n_near, form_n from ({oracles.SPELLING})").fetchall()
    assert rows_of(spelling.variants(documents(spark, sf))) == sorted(want)
