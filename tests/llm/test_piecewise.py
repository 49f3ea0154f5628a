"""Piecewise fingerprints against a plain loop over all documents."""

import hashlib

from tests.llm.helpers import ODD, SCHEMA, documents
from tidemark.llm import piecewise


def test_neighbours_of_all_documents(spark, sf):
    rows = [(d, t) for d, t in ODD if d != 8] + [(r.doc_id + 10, r.text) for r in documents(spark, sf).collect()]
    got = {r.doc_id: r for r in piecewise.neighbours(spark.createDataFrame(rows, SCHEMA), 20_000).collect()}
    rows.sort()
    assert len(got) == len(rows)
    for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, after, r = t or "", after or "", got[d]
        half = len(t) // 2
        new = t[: len(t) - half] + after[:half]
        one, two, three = (piecewise.fingerprints([x.encode()])[0] for x in (t, new, after))
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (one, two)
        assert r.near_edited == piecewise.likeness(one, two) and r.near_next == piecewise.likeness(one, three)
        assert 0 <= r.near_edited <= 1
    long = [r for r in got.values() if r.n_chars > 2000]
    assert sum(r.near_edited > r.near_next for r in long) > 0.85 * len(long)


def plain_fingerprint(data: bytes) -> str:
    """The same fingerprint byte by byte, with Python integers only."""
    step, table = int(piecewise._STEP), [int(x) for x in piecewise._TABLE]
    up = [int(x) for x in piecewise.words._powers(len(data) + 1)[0]] if data else []

    def mix(x):
        for _ in range(2):
            x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) % 2**64
        return x ^ (x >> 32)

    def roll(i):
        h = 0
        for k in range(piecewise.WINDOW):
            h = (h + table[data[i - k] if i >= k else 0] * pow(step, k, 2**32)) % 2**32
        h ^= h >> 15
        h = (h * 0x2C1B3C6D) % 2**32
        return h ^ (h >> 13)

    rolls = [roll(i) for i in range(len(data))]

    def signature(block):
        out, chunk = "", []
        for i, b in enumerate(data):
            chunk.append(b)
            if rolls[i] % block == block - 1 or i == len(data) - 1:
                h = mix(sum((x + 1) * up[j] for j, x in enumerate(chunk)) % 2**64)
                out += chr(piecewise.ALPHABET[h >> 58])
                chunk = []
        return out

    block = piecewise.LEAST_BLOCK
    while block * piecewise.LENGTH < len(data):
        block *= 2
    while block > piecewise.LEAST_BLOCK and len(signature(block)) < piecewise.LENGTH // 2:
        block //= 2
    return f"{block}:{signature(block)}:{signature(2 * block)}"


def test_fingerprints_equal_a_loop_over_bytes(spark, sf):
    texts = [(t or "").encode() for _, t in ODD] + [r.text[:1500].encode() for r in documents(spark, sf).limit(25).collect()] + [b"ab" * 900, bytes([0, 1, 2, 255]) * 40]
    assert piecewise.fingerprints(texts) == [plain_fingerprint(t) for t in texts]


def test_small_tables(spark):
    one = spark.createDataFrame([(1, "abc")], SCHEMA)
    assert [tuple(r)[:2] for r in piecewise.neighbours(one).collect()] == [(1, 3)]
    assert piecewise.neighbours(one.where("doc_id > 9")).count() == 0
    same = spark.createDataFrame([(1, "abc" * 90), (1, "abc" * 90), (None, None)], SCHEMA).withColumn("part", __import__("pyspark.sql.functions", fromlist=["x"]).lit("clash"))
    assert sorted(r.n_chars for r in piecewise.neighbours(same).collect()) == [0, 270, 270]


def test_likeness():
    text = "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(60))
    a, b, c = piecewise.fingerprints([text.encode(), (text[:1500] + "XY" + text[1500:]).encode(), text[::-1].encode()])
    assert piecewise.likeness(a, a) == 1 and piecewise.likeness(a, b) > 0.85 and piecewise.likeness(a, c) == 0
    assert piecewise._lcs("kitten", "sitting") == 4


def test_long_repeated_lines_with_other_endings():
    for width in range(30, 50):
        line = hashlib.sha512(str(width).encode()).hexdigest()[: width - 1] + "\n"
        ends = ["".join(hashlib.sha512(f"{width} {e} {i}".encode()).hexdigest() for i in range(100)) for e in "ab"]
        a, b = piecewise.fingerprints([(line * 2000 + e).encode() for e in ends])
        assert a.split(":")[1] != b.split(":")[1] and piecewise.likeness(a, b) < 1


def test_common_subsequence_of_alike_strings():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for a, b in [("", ""), ("aaa", "aa"), ("abcab", "abxab"), ("aXbXc", "abc"), ("abab", "ababab"), ("xay", "yax")]:
        assert piecewise._lcs(a, b) == plain(a, b)
