"""Token alignment against plain loops over bytes."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import ODD, SCHEMA, documents
from tidemark.llm import align, vocab

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_tokens(text, a, b):
    """((id, bytes) of A, (id, bytes) of B) by the libraries over the whole text."""
    if not text:
        return [], []
    byte = {c: i for i, c in enumerate(vocab.byte_symbols())}
    e = a.encode(f" {text}", add_special_tokens=False)
    x = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in e.ids]
    y = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        y.append((i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()))
    whole = f" {text}".encode()
    return (x, y) if b"".join(t for _, t in x) == b"".join(t for _, t in y) == whole else ([], [])


def plain_align(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    found, counts = [], Counter()
    for doc_id, text in rows:
        spans = []
        for side in plain_tokens(text, a, b):
            at, own = 0, []
            for i, piece in side:
                own.append((i, at, at + len(piece)))
                at += len(piece)
            spans.append(own)
        linked, j = [], 0
        for x, s, t in spans[0]:
            while j < len(spans[1]) and spans[1][j][2] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][1] < t:
                linked.append((x, spans[1][k][0]))
                k += 1
        counts.update(linked)
        cuts = sorted({t for *_, t in spans[0]} & {t for *_, t in spans[1]})
        groups, low = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for i, s, t in side if low <= s < c) for side in spans))
            low = c
        found.append((doc_id, spans, linked, groups))
    best = {}
    for (x, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for doc_id, spans, linked, groups in found:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc_id, len(spans[0]), len(spans[1]), len(groups), len(linked), sum(counts[p] == best[p[1]] for p in linked), sum(counts[p] for p in linked), digest))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.mark.parametrize("hot", [1, 60, 10**9])
def test_alignment_equals_a_loop(spark, sf, hot):
    rnd = random.Random(1)
    rows = list(ODD) + [(r.doc_id + 1000, r.text) for r in documents(spark, sf).limit(25).collect()]
    rows += [(None, "no id"), (None, None), (50, "x▁y"), (51, "a  b"), (52, " lead"), (53, "trail "), (54, "\n"), (55, " "), (56, "don't stop-it 12345 <|endoftext|>"), (57, "</s> <unk> <0x41>"), (58, "日本 語"), (59, "ab" * 4000), (60, "é́ é ﬁ")]
    rows += [(100 + i, "".join(rnd.choice("ab c'\n.1é") for _ in range(rnd.randint(1, 40)))) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"row": F.lit(1), "end": F.lit("x"), "n": F.lit(2), "toks": F.lit(0)})
    assert rows_of(align.align(df.repartition(3), A, B, hot)) == plain_align(rows)


def test_links_are_numbered_groups_of_neighbours(spark):
    df = spark.createDataFrame([(1, "internationalization of words")], SCHEMA)
    tokens, name = align.token_table(df, A, B)
    got = align.links(tokens, align.entry_lengths(spark, A, B)).orderBy("end").collect()
    assert got[-1].cut and got[-1].end == len(" internationalization of words") and all(r.a is not None and r.b is not None for r in got)
    plan = align.links(tokens, align.entry_lengths(spark, A, B))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    align.drop_tokens(spark, name)
    groups = [r.group for r in got]
    assert groups == sorted(groups, reverse=True) and groups[-1] == 1 and groups[0] == sum(r.cut for r in got)
    assert all((r.cut, r.a_end is not None, r.b_end is not None) in {(True, True, True), (False, True, False), (False, False, True)} for r in got)


def test_empty_table(spark):
    out = align.align(spark.createDataFrame([], SCHEMA), A, B)
    assert out.count() == 0 and list(out.columns) == list(COLUMNS)


def test_runs_equal_the_whole_text(spark, sf):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b, sides = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), align.Sides(A, B)
    a.encode_special_tokens = True
    texts = [r.text for r in documents(spark, sf).limit(80).collect()] + [t for _, t in ODD]
    assert sides.runs and sides.ranked
    ends, ids = sides.encode(texts)
    for k, text in enumerate(texts):
        x, y = plain_tokens(text, a, b)
        assert ids[ends[k] : ends[k + 1]].tolist() == [i for i, _ in x] + [i + len(sides.a_bytes) for i, _ in y]


def test_a_row_a_document_has_the_pairs_of_its_links(spark, sf):
    rows = [(i, t) for i, (_, t) in enumerate(ODD)] + [(r.doc_id + 1000, r.text) for r in documents(spark, sf).limit(25).collect()]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    sides = align.Sides(A, B)
    found = align.aligned(df, A, B)
    assert found.count() == len(rows)
    pair = F.col("pair")
    b_entries = len(sides.b_bytes)
    got = found.select("doc_id", F.inline("links")).select("doc_id", F.expr(f"pair div {b_entries}").alias("a"), (pair % b_entries).alias("b"), "times")
    tokens, name = align.token_table(df, A, B)
    want = align.links(tokens, align.entry_lengths(spark, A, B)).join(tokens.select("row", "doc_id"), "row").groupBy("doc_id", "a", "b").count()
    key = lambda df: sorted(tuple(r) for r in df.collect())
    expected = key(want)
    align.drop_tokens(spark, name)
    assert key(got) == expected and len(expected) > 1000


def test_no_token_is_a_row_of_the_query(spark, monkeypatch):
    def rows(*_):
        raise AssertionError("tokens became rows")

    monkeypatch.setattr(align, "links", rows)
    monkeypatch.setattr(align, "token_table", rows)
    df = spark.createDataFrame([(1, "one two two three"), (2, None)], SCHEMA)
    assert rows_of(align.align(df, A, B)) == plain_align([(1, "one two two three"), (2, None)])


@pytest.mark.parametrize("kept", [0, 3, 10**6])
def test_runs_are_kept_from_batch_to_batch_within_bounds(monkeypatch, kept):
    monkeypatch.setattr(align, "KEPT", kept)
    sides, fresh, batches, seen = align.Sides(A, B), align.Sides(A, B), ["one two three one", "two internationalization", "ab" * 40 + " three", "one  two", "", None, "x\u2581y one", "one two three one"], []
    encode = sides._runs
    sides._runs = lambda runs: seen.extend(runs) or encode(runs)
    for text in batches:
        fresh.young, fresh.older = {}, {}
        assert sides.align([text, "three"]) == fresh.align([text, "three"])
        assert len(sides.young) <= kept and len(sides.older) <= kept + 4
        assert all(len(r) <= align.KEPT_LENGTH for r in [*sides.young, *sides.older])
    if kept == 10**6:
        assert len(seen) == len(set(seen))
