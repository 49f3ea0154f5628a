"""WARC, token files, BPE and token counts against the libraries themselves."""

import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import ODD, SCHEMA, documents
from tidemark.llm import bpe, bpe_frames, store, token_count, tokenbin, warc

WORD, BYTE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def test_lookahead_makes_the_transducer_exact():
    model = bpe.Encoder(WORD).model
    assert 32 <= model.lookahead < 4096
    rnd = random.Random(1)
    for step in (64, 256):
        t = bpe.Transducer(model, step)
        for _ in range(25):
            word = "".join(rnd.choice(["a", "b", "th", "e", "in", "an", "er", "aa", "ha", "é"]) for _ in range(rnd.randint(1, 900))).encode()
            assert t.finish(word) == model.merge_all(model.symbols(word, True))
            assert len(t.held) == 0


def test_improper_merges_are_refused():
    spec = {"model": {"vocab": {s: i for i, s in enumerate([*map(chr, range(33, 600)), "abc", "bc"])}, "merges": [["a", "bc"], ["b", "c"]]}}
    with pytest.raises(ValueError, match="earlier merge"):
        bpe.BpeModel(spec)


def test_bpe_round_trip_equals_the_library(spark, sf):
    tok = Tokenizer.from_file(WORD)
    rows = ODD + [(r.doc_id + 100, r.text) for r in documents(spark, sf).limit(120).collect()]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, bpe_frames.round_trip(df, WORD).collect()), key=str)
    want = []
    for d, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    texts = {r.doc_id: r.decoded for r in bpe_frames.decode(bpe_frames.encode(df, WORD), WORD).collect()}
    assert texts[7] == tok.decode(tok.encode("one two three").ids, skip_special_tokens=False) and texts[3] == ""


def long_texts():
    """Texts of megabytes: with blanks, one word, special strings, letters that the normalizer changes, cuts in every place."""
    rnd = random.Random(8)
    words = [rnd.choice(["the", "Idea", "naïve", "İΣ", "x1y", "don't", "--", "日本", "e\u0301"]) for _ in range(60_000)]
    return [" ".join(w for w in words if w.isascii()), " ".join(words), "".join(rnd.choice("abcdefgh") for _ in range(120_000)), "ab " * 70_000 + "<|endoftext|>" + "cd\n" * 40_000, "é" * 90_000 + " tail"]


def test_bpe_of_very_long_texts(spark):
    tok = Tokenizer.from_file(WORD)
    rows = list(enumerate(long_texts()))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r for r in bpe_frames.round_trip(df, WORD).collect()}
    for d, t in rows:
        ids = tok.encode(t, add_special_tokens=False).ids
        assert (got[d].n_tokens, got[d].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()), d
        assert got[d].decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_frames.round_trip(df.where("doc_id < 0"), WORD).count() == 0
    assert bpe_frames.decode(bpe_frames.encode(df.where("doc_id < 0"), WORD), WORD).count() == 0


def test_long_merges_equal_short_ones():
    model = bpe.Encoder(WORD).model
    rnd = random.Random(2)
    for n in (65, 200, 700):
        word = "".join(rnd.choice(["a", "b", "th", "e", "in", "an", "er", "aa", "ha", "é"]) for _ in range(n)).encode()
        ids = model.symbols(word, True)
        pairs, plain = True, ids[:]
        while pairs:
            pairs = sorted((model.merge[p], i) for i, p in enumerate(zip(plain, plain[1:], strict=False)) if p in model.merge)
            if pairs:
                (_, made), i = pairs[0]
                plain[i : i + 2] = [made]
        assert model.merge_all(ids[:]) == plain
    one = "q" * 50_000 + "z"
    parts = list(bpe.Encoder(WORD).transducer.stream(one.encode()))
    assert len(parts) > 2 and sum(parts, []) == Tokenizer.from_file(WORD).encode(one, add_special_tokens=False).ids


def test_byte_decoder_keeps_unfinished_characters():
    model = bpe.Encoder(WORD).model
    d = bpe.Decoder(model, "ByteLevel")
    data = "é日".encode()
    out = b"".join(d.feed([model.byte[b]]) for b in data) + d.finish()
    assert out == data


@pytest.mark.parametrize("width", [1, 7, 8, 11, 16, 17, 24, 31, 32])
def test_packing(width):
    ids = np.random.default_rng(0).integers(0, 2**width, 1003, dtype=np.int64).astype(np.uint32)
    assert (tokenbin.unpack(tokenbin.pack(ids, width), len(ids), width) == ids).all()


def test_token_file_random_access(tmp_path):
    rng, docs = np.random.default_rng(1), []
    w = tokenbin.TokenWriter(store.open_out(f"file://{tmp_path}/a.tok"), 17, block=64)
    for k, n in enumerate([0, 5, 64, 1000, 1, 3000]):
        docs.append(rng.integers(0, 2**17, n).astype(np.uint32))
        w.add(None if k == 0 else k, docs[-1])
    w.close()
    f = tokenbin.TokenFile(store.open_random(f"file://{tmp_path}/a.tok"))
    assert all((f.doc(k) == d).all() for k, d in enumerate(docs))
    assert [d for d, _, _ in f.scan(10)] == [None, 1, 2, 3, 4, 5]
    assert (f.tokens(70, 1066) == np.concatenate(docs)[70:1066]).all()


def test_token_files_refuse_what_does_not_fit(tmp_path):
    w = tokenbin.TokenWriter(store.open_out(f"file://{tmp_path}/b.tok"), 4)
    w.add(1, np.array([15], np.uint32))
    with pytest.raises(ValueError, match="more than 4 bits"):
        w.add(2, np.array([16], np.uint32))
    for path in (WORD, BYTE):
        encode, tok = tokenbin.text_encoder(path), Tokenizer.from_file(path)
        for t in ("plain words, it's The End", "  x\ty ", "é <|endoftext|> z"):
            assert encode(t).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_token_files_hold_the_librarys_ids(spark, sf, tmp_path):
    tok = Tokenizer.from_file(WORD)
    rows = ODD + [(r.doc_id + 10, r.text) for r in documents(spark, sf).limit(100).collect()]
    manifest = tokenbin.write_tokens(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}", WORD, 2, 49408, text_bytes=20000)
    assert len(manifest) > 2
    got = sorted(map(tuple, tokenbin.read_tokens(spark, manifest).collect()), key=lambda r: r[1])
    start = 0
    for (d, t), g in zip(sorted(rows, key=lambda r: r[0]), got, strict=True):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert g == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokenbin.write_tokens(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}", WORD, 2, 49408) == []
    assert tokenbin.read_tokens(spark, []).count() == 0


def test_token_counts_equal_the_library(spark, sf):
    tok = Tokenizer.from_file(BYTE)
    rows = ODD + [(r.doc_id + 100, r.text) for r in documents(spark, sf).limit(120).collect()]
    got = sorted(map(tuple, token_count.count_tokens(spark.createDataFrame(rows, SCHEMA), BYTE).collect()))
    want = []
    for d, t in rows:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want.append((d, len((t or "").encode()), n, n > 1024))
    assert got == sorted(want)


def test_token_counts_of_odd_tables(spark):
    tok = Tokenizer.from_file(BYTE)
    rows = list(enumerate(long_texts())) + [(7, "twice"), (7, "twice"), (None, "no id")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_tokens", F.lit("clash"))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens) for r in token_count.count_tokens(df, BYTE).collect())
    assert got == sorted((-1 if d is None else d, len(tok.encode(t, add_special_tokens=False).ids)) for d, t in rows)
    assert token_count.count_tokens(df.where("doc_id < 0"), BYTE).count() == 0
    # a file of another shape goes through the library whole
    assert token_count.shaped_as_expected(BYTE) and not token_count.shaped_as_expected(WORD)
    other = Tokenizer.from_file(WORD)
    few = spark.createDataFrame(ODD, SCHEMA)
    assert sorted((r.doc_id, r.n_tokens) for r in token_count.count_tokens(few, WORD).collect()) == sorted((d, len(other.encode(t or "", add_special_tokens=False).ids)) for d, t in ODD)


def test_warc_round_trip(spark, tmp_path):
    page = "<html>" + "x" * 200
    rows = [(5, "u5", page), (3, "u3", page), (9, None, page), (1, "a\r\nb", None), (2, "", "short"), (4, "", "short"), (None, "n", page), (6, "6", "é" * 60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    manifest = warc.write_archives(df, f"file://{tmp_path}")
    got = {r.page_id: r for r in warc.read_archives(spark, manifest).collect()}
    assert len(got) == 8 and sum(m[1] for m in manifest) == 8
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {5: ("revisit", 3), 3: ("response", None), 9: ("revisit", 3), None: ("revisit", 3), 1: ("response", None), 2: ("response", None), 4: ("response", None), 6: ("response", None)}
    assert got[9].payload_bytes == len(page) and got[9].payload_digest == hashlib.sha256(page.encode()).hexdigest()
    assert got[1].payload_bytes == 0 and got[6].payload_bytes == 120
    empty = df.where("page_id > 100")
    assert warc.read_archives(spark, warc.write_archives(empty, f"file://{tmp_path}")).count() == 0


def test_warc_of_repeated_long_and_clashing_rows(spark, tmp_path):
    big = "<p>" + "long " * 400_000
    rows = [(1, "a", big), (1, "a", big), (2, "b", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = sorted((r.page_id, r.record_type, r.refers_to or 0, r.payload_bytes) for r in warc.read_archives(spark, warc.write_archives(df, f"file://{tmp_path}")).collect())
    assert got == [(1, "response", 0, len(big)), (1, "response", 0, len(big)), (2, "revisit", 1, len(big))]


def test_warc_reader_finds_damage():
    payload = b"y" * 500
    a = warc.record_bytes(1, "u", payload, hashlib.sha256(payload).hexdigest())
    b = warc.record_bytes(2, "v", b"", hashlib.sha256(b"").hexdigest())
    both = list(warc.read_records(io.BytesIO(a + b), True, block=7))
    assert [r.payload for r in both] == [payload, b""] and both[0].headers["warc-target-uri"] == "u"
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(a + b[:-9])))
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(warc.record_bytes(1, "u", payload, "0" * 64))))
