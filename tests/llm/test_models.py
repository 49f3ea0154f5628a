"""Toxicity, quality and licences: held-out accuracy, defined cases, and the pipeline's stages."""

import importlib.util
import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import ODD, SCHEMA, documents
from tidemark.llm import licenses, quality, toxicity

SF = "/root/testdata/sf0.1"


def test_grammar():
    lexicon = toxicity.Lexicon({"idiot": 3.0}, {"lowei": 2.0})
    kinds = lambda t: [out for out, _ in lexicon.clause(t)]
    assert kinds("what a fine day") == []
    assert kinds("an idiot") == [("insult",)] and kinds("loweisch is here") == [("insult",)]
    assert kinds("you idiot") == [("insult", "target")]
    assert kinds("not an idiot") == [("insult", "negated")]
    assert kinds("she said he was an idiot")[0][:2] == ("insult", "reported")
    assert kinds("i will kill you") == [("threat",)]
    assert lexicon.features("he is no friend. idiot!")[toxicity.KINDS.index(("insult",))] > 0
    assert lexicon.features(None).sum() == 0 and lexicon.features("").sum() == 0


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(toxicity.labelled(docs, labels))
    got = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.held_out()).select("toxic", "score").collect()
    hit = sum(r.score >= 0.5 for r in got if r.toxic) / sum(r.toxic for r in got)
    false = sum(r.score >= 0.5 for r in got if not r.toxic) / sum(1 - r.toxic for r in got)
    assert hit > 0.85 and false < 0.02
    odd = spark.createDataFrame(ODD, SCHEMA).withColumn("score", F.lit("clash"))
    assert toxicity.score(odd, model).count() == len(ODD)
    assert toxicity.keep_clean(odd, model).columns == odd.columns
    assert toxicity.score(odd.where("doc_id > 99"), model).count() == 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    model = toxicity.train(docs.select("doc_id", "text", F.lit(None).cast("int").alias("toxic")))
    assert toxicity.score(docs, model).where("score >= 0.5").count() == 0


def test_quality_against_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.score(docs.join(labels, "doc_id", "left_semi"), quality.train(docs)).join(labels, "doc_id").select("quality", "keep").collect()
    good = [r.keep for r in got if r.quality]
    junk = [r.keep for r in got if not r.quality]
    assert sum(good) / len(good) > 0.99 and sum(junk) / len(junk) < 0.1


def test_quality_defined_cases(spark, sf):
    model = quality.train(documents(spark, sf))
    odd = spark.createDataFrame(ODD, SCHEMA).withColumn("keep", F.lit("clash"))
    got = {r.doc_id: r for r in quality.score(odd, model).collect()}
    assert not got[3].keep and not got[4].keep and not got[5].keep
    assert quality.keep_good(odd, model).columns == odd.columns
    empty = odd.where("doc_id > 99")
    assert quality.score(empty, quality.train(empty)).count() == 0


def test_posteriors_find_junk():
    counts = {(0, 0, 1): 900, (0, 0, 0): 30, (-1, 0, 0): 60, (0, -1, 0): 60, (-1, -1, 0): 10}
    p, fitted = quality.posteriors(counts)
    assert p[0, 0, 1] > 0.9 and p[-1, 0, 0] < 0.5 and p[0, -1, 0] < 0.5 and 0.8 < fitted["good"] < 0.95
    assert quality.posteriors({}) == ({}, {})


def test_posteriors_equal_a_plain_loop():
    """Expectation maximisation document by document, with the same start, smoothing and prior."""
    rnd = random.Random(3)
    rows = []
    for _ in range(300):
        junk = rnd.random() < 0.3
        rows.append(tuple(-1 if junk and rnd.random() < q else int(not junk and rnd.random() < 0.6) if j == 4 else 0 for j, q in enumerate((0.4, 0.3, 0.2, 0.3, 0.5))))
    got, fitted = quality.posteriors({r: rows.count(r) for r in set(rows)})
    good = [{0: 0.95, 1: 0.2}.get(sum(v < 0 for v in r), 0.05) - 0.04 * all(v < 1 for v in r) for r in rows]
    for _ in range(quality.ROUNDS):
        share = sum(good) / len(rows)
        table = {}
        for kind in (0, 1):
            p = [1 - g for g in good] if kind else good
            for j in range(5):
                t = [sum(w for w, r in zip(p, rows, strict=True) if r[j] == v) + 0.1 for v in (-1, 0, 1)]
                t = [x / sum(t) for x in t]
                if not kind:
                    junk = min(t[0], quality.FALSE_ALARMS)
                    t = [junk, *(x * (1 - junk) / (t[1] + t[2]) for x in t[1:])]
                table[kind, j] = t
        odds = [math.log((1 - share) / share) + sum(math.log(table[1, j][r[j] + 1] / table[0, j][r[j] + 1]) for j in range(5)) for r in rows]
        good = [1 / (1 + math.exp(min(max(o, -40), 40))) for o in odds]
    assert all(abs(got[r] - g) < 1e-6 for r, g in zip(rows, good, strict=True)) and abs(fitted["good"] - share) < 1e-9


def plain_walk(lexicon, text):
    """Weights of the matches of a text, clause by clause and word by word, without automata."""
    sums = defaultdict(float)
    for clause in re.split(r"[.!?;:\n]+", (text or "").lower()):
        negated = targeted = 0
        told = quoted = False
        for word in toxicity.WORD.findall(clause):
            w = lexicon.weight(word)
            kind = "insult" if w is not None else toxicity._CLASS.get(word, ("other",))[0]
            out = [kind]
            if kind in ("insult", "threat"):
                out += ["negated"] * bool(negated) + ["reported"] * (told or quoted) + ["target"] * bool(targeted)
                sums[tuple(out)] += w if w is not None else 1.0
            negated = 3 if kind == "negation" else max(0, negated - 1)
            targeted = 4 if kind == "target" else max(0, targeted - 1)
            told, quoted = told or kind == "report", quoted != (kind == "quote")
    return sums


def test_grammar_equals_a_plain_walk(spark, sf):
    rnd = random.Random(5)
    lexicon = toxicity.Lexicon(dict.fromkeys(toxicity.INSULTS, 3.0), {"lowei": 2.0, "grumb": 1.5})
    pool = [*toxicity.INSULTS[:6], *toxicity.THREATS[:4], *toxicity.TARGETS[:5], *toxicity.NEGATIONS[:4], *toxicity.REPORTS[:4], '"', "loweisch", "grumbler", "the", "house", "red", "Über", "\n", ".", ";"]
    texts = [" ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 60))) for _ in range(300)] + [r.text for r in documents(spark, sf).limit(150).collect()] + [None, "", "idiot" * 5, "x" * 200_000 + " you idiot. " + "y " * 100_000]
    for t in texts:
        want, got = plain_walk(lexicon, t), lexicon.features(t)
        for i, kind in enumerate(toxicity.KINDS):
            assert got[i] == pytest.approx(math.log1p(want.get(kind, 0.0)), abs=1e-5), (kind, t[:200])


def units_of(text):
    """Lines, and windows across lines, as lists of words with the line of each."""
    w = [(t, k) for k, line in enumerate(re.sub(r"[^\x00-\x7f]", " ", text).lower().split("\n")) for t in licenses._WORD.findall(line)]
    for k in sorted({k for _, k in w}):
        yield [t for t, j in w if j == k], 0, k, k
    for a in range(0, max(1, -(-(len(w) - licenses.WINDOW) // licenses.STEP) + 1) * licenses.STEP, licenses.STEP):
        part = w[a : a + licenses.WINDOW]
        if part and part[0][1] != part[-1][1]:
            yield [t for t, _ in part], 1, part[0][1], part[-1][1]


def plain_scan(model, text):
    found, taken = set(), []
    for tokens, window, first, last in units_of(text or ""):
        family = model.predict(" ".join(tokens))[0]
        if family == licenses.UNKNOWN or (window and any(a <= last and first <= b for a, b in taken)):
            continue
        taken.append((first, last))
        found.add(family)
    return found


MIT = """/* Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights
 * to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
 * copies of the Software. */"""
APACHE = "# Licensed under the Apache\n# License, Version 2.0 (the\n# \"License\"); you may not use\n# this file except in\n# compliance with the License."


def test_licences_that_are_none_of_the_families():
    model = licenses.Classifier()
    strange = [
        "Licensed under the Apache License, Version 1.1.", "SPDX-License-Identifier: Apache-1.1", "Licensed under the Mozilla Public License 1.1.", "Eclipse Public License - v 1.0", "Licensed under CC BY-NC-ND 4.0.", "Licensed under CC BY-NC-SA 2.5.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "Licensed under the BSD 4-Clause License.", "Licensed under the GNU General Public License, version 1.", "This program is not licensed under the Apache License, Version 2.0.", "It was never released under the MIT License.",
        "Licensed under the Boost Software License 1.0.", "Fonts are under the SIL Open Font License.", "See the Artistic License for details.", "Permission to use, copy, modify and distribute this software for any purpose, without fee, and without a written agreement is granted, provided that this paragraph and the two paragraphs below appear in all copies.",
        "Seats with a view are all rights reserved for members.", "He lost his license and was released on bail.", "The permit was granted free of charge to any person over sixty.", "The source of the gas was in the basement form of the house.", "Public license fees rose in general last year.", "The court found that the copyright notice was late.",
    ]
    assert {t: model.predict(t)[0] for t in strange if model.predict(t)[0] != "unknown"} == {}
    # every notice still is of its own family, and versions that agree do not speak against it
    assert [t for f, ts in licenses.TEMPLATES.items() for t in ts if model.predict(t)[0] != f] == []
    fine = {"Licensed under the Apache License 2.0.": "Apache-2.0", "SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0", "Licensed under CC BY 3.0.": "CC-BY", "Licensed under the GNU Lesser General Public License, version 2.": "LGPL"}
    assert {t: model.predict(t)[0] for t in fine} == fine


def test_licences(spark, sf):
    model = licenses.Classifier()
    cases = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC", "Licensed under CC BY-SA 4.0.": "CC-BY-SA", "GNU Lesser General Public License": "LGPL", "All rights reserved.": "proprietary", "Released under the MIT License.": "MIT", "Licensed under the BSD 2-Clause License.": "BSD-2-Clause", "SPDX-License-Identifier: ISC": "ISC", "The rights of workers were reserved.": "unknown", "My driving license": "unknown", "": "unknown"}
    assert {t: model.predict(t)[0] for t in cases} == cases
    docs = documents(spark, sf)
    tail = "word " * 300_000
    extra = [(900_001, "Some words.\nLicensed under the Apache License, Version 2.0.\nAll rights reserved.\nAll rights reserved."), (900_002, f"int a;\n{MIT}\nint b;"), (900_003, f"{APACHE}\nx = 1"), (900_004, tail + "\nReleased under the MIT License.\n" + tail), (None, "All rights reserved."), (900_005, "x" * 3_000_000)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([*ODD, *extra], SCHEMA)).withColumn("family", F.lit("clash"))
    rows = {(r.doc_id, r.family): r for r in licenses.scan(df).collect()}
    assert rows[900_001, "Apache-2.0"].first_byte == 12 and rows[900_001, "proprietary"].paragraphs == 2
    assert [f for d, f in rows if d == 900_002] == ["MIT"] and [f for d, f in rows if d == 900_003] == ["Apache-2.0"]
    assert rows[900_004, "MIT"].first_byte == len(tail) + 1 and (None, "proprietary") in rows
    known = {"MIT": "the MIT License", "GPL-3.0": "GNU General", "Apache-2.0": "Apache License", "CC-BY-NC": "CC BY-NC", "proprietary": "All rights"}
    want = {(r.doc_id, f) for r in docs.collect() for f, cue in known.items() if cue in r.text}
    odd = {d for d, _ in ODD}
    assert {k for k in rows if k[0] is not None and k[0] < 900_000 and k[0] not in odd} == {k for k in want if k[0] not in odd}
    # each line and window one by one gives the same as the running sums
    for r in docs.limit(60).collect():
        assert {f for d, f in rows if d == r.doc_id} == plain_scan(model, r.text)
    assert licenses.scan(df.where("doc_id = -1")).count() == 0


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline here")
def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "decontamination", "bpe"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    kept = {r.doc_id for r in out.collect()}
    assert kept <= {r.doc_id for r in docs.collect()} and len(kept) > 80
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert out.join(labels.where("quality = 0"), "doc_id").count() <= 0.3 * labels.where("quality = 0").count()


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline here")
def test_pipeline_equals_plain_stages(spark, sf):
    """Every stage again on Python lists: scores one by one, all pairs, all windows, the library's ids."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    from tests.llm.test_groups import classes, leaks

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.train(docs)
    kept = [r for r in docs.collect() if model.score(r.text) >= 0.5]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    tox = toxicity.train(toxicity.labelled(spark.createDataFrame(kept, docs.schema), labels))
    lexicon, w = tox.lexicon(), tox.weights

    def civil(text):
        found = plain_walk(lexicon, text)
        x = [math.log1p(found.get(k, 0.0)) for k in toxicity.KINDS] + [math.log1p(sum(found.values()))]
        return sum(a * b for a, b in zip(x, w[:-1], strict=True)) + w[-1] < 0

    kept = [r for r in kept if civil(r.text)]
    comp = classes([(r.doc_id, r.text) for r in kept], 5, 80, 100)
    kept = [r for r in kept if comp[r.doc_id][1] == r.doc_id]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = lambda t: {tuple(x) for v in [[x for x in re.split(r"[\W_]+", (t or "").lower()) if x]] for x in zip(v, v[1:], v[2:], v[3:], v[4:], strict=False)}
    known = set().union(*(grams(t) for _, t in items))
    bad = {d for d, _ in leaks([(r.doc_id, r.text) for r in kept if grams(r.text) & known], items)}
    tok = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    want = {r.doc_id: len(tok.encode(r.text or "", add_special_tokens=False).ids) for r in kept if r.doc_id not in bad}
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline here")
def test_stages_take_odd_rows(spark, sf):
    """Nulls, empty and repeated rows, a clashing column: every stage gives a row or none for each, and keeps the columns."""
    import corpus_pipeline

    odd = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in [*ODD, (None, None), (None, "some plain words here")]], "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf)
        assert out.count() <= odd.count() and (name == "bpe" or out.columns == odd.columns), name
        assert stage(spark, odd.where("doc_id = -5"), sf).count() == 0, name
