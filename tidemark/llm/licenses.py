"""Licence scan: a trained paragraph classifier with a calibrated unknown class and template comparison.

Units of a text are its lines and, as notices are wrapped and put into comments, also
windows of ``WINDOW`` words across lines; comment marks and other punctuation are no part
of words. A multinomial logistic regression over hashed word unigrams and bigrams is
fitted at start-up, from the notices below with random edits as licence families, and from
ordinary sentences as the unknown class; its temperature and the least confidence are
calibrated on edits not trained on, so that strange units come out as unknown.

The classifier scores every unit of every text, from running sums of its weights over the
words. Where it finds a licence only the most probable family counts, and only if a template
confirms it: the unit and one of the family's templates share at least ``CONFIRM`` of the
template's word bigrams, of the bigrams of both, or, for a unit that lies inside a long
template, of the unit's; no family's and no foreign licence's template resembles the unit
clearly more; and nothing in the unit contradicts the family: another version, other
Creative Commons terms, another number of clauses, or a "not" before the grant.

Defined cases: null and empty texts have no licence; a document with several families
gives a row for each, with its first unit and their number; a window counts only where no
line or earlier window was found; repeated rows give repeated results, a null doc_id stays null;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import vocab, words

BITS = 16
CONFIRM, CLEARLY = 0.5, 0.15
#: Words of a window and its step; words that a unit needs to count as lying inside a template.
WINDOW, STEP, INSIDE = 48, 16, 10
#: Rounds and step of the fit (Nesterov's gradient method).
ROUNDS, RATE = 120, np.float32(4.0)
UNKNOWN = "unknown"

# Customary short notices by family (public licence texts and their usual headers).
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions.',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License.",
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "This project is licensed under the Simplified BSD License.", "Use of this source code is governed by the BSD 2-Clause License."],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "ISC": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "EPL-2.0": ["Licensed under the Eclipse Public License 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC0": ["Released into the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."],
}
for _family in TEMPLATES:
    if _family not in ("BSD", "proprietary"):
        TEMPLATES[_family] += [f"SPDX-License-Identifier: {_family}{x}" for x in (("", "-only", "-or-later") if "GPL-" in _family else ("",))]
FAMILIES = [*TEMPLATES, UNKNOWN]
# Ordinary sentences, some with words that licences use too.
ORDINARY = [
    "The version of the story that he told was different from the one we knew.",
    "She was granted permission to leave the building after the meeting.",
    "All the people of the town came to the market in the morning.",
    "You may not use the pool after ten in the evening.",
    "The software was slow and the computer needed a new disk.",
    "His driving license was taken away by the police.",
    "The work was done under the supervision of an engineer.",
    "General public opinion on the matter has changed over the years.",
    "Der Hund lief durch den Wald und kam erst am Abend zurück.",
    "La maison est au bord de la mer et le jardin est grand.",
    "El tren sale de la estación a las ocho de la mañana.",
    "The rights of workers were reserved for a later discussion.",
    "Please keep a copy of the notice for your files.",
    "A free concert was given by the students of the music school.",
    "The source of the river lies high in the mountains.",
    "Conditions on the road are bad without snow chains.",
]
# Customary words of licences that are no family here.
FOREIGN = [
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",
    "Distributed under the Boost Software License, Version 1.0.",
    "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "This package is free software; you may redistribute it under the terms of the Artistic License 2.0.",
    "Licensed under the zlib License.",
    "Licensed under the PostgreSQL License.",
]
# Sentences of legal prose that grant no licence.
LEGAL = [
    "The judge released the driver under a bond and kept the license of the firm.",
    "All rights of the tenants are reserved by the act, the lawyer said.",
    "The council licensed two taxis under the new rules of the city.",
    "A party to this contract may end it by written notice to the other.",
]
_WORD = re.compile(r"[a-z0-9]+(?:[.-][0-9a-z]+)*")


def _tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


_VERSIONED = re.compile(r"-(\d+)\.\d+$")
_NAMED = re.compile(r"(?:apache|gpl|lgpl|agpl|mpl|epl)-v?(\d+(?:\.\d+)?)")
# The terms of Creative Commons licences, by all their spellings.
TERMS = {"nc": "nc", "noncommercial": "nc", "sa": "sa", "sharealike": "sa", "nd": "nd", "noderivatives": "nd", "noderivs": "nd"}


# The words before "General Public" that name the GPL's flavours.
FLAVOURS = {"lesser": "L", "library": "L", "affero": "A"}


def _plain_version(text: str) -> str:
    return text.removesuffix(".0")


def contradicts(family: str, tokens: list[str]) -> bool:
    """Whether a unit's words speak against a family: it names only other versions or flavours, other terms, another number of clauses, denies the grant, or reserves rights for someone."""
    after = list(zip(tokens, tokens[1:], strict=False))
    if any(a in ("not", "never") and b in ("licensed", "released", "covered", "distributed", "available") for a, b in after):
        return True
    if family == "proprietary" and ("reserved", "for") in after:
        return True
    if "GPL" in family:
        kinds = {FLAVOURS.get(t, "") for t, pair in zip(tokens, after[1:], strict=False) if pair == ("general", "public")}
        if kinds and family[: family.index("GPL")] not in kinds:
            return True
    own = _VERSIONED.search(family)
    if own:
        named = {_plain_version(b) for a, b in after if a in ("version", "v", "license", "licence") and re.fullmatch(r"\d+(?:\.\d+)?", b)}
        named |= {_plain_version(m[1]) for m in map(_NAMED.match, tokens) if m}
        return bool(named) and _plain_version(family.rpartition("-")[2]) not in named
    parts = [t.split("-") for t in tokens]
    if family.startswith("CC-BY"):
        said = {TERMS[w] for p in parts if p[0] in ("by", "cc", "attribution", *TERMS) for w in p if w in TERMS}
        return any(p[0] in ("by", "cc", "attribution") for p in parts) and said != {t.lower() for t in family.split("-")[2:]}
    clauses = {p[0] for p in parts if p[-1] == "clause" and p[0].isdigit()}
    return family.startswith("BSD-") and bool(clauses) and family.split("-")[1] not in clauses


def _hash_words(tokens: list[str]) -> np.ndarray:
    """The same hashes that words.words gives for these words in a text."""
    if not tokens:
        return np.empty(0, np.uint64)
    data = np.frombuffer(" ".join(tokens).encode(), np.uint8)
    return words.words(data, np.array([0, len(data)]))[1]


def _slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of each word and of each pair of adjacent words."""
    one = hashes >> np.uint64(64 - BITS)
    two = words.mix(hashes[:-1] * np.uint64(3) + hashes[1:] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS) if len(hashes) > 1 else hashes[:0]
    return one.astype(np.int64), two.astype(np.int64)


def _pairs(tokens: list[str]) -> set:
    return set(zip(tokens, tokens[1:], strict=False))


def _similar(own: set, template: set) -> float:
    """The largest of Jaccard, containment of the template, and for a unit of some length containment in the template."""
    same = len(own & template)
    inside = same / len(own) if len(own) >= INSIDE else 0.0
    return max(same / max(1, len(own | template)), same / max(1, len(template)), inside)


class Classifier:
    """Fitted from the templates on the driver, seeded; its tables of a fixed size go to the workers."""

    def __init__(self, copies: int = 24, seed: int = 5):
        rng = np.random.default_rng(seed)
        plain = [*ORDINARY, *LEGAL, *FOREIGN]
        spare = [t for s in ORDINARY for t in _tokens(s)]
        texts, kinds = [], []
        draw = lambda n: [spare[i] for i in rng.integers(0, len(spare), n)]
        for k, family in enumerate(FAMILIES):
            base = TEMPLATES.get(family, plain)
            for tokens in map(_tokens, base):
                for c in range(copies if family != UNKNOWN else copies // 2):
                    edited = [t for t in tokens if c == 0 or rng.random() > 0.08]
                    if c and len(edited) > 2 * INSIDE and rng.random() < 0.4:
                        # what a window or one line of a wrapped notice shows
                        a = int(rng.integers(0, len(edited) - INSIDE))
                        edited = edited[a : a + int(rng.integers(INSIDE, WINDOW))]
                    if c and rng.random() < 0.4:
                        edited = draw(rng.integers(0, 12)) + edited + draw(rng.integers(0, 12))
                    texts.append(edited or tokens)
                    kinds.append(k)
        noise = "".join(chr(97 + i) for i in range(26))
        for _ in range(copies * 12):
            made = ["".join(noise[i] for i in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(rng.integers(1, WINDOW))]
            texts.append([spare[i] if rng.random() < 0.4 else w for w, i in zip(made, rng.integers(0, len(spare), len(made)), strict=True)])
            kinds.append(len(FAMILIES) - 1)
        held = rng.random(len(texts)) < 0.2
        slots = [np.concatenate(_slots(_hash_words(t))) for t in texts]
        # a slot that no notice uses tells nothing about families
        own = [_slots(_hash_words(_tokens(t))) for ts in TEMPLATES.values() for t in ts]
        used = np.unique(np.concatenate([s for pair in own for s in pair] + [_slots(_hash_words(_tokens(t)))[0] for t in plain]))
        place = np.full(1 << BITS, -1)
        place[used] = np.arange(len(used))
        x = np.zeros((len(texts), len(used)), np.float32)
        for i, s in enumerate(slots):
            np.add.at(x[i], place[s[place[s] >= 0]], np.float32(1 / np.sqrt(len(s))))
        y = np.eye(len(FAMILIES), dtype=np.float32)[kinds]
        w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
        seen, want, vw, vb = x[~held], y[~held], w.copy(), b.copy()
        for k in range(ROUNDS):
            d = (_softmax(seen @ vw + vb) - want) / len(seen)
            nw, nb = vw - RATE * (seen.T @ d + 1e-5 * vw), vb - RATE / 4 * d.sum(0)
            vw, vb = nw + k / (k + 3) * (nw - w), nb + k / (k + 3) * (nb - b)
            w, b = nw.astype(np.float32), nb.astype(np.float32)
        logits, truth = x[held] @ w + b, np.array(kinds)[held]
        scale = min((0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=lambda t: -np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-9).mean())
        strange = 1 - _softmax(logits / scale)[truth == len(FAMILIES) - 1][:, -1]
        #: Least probability that a unit is some licence: the 99 % point of what unknown units reach, within bounds.
        self.least = float(np.clip(np.quantile(strange, 0.99), 0.3, 0.7))
        self.scale, self.bias = scale, b.astype(np.float64)
        self.weights = np.zeros((1 << BITS, len(FAMILIES)), np.float32)
        self.weights[used] = w
        self.used = place >= 0
        self.grams = {f: [_pairs(t) for t in map(_tokens, ts)] for f, ts in (TEMPLATES | {UNKNOWN: FOREIGN}).items()}

    def probabilities(self, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of each family, from the summed weights of units of n features."""
        return _softmax((sums / np.sqrt(np.maximum(n, 1))[:, None] + self.bias) / self.scale)

    def confirm(self, p: np.ndarray, tokens: list[str]) -> tuple[str, float, float]:
        """(family or unknown, confidence, similarity): the most probable family, if a template confirms it and nothing contradicts it."""
        own = _pairs(tokens)
        near = {f: max(_similar(own, g) for g in gs) for f, gs in self.grams.items()}
        best = max(near.values())
        k = int(np.argmax(p))
        family = FAMILIES[k]
        if family != UNKNOWN and near[family] >= CONFIRM and near[family] >= best - CLEARLY and near[family] >= near[UNKNOWN] and not contradicts(family, tokens):
            return family, float(p[k]), near[family]
        return UNKNOWN, float(p[-1]), best

    def predict(self, unit: str) -> tuple[str, float, float]:
        """(family or unknown, confidence, similarity to the family's nearest template) of one unit."""
        tokens = _tokens(unit)
        if len(tokens) < 2:
            return UNKNOWN, 1.0, 0.0
        slots = np.concatenate(_slots(_hash_words(tokens)))
        p = self.probabilities(self.weights[slots].astype(np.float64).sum(0)[None], np.array([len(slots)]))[0]
        return self.confirm(p, tokens) if 1 - p[-1] >= self.least else (UNKNOWN, float(p[-1]), 0.0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


_ALNUM = np.array([x < 128 and chr(x).isalnum() for x in range(256)])
_JOINT = np.isin(np.arange(256), [45, 46])


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts and ends of all words, then row, first word and end word, and kind (0 line, 1 window) of each unit) of a chunk of texts."""
    alnum = _ALNUM[data]
    beside = np.zeros(len(data), bool)
    beside[1:-1] = alnum[:-2] & alnum[2:]
    clean = np.where(alnum | (_JOINT[data] & beside), data, np.uint8(32))
    rows, h, starts, ends = words.words(clean, offsets)
    if not len(h):
        none = np.empty(0, np.int64)
        return h, starts, ends, none, none, none, none
    line = np.searchsorted(np.flatnonzero(data == 10), starts)
    new = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (rows[1:] != rows[:-1])]))
    stop = np.concatenate([new[1:], [len(h)]])
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    last = np.concatenate([first[1:], [len(h)]])
    # windows of a row start every STEP words; the last one ends with the row
    count = np.maximum(1, -(-(last - first - WINDOW) // STEP) + 1)
    at = np.repeat(first, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * STEP
    end = np.minimum(at + WINDOW, np.repeat(last, count))
    across = line[at] != line[end - 1]
    at, end = at[across], end[across]
    a, b = np.concatenate([new, at]), np.concatenate([stop, end])
    kind = np.concatenate([np.zeros(len(new), np.int64), np.ones(len(at), np.int64)])
    long = b - a >= 2
    return h, starts, ends, rows[a[long]], a[long], b[long], kind[long]


def find(model: Classifier, data: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, str], tuple[int, float, float, int]]:
    """(row, family) -> (first byte in the text, highest confidence, similarity, number of units) of a chunk of texts."""
    h, starts, ends, row, a, b, kind = units(data, offsets)
    if not len(row):
        return {}
    sums = np.zeros((len(row), len(FAMILIES)))
    for slots, end in zip(_slots(h), (b, b - 1), strict=True):
        at = np.flatnonzero(model.used[slots])
        total = np.concatenate([np.zeros((1, len(FAMILIES))), np.cumsum(model.weights[slots[at]], 0, np.float64)])
        sums += total[np.searchsorted(at, end)] - total[np.searchsorted(at, a)]
    p = model.probabilities(sums, 2 * (b - a) - 1)
    out: dict = {}
    taken: dict = {}
    for i in np.flatnonzero(1 - p[:, -1] >= model.least):
        begin, end = int(starts[a[i]]), int(ends[b[i] - 1])
        family, sure, near = model.confirm(p[i], _tokens(data[begin:end].tobytes().decode("utf-8", "replace")))
        if family == UNKNOWN:
            continue
        key = (int(row[i]), family)
        # lines come first; a window counts where nothing was found yet
        if kind[i] and any(x < end and begin < y for x, y in taken.get(key[0], ())):
            continue
        taken.setdefault(key[0], []).append((begin, end))
        first, best, sim, n = out.get(key, (begin - int(offsets[row[i]]), 0.0, 0.0, 0))
        out[key] = min(first, begin - int(offsets[row[i]])), max(best, sure), max(sim, near), n + 1
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, family, confidence, similarity, paragraphs, first_byte: a row for each licence family found in a document."""
    vocab.small_batches(docs.sparkSession)
    fitted = docs.sparkSession.sparkContext.broadcast(Classifier())
    schema = pa.schema([("doc_id", pa.int64()), ("family", pa.string()), ("confidence", pa.float64()), ("similarity", pa.float64()), ("paragraphs", pa.int64()), ("first_byte", pa.int64())])

    def run(batches):
        model = fitted.value
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            for a, _, data, offsets in words.chunks(batch.column("text")):
                found = find(model, data, offsets)
                rows += [(ids[a + row], family, best, sim, n, first) for (row, family), (first, best, sim, n) in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, family string, confidence double, similarity double, paragraphs long, first_byte long")
