"""License scans: a trained classifier of paragraphs, with an unknown class, confirmed by templates."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusflow.llm.common import batches_of, texts_of

#: Notices by license family: common wordings of public licenses, a parameter of license_scan.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "AGPL": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "BSD-2": [
        "Released under the BSD 2-Clause License.",
        "Licensed under the Simplified BSD License.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "EPL": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "Released under the Eclipse Public License, version 2.0.",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "Released under the zlib License.",
    ],
    "BSD": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ],
    "CC0": [
        "This work is dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "proprietary": [
        "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
        "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ],
}
#: Short names by family; each stands in an SPDX line, a 'License:' line and a 'Licensed under the ...' line too.
NAMES = {
    "MIT": ["MIT"], "Apache-2.0": ["Apache-2.0", "Apache 2.0"], "GPL": ["GPL-2.0", "GPL-3.0", "GPLv3"], "LGPL": ["LGPL-2.1", "LGPL-3.0", "LGPLv3"], "AGPL": ["AGPL-3.0", "AGPLv3"], "BSD": ["BSD-3-Clause"],
    "BSD-2": ["BSD-2-Clause"], "MPL-2.0": ["MPL-2.0", "MPL 2.0"], "ISC": ["ISC"], "Unlicense": ["Unlicense"], "EPL": ["EPL-1.0", "EPL-2.0"], "BSL-1.0": ["BSL-1.0"], "Zlib": ["Zlib"],
    "CC-BY": ["CC-BY-4.0", "CC-BY-SA-4.0"], "CC-BY-NC": ["CC-BY-NC-4.0", "CC-BY-NC-SA-4.0"], "CC0": ["CC0-1.0"],
}
UNKNOWN = "unknown"
#: So many documents, those of the smallest hash, give paragraphs that show what no license looks like.
BACKGROUND = 400
#: Held-out paragraphs of the unknown class that may be taken for a license.
FALSE_RATE = 0.001
#: Share of a template's word pairs that a paragraph must have, or of a paragraph's that a template must have.
SIMILARITY = 0.7
_WORD = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*")


def words_of(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def with_names(templates: dict[str, list[str]], names: dict[str, list[str]]) -> dict[str, list[str]]:
    short = lambda n: [f"SPDX-License-Identifier: {n}", f"License: {n}", f"Licensed under the {n} license."]
    return {f: list(dict.fromkeys([*texts, *(x for n in names.get(f, []) for x in short(n))])) for f, texts in templates.items()}


def features(words: list[str], known: dict[str, int], pairs: dict[tuple[str, str], int]) -> list[int]:
    """Places of the word 1- and 2-grams that the vocabulary has, each once."""
    hits = set(map(known.get, words))
    hits.discard(None)
    if len(hits) > 1:
        hits.update(map(pairs.get, zip(words, words[1:], strict=False)))
        hits.discard(None)
    return sorted(hits)


def likeness(words: list[str], templates: list[frozenset[tuple[str, str]]]) -> float:
    """How much of the nearest template's word pairs the paragraph holds, or of the paragraph's the template."""
    own = set(zip(words, words[1:], strict=False))
    return max((len(own & t) / max(1, min(len(t), max(len(own), 3))) for t in templates), default=0.0)


def sentences_of(templates: dict[str, list[str]]) -> dict[tuple[str, ...], str]:
    """The families of whole sentences of templates, as words; one that several families have says nothing."""
    out: dict[tuple[str, ...], str] = {}
    for family, texts in templates.items():
        for words in {tuple(words_of(x)) for t in texts for x in re.split(r"(?<=[.;:])\s+", t)}:
            out[words] = UNKNOWN if out.get(words, family) != family else family
    return {w: f for w, f in out.items() if len(w) > 1 and f != UNKNOWN}


@dataclass
class Model:
    families: list[str]
    known: dict[str, int]
    known_pairs: dict[tuple[str, str], int]
    weights: np.ndarray  # (features + share of unknown words + constant) x (families + unknown)
    temperature: float
    threshold: float
    pairs: dict[str, list[frozenset[tuple[str, str]]]]
    sentences: dict[tuple[str, ...], str]
    texts: dict[str, list[str]]

    def classify(self, words: list[str]) -> tuple[str, float]:
        """The family, or unknown if no family's calibrated probability reaches the threshold."""
        return self.classify_all([words])[0]

    def classify_all(self, paragraphs: list[list[str]]) -> list[tuple[str, float]]:
        """classify() of many paragraphs: sparse rows times the weights."""
        at = [features(w, self.known, self.known_pairs) for w in paragraphs]
        size = np.array([len(x) for x in at], dtype=np.int64)
        z = np.zeros((len(at), self.weights.shape[1]))
        if size.sum():
            rows = np.flatnonzero(size)
            z[rows] = np.add.reduceat(self.weights[np.concatenate([np.array(at[r], dtype=np.int64) for r in rows])], np.cumsum(size[rows]) - size[rows])
        strange = np.array([1 - sum(map(self.known.__contains__, w)) / max(1, len(w)) for w in paragraphs])
        z = (z / np.maximum(1.0, size**0.5)[:, None] + strange[:, None] * self.weights[-2] + self.weights[-1]) / self.temperature
        p = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
        p /= p.sum(1, keepdims=True)
        best = p[:, :-1].argmax(1)
        return [(self.families[k], float(row[k])) if row[k] >= self.threshold else (UNKNOWN, float(row[-1])) for k, row in zip(best.tolist(), p, strict=True)]

    def similarity(self, family: str, words: list[str]) -> float:
        """A paragraph too short for the share of pairs must stand in a template word for word."""
        if 2 <= len(words) <= 3 and any(f" {' '.join(words)} " in t for t in self.texts[family]):
            return 1.0
        return likeness(words, self.pairs[family])

    def notice(self, words: list[str]) -> str | None:
        """The family of a paragraph that is a whole sentence of a template, such as 'All rights reserved.'"""
        return self.sentences.get(tuple(words))


def train(templates: dict[str, list[str]], background: list[str], seed: int = 0) -> Model:
    """Multinomial logistic regression on variants of the templates against background paragraphs."""
    r = random.Random(seed)
    families = sorted(templates)
    texts = {f: [words_of(t) for t in templates[f]] for f in families}
    known = {g: i for i, g in enumerate(sorted({x for f in families for w in texts[f] for x in w}))}
    known_pairs = {g: len(known) + i for i, g in enumerate(sorted({x for f in families for w in texts[f] for x in zip(w, w[1:], strict=False)}))}
    pairs = {f: [frozenset(zip(w, w[1:], strict=False)) for w in texts[f]] for f in families}
    # a background paragraph that holds half of a template is no example of the unknown class
    back = [w for t in background for p in t.split("\n") if (w := words_of(p)) and max(likeness(w, own) for own in pairs.values()) < 0.5]
    vocabulary = sorted({w for f in families for t in texts[f] for w in t})
    noise = [w for p in back[:2000] for w in p] or ["lorem", "ipsum"]
    rows: list[tuple[list[str], int]] = []
    for k, f in enumerate(families):
        for w in texts[f]:
            for n in range(40):
                v = list(w)
                if n:
                    v = [x for x in v if r.random() > 0.05] or v
                    if r.random() < 0.5:
                        v = [r.choice(noise) for _ in range(r.randrange(6))] + v + [r.choice(noise) for _ in range(r.randrange(6))]
                rows.append((v, k))
    for _ in range(max(1500, len(rows) // 2)):  # license words without a license's order, and plain background
        size, share = r.randrange(1, 25), r.choice((0.15, 0.3, 0.6))
        rows.append(([r.choice(vocabulary) if r.random() < share else r.choice(noise) for _ in range(size)], len(families)))
        rows.append((r.choice(back) if back else [r.choice(noise) for _ in range(size)], len(families)))
    r.shuffle(rows)
    x = np.zeros((len(rows), len(known) + len(known_pairs) + 2), dtype=np.float32)
    for i, (w, _) in enumerate(rows):
        at = features(w, known, known_pairs)
        x[i, at] = 1 / max(1.0, len(at) ** 0.5)
        x[i, -2], x[i, -1] = 1 - sum(t in known for t in w) / max(1, len(w)), 1
    y = np.array([k for _, k in rows])
    cut = len(rows) * 4 // 5
    weights, speed = np.zeros((x.shape[1], len(families) + 1), dtype=np.float32), 0.0
    goal = np.eye(len(families) + 1, dtype=np.float32)[y]
    for _ in range(150):
        z = x[:cut] @ weights
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        speed = 0.9 * speed - 4.0 * (x[:cut].T @ (p - goal[:cut]) / cut + 1e-5 * weights)
        weights = weights + speed
    held = (x[cut:] @ weights).astype(np.float64)

    def loss(t: float) -> float:
        z = held / t
        return float((np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - z[np.arange(len(z)), y[cut:]]).mean())

    temperature = min((0.25 * 1.2**k for k in range(16)), key=loss)
    z = held / temperature
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    wrong = np.sort(p[y[cut:] == len(families)][:, :-1].max(1))
    threshold = max(0.5, float(wrong[min(len(wrong) - 1, int(len(wrong) * (1 - FALSE_RATE)))]) + 1e-6) if len(wrong) else 0.5
    return Model(families, known, known_pairs, weights.astype(np.float64), temperature, min(threshold, 0.9), pairs, sentences_of(templates), {f: [f" {' '.join(w)} " for w in texts[f]] for f in families})


def paragraphs_of(text: str) -> Iterator[tuple[int, int, int, int]]:
    """First line, number of lines, start, length: every line, and every run of two or more lines between blank ones."""
    start, block = 0, None  # block: first line, start
    lines = text.split("\n")
    for k, line in enumerate([*lines, ""]):
        if line and not line.isspace():
            yield k, 1, start, len(line)
            block = block or (k, start)
        elif block:
            if k - block[0] > 1:
                yield block[0], k - block[0], block[1], start - 1 - block[1]
            block = None
        start += len(line) + 1


def judged(model: Model, any_pair: frozenset, paragraphs: list[list[str]]) -> list[tuple[str, str, float, float, bool] | None]:
    """family, predicted, probability, similarity, confirmed of each paragraph; None: plain text."""
    out = []
    for words, (predicted, p) in zip(paragraphs, model.classify_all(paragraphs), strict=True):
        if family := model.notice(words):
            out.append((family, predicted, p, 1.0, True))
        elif predicted != UNKNOWN:
            like = model.similarity(predicted, words)
            out.append((predicted if like >= SIMILARITY else UNKNOWN, predicted, p, like, like >= SIMILARITY))
        elif not any_pair.isdisjoint(zip(words, words[1:], strict=False)) and (like := max(likeness(words, own) for own in model.pairs.values())) >= SIMILARITY:
            out.append((UNKNOWN, UNKNOWN, p, like, False))
        else:
            out.append(None)
    return out


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, templates: dict[str, list[str]] = TEMPLATES, names: dict[str, list[str]] = NAMES, background: int = BACKGROUND) -> DataFrame:
    """One row for each paragraph that the classifier takes for a license, or that looks like a template.

    id, paragraph (its first line, 0-based), n_lines, start (character), length,
    family (a family, or 'unknown' where the classifier is unsure or no template
    confirms it; a whole sentence of one family's templates is of that family,
    whatever the classifier says), predicted, probability, similarity,
    confirmed.  Paragraphs are lines, and runs of lines between blank ones, so
    that a notice wrapped over lines is one too; such a run gives no row where
    one of its lines is confirmed to be of the same family.  Every paragraph of
    every text goes through the classifier.  Null, empty and blank texts give
    no row; rows that repeat an id or have none give theirs each.  Rows are
    independent; training reads the `background` different (id, text) of the
    smallest hash.
    """
    size = docs.count()
    share = min(1.0, 1.2 * background / max(1, size))
    hashed = docs.select(F.xxhash64(id_col, text_col).alias("k"), F.col(text_col).alias("t"))
    few = hashed.where(F.col("k") < int((share - 0.5) * 2**64)) if share < 1 else hashed
    model = train(with_names(templates, names), [r.t for r in few.dropDuplicates(["k"]).orderBy("k").limit(background).collect() if r.t])
    any_pair = frozenset(p for own in model.pairs.values() for t in own for p in t)
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, paragraph int, n_lines int, start int, length int, family string, predicted string, probability double, similarity double, confirmed boolean"
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.bool_()]
    columns = [id_col, "paragraph", "n_lines", "start", "length", "family", "predicted", "probability", "similarity", "confirmed"]

    def scanned(doc: object, text: str) -> Iterator[tuple]:
        places = list(paragraphs_of(text))
        lines: dict[int, tuple] = {}
        for at in range(0, len(places), 4096):
            part = places[at : at + 4096]
            for place, got in zip(part, judged(model, any_pair, [words_of(text[s : s + n]) for _, _, s, n in part]), strict=True):
                if got:
                    k, n, *_ = place
                    if n == 1:
                        lines[k] = got
                    elif any((x := lines.get(j)) and x[4] and x[0] == got[0] for j in range(k, k + n)):
                        continue
                    yield doc, *place, *got

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole):
                rows = [x for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch, "__text"), strict=True) for x in scanned(doc, text)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [whole.schema.field(0).type, *kinds], strict=True)], columns)

    return docs.select(id_col, F.col(text_col).alias("__text")).mapInArrow(run, schema)
