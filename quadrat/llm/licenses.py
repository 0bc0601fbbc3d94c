"""Licence scan: a trained paragraph classifier confirmed by templates.

Paragraphs are the lines of a text and, for notices that are wrapped, stretches of
neighbouring lines. Features are word 1- to 3-grams that occur in the built-in
notices of licence families; a paragraph's vector is binary, scaled to unit length
together with a constant for what it lacks. Multinomial logistic regression tells
the families and the class "unknown" apart. It is trained on the notices, on altered
copies of them, on sentences that speak of licences without granting one, and on a
bounded sample of the corpus' own lines, which have no labels and count as unknown
if they resemble no notice: at most `sample_lines` lines of `sample_docs` documents,
taken by hash. The bounds concern the fit alone; every text is scanned whole.

A temperature calibrates the probabilities: the notices are split into FOLDS parts,
each with all altered copies of its own, and the temperature is fitted on each
part's scores by a model that has seen none of it. A paragraph whose most probable
family stays below `confident` is unknown.

A family is reported if the paragraph also holds at least `contained` of the
weight of the word 2-grams of one of that family's notices. So a paragraph
that has too few of any notice's 2-grams can't be reported; such paragraphs are
recognised by their counts alone, exactly, and are not classified. Licences that
have no template are therefore never reported, under any name.

Stretches are runs of lines with words; comment marks aren't words. Those in which
the words that hold `contained` of a notice are at most SPREAD times as many as the
notice's are extended by the lines next to them that add to it, and classified
and confirmed as a line is. Their first line's number is reported, unless the
same family is reported for one of their lines already.

Defined results: null and empty texts have no findings; a line without words is
no paragraph but keeps its number; a very long text is scanned whole; equal notices
are decided by the order of TEMPLATES, and of stretches of a family that overlap the
most similar is reported, of several the first; repeated rows give repeated findings;
a null id is reported as null; an empty table has no findings; extra columns, whatever
their names, aren't carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

#: Bounds of the unlabelled sample that the fit takes, and parts of the notices that calibrate in turn.
SAMPLE_DOCS, SAMPLE_LINES, FOLDS = 300, 3000, 4
CONFIDENT, CONTAINED = 0.5, 0.6
UNKNOWN = "unknown"
#: A wrapped notice's words may be spread over so many times the words it has.
SPREAD = 2

#: Usual notices of each family, from the licences' own instructions and first paragraphs.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Licensed under the MIT License. See LICENSE in the project root for license information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This software is released under the Apache 2.0 license.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Released under the GPLv3 license.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC0": [
        "Licensed under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "Use, modification and distribution are subject to the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "SPDX-License-Identifier: Zlib",
    ],
    "Artistic-2.0": ["This package is licensed under the Artistic License 2.0.", "You may redistribute it under the same terms as Perl itself.", "SPDX-License-Identifier: Artistic-2.0"],
    "EUPL-1.2": ["Licensed under the EUPL, Version 1.2 or, as soon they will be approved by the European Commission, subsequent versions of the EUPL.", "SPDX-License-Identifier: EUPL-1.2"],
    "CDDL-1.0": ["The contents of this file are subject to the terms of the Common Development and Distribution License.", "SPDX-License-Identifier: CDDL-1.0"],
    "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1.", "SPDX-License-Identifier: OFL-1.1"],
    "WTFPL": ["Licensed under the Do What The Fuck You Want To Public License, version 2.", "SPDX-License-Identifier: WTFPL"],
    "PostgreSQL": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."],
    "Proprietary": ["All rights reserved.", "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited."],
}

#: Talk of licences that grants nothing.
NO_NOTICE = [
    "He renewed his driving license last week and paid the fee.",
    "The license plate of the car was never found.",
    "A license is required to fish in this lake at any time of the year.",
    "The company was licensed to sell spirits under the old law.",
    "We compared the terms of several licenses and chose none of them.",
    "Version 2.0 of the program was released in June and version 3 in May.",
    "The university is open to the general public under certain conditions.",
    "Permission to enter the building is granted by the office.",
    "The Apache helicopter was released from service.",
    "Students of MIT published the results in a free journal.",
    "The work was published by the foundation and distributed in many copies.",
    "The common law gives creative people attribution and other rights.",
    "The copyright of the book has been sold to a publisher.",
    "Please read the notice on the door before use.",
    "You may obtain a copy of the report at the desk.",
    "The license agreement between the two firms is confidential.",
]


def ngrams(w: tokens.Words, first: np.ndarray) -> list[np.ndarray]:
    """Hashes of the word 1-, 2- and 3-grams that start at each word; 0 where one would leave its paragraph."""
    code, n = w.code, len(w.code)
    end = np.repeat(first[1:], np.diff(first))
    out = [tokens.mix(code)]
    at = np.arange(n)
    h = code.copy()
    for k in (1, 2):
        h = (h ^ (code[np.minimum(at + k, n - 1)] * tokens._STEP[k])) * np.uint64(tokens._PRIME)
        out.append(np.where(at + k < end, tokens.mix(h + np.uint64(k)), np.uint64(0)))
    return out


def paragraphs(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte offsets of the lines of a block, each line's document and its number in it."""
    docs = len(offsets) - 1
    starts = np.union1d(offsets[:-1], np.flatnonzero(buf == 10) + 1)
    starts = starts[starts < len(buf)] if len(buf) else np.empty(0, np.int64)
    doc = np.searchsorted(offsets, starts, "right") - 1
    first = np.searchsorted(doc, np.arange(docs))
    return np.append(starts, len(buf)).astype(np.int64), doc, np.arange(len(starts)) - first[doc]


@dataclass
class Model:
    families: list[str]
    vocabulary: np.ndarray
    weights: np.ndarray
    temperature: float
    templates: list[tuple[str, str, np.ndarray, np.ndarray]]
    confident: float
    contained: float

    def __post_init__(self) -> None:
        self.seen = np.zeros(1 << 18, bool)
        self.seen[(self.vocabulary >> np.uint64(46)).astype(np.int64)] = True
        grams = np.unique(np.concatenate([t[2] for t in self.templates]))
        self.grams = grams
        self.least = min(float(t[3].sum()) for t in self.templates) * self.contained
        self.by_gram = np.zeros((len(self.templates), len(grams)))
        for k, t in enumerate(self.templates):
            self.by_gram[k, np.searchsorted(grams, t[2])] = t[3]
        self.needed = self.by_gram.sum(1) * self.contained
        self.gain = np.array([max(float(t[3][t[2] == g].max(initial=0)) for t in self.templates) for g in grams])

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and vocabulary numbers of the known ones among grams."""
        at = np.flatnonzero(self.seen[(grams >> np.uint64(46)).astype(np.int64)])
        v = np.minimum(np.searchsorted(self.vocabulary, grams[at]), len(self.vocabulary) - 1)
        same = self.vocabulary[v] == grams[at]
        return at[same], v[same]

    def probabilities(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        return _softmax(_logits(self.weights, row, feature, n) / self.temperature)

    def findings(self, texts: pa.Array) -> list[tuple[int, int, str, float, str, float]]:
        """(row, paragraph, family, probability, template, similarity)"""
        out = []
        for a, _, buf, off in tokens.blocks(texts):
            line_off, doc, number = paragraphs(buf, off)
            w = tokens.words(buf, line_off)
            if not len(w.code):
                continue
            one, two, three = ngrams(w, w.first)
            line = np.repeat(np.arange(len(doc)), np.diff(w.first))
            # the weight of a line's 2-grams that any notice has bounds what any notice finds in it
            place, known = self._template_hits(two)
            reach = np.bincount(line[place], self.gain[known], len(doc))
            chosen = np.flatnonzero(reach >= self.least - 1e-9)
            here = self._classified(w.first[chosen], w.first[chosen + 1], (one, two, three))
            told = {(int(chosen[k]), f) for k, f, *_ in here}
            got = [(int(chosen[k]), *rest) for k, *rest in here]
            some = np.flatnonzero(np.diff(w.first))
            opens = np.append(True, (np.diff(some) > 1) | (np.diff(doc[some]) != 0))
            joined = ngrams(w, np.append(w.first[some[opens]], len(w.code)))
            spans = self._wrapped(joined[1], line, w.first, np.cumsum(opens)[np.searchsorted(some, line)] - 1)
            lo, hi = np.array([x[0] for x in spans], np.int64), np.array([x[1] for x in spans], np.int64)
            # the best of the stretches of a family that overlap
            for k, family, *rest in sorted(self._classified(w.first[lo], w.first[hi + 1], joined), key=lambda x: (-x[4], x[0])):
                lines = range(int(lo[k]), int(hi[k]) + 1)
                if not any((x, family) in told for x in lines):
                    told |= {(x, family) for x in lines}
                    got.append((lines[0], family, *rest))
            out += [(a + int(doc[p]), int(number[p]), *rest) for p, *rest in sorted(got)]
        return out

    def _template_hits(self, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the 2-grams that any notice has, and their numbers in self.grams."""
        at, _ = self.hits(two)
        known = np.minimum(np.searchsorted(self.grams, two[at]), len(self.grams) - 1)
        same = self.grams[known] == two[at]
        return at[same], known[same]

    def _classified(self, starts: np.ndarray, ends: np.ndarray, grams: tuple) -> list[tuple[int, str, float, str, float]]:
        """(number, family, probability, template, similarity) of the stretches of words that are notices."""
        if not len(starts):
            return []
        row, feature, out, have = [], [], [], []
        for k, (lo, hi) in enumerate(zip(starts, ends)):
            # n-grams that reach beyond the stretch aren't its own
            own = [x[lo : max(lo, hi - n)] for n, x in enumerate(grams)]
            g = np.unique(np.concatenate(own))
            have.append(np.unique(own[1]))
            _, v = self.hits(g)
            row.append(np.full(len(v), k))
            feature.append(v)
        prob = self.probabilities(np.concatenate(row), np.concatenate(feature), len(starts))
        for k in range(len(starts)):
            best = int(prob[k].argmax())
            family = self.families[best]
            if family == UNKNOWN or prob[k, best] < self.confident:
                continue
            name, sim = self.confirm(family, have[k])
            if sim >= self.contained:
                out.append((k, family, float(prob[k, best]), name, sim))
        return out

    def _wrapped(self, two: np.ndarray, line: np.ndarray, first: np.ndarray, run: np.ndarray) -> list[tuple[int, int]]:
        """First and last lines of the stretches of two or more lines that hold enough of a notice."""
        place, known = self._template_hits(two)
        spans = set()
        edge = np.append(np.flatnonzero(np.diff(run[place], prepend=-1)), len(place))
        reach = np.concatenate([[0], np.cumsum(self.gain[known])])
        for a, b in zip(edge[:-1], edge[1:]):
            if reach[b] - reach[a] < self.least - 1e-9 or line[place[a]] == line[min(place[b - 1] + 1, len(line) - 1)]:
                continue
            weights = self.by_gram[:, np.unique(known[a:b])].sum(1)
            for t in np.flatnonzero(weights >= self.needed - 1e-9):
                mine = self.by_gram[t, known[a:b]] > 0
                spans |= self._stretches(t, place[a:b][mine].tolist(), known[a:b][mine].tolist(), line)
        return sorted(spans)

    def _stretches(self, t: int, place: list[int], gram: list[int], line: np.ndarray) -> set[tuple[int, int]]:
        weight, need, most = self.by_gram[t], self.needed[t] - 1e-9, SPREAD * (len(self.templates[t][2]) + 1)
        count: dict[int, int] = {}
        total, left, out = 0.0, 0, set()

        def drop() -> None:
            nonlocal total, left
            g = gram[left]
            count[g] -= 1
            total -= weight[g] if not count[g] else 0.0
            left += 1

        for right, g in enumerate(gram):
            total += 0.0 if count.get(g) else weight[g]
            count[g] = count.get(g, 0) + 1
            while place[right] + 2 - place[left] > most or (left < right and count[gram[left]] > 1):
                drop()
            while left < right and total - weight[gram[left]] * (count[gram[left]] == 1) >= need:
                drop()
            if total < need or line[place[left]] == line[place[right] + 1]:
                continue
            lo, hi, have = left, right, set(gram[left : right + 1])
            # neighbouring lines that add to the notice belong to it
            while lo and line[place[lo]] - line[place[lo - 1] + 1] <= 1 and (gram[lo - 1] not in have):
                lo -= 1
                have.add(gram[lo])
            while hi + 1 < len(gram) and line[place[hi + 1]] - line[place[hi] + 1] <= 1 and gram[hi + 1] not in have:
                hi += 1
                have.add(gram[hi])
            out.add((int(line[place[lo]]), int(line[place[hi] + 1])))
        return out

    def confirm(self, family: str, have: np.ndarray) -> tuple[str, float]:
        best = ("", 0.0)
        for fam, name, grams, weight in self.templates:
            if fam == family:
                sim = float(weight[np.isin(grams, have)].sum() / weight.sum())
                if sim > best[1]:
                    best = (name, sim)
        return best


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _scale(row: np.ndarray, n: int) -> np.ndarray:
    return 1 / np.sqrt(np.bincount(row, minlength=n) + 2.0)


def _logits(weights: np.ndarray, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
    s = _scale(row, n)
    out = np.stack([np.bincount(row, w, n) for w in weights[:-1].T[:, feature]], 1) * s[:, None]
    return out + weights[-1]


def _grams_of(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each text: all distinct 1- to 3-grams, and its distinct 2-grams."""
    every, pairs = [], []
    for _, _, buf, off in tokens.blocks(pa.array(texts, pa.large_string())):
        w = tokens.words(buf, off)
        one, two, three = ngrams(w, w.first)
        for k in range(len(off) - 1):
            s = slice(w.first[k], w.first[k + 1])
            g = np.unique(np.concatenate([one[s], two[s], three[s]]))
            every.append(g[g != 0])
            pairs.append(np.unique(two[s])[1:] if (two[s] == 0).any() else np.unique(two[s]))
    return every, pairs


def _altered(text: str, rng: np.random.Generator) -> str:
    words = text.split()
    keep = [w for w in words if rng.random() > 0.08] or words
    if rng.random() < 0.3:
        keep = ["Copyright", f"(c) {rng.integers(1990, 2027)}", "The", "Authors.", *keep]
    if rng.random() < 0.3:
        keep += ["See", "the", "file", "for", "details."]
    return " ".join(keep)


def fit(negatives: list[str], confident: float = CONFIDENT, contained: float = CONTAINED, steps: int = 300) -> Model:
    rng = np.random.default_rng(11)
    families = [*TEMPLATES, UNKNOWN]
    notices = [(f, t) for f, ts in TEMPLATES.items() for t in ts]
    every, pairs = _grams_of([t for _, t in notices])
    vocabulary = np.unique(np.concatenate(every))
    df = {}
    for p in pairs:
        for g in p.tolist():
            df[g] = df.get(g, 0) + 1
    templates = [(f, t[:60], p, np.array([1 + np.log(len(notices) / df[g]) for g in p.tolist()])) for (f, t), p in zip(notices, pairs)]
    known = set(np.concatenate(pairs).tolist())
    _, neg_pairs = _grams_of(negatives) if negatives else ([], [])
    plain = [t for t, p in zip(negatives, neg_pairs) if sum(g in known for g in p.tolist()) < 0.2 * max(len(p), 1)]
    # class, text and, for calibration, the number of the notice or sentence that it comes from
    data = [(families.index(f), _altered(t, rng) if k else t, m) for m, (f, t) in enumerate(notices) for k in range(24)]
    data += [(len(TEMPLATES), _altered(t, rng) if k else t, m) for m, t in enumerate(NO_NOTICE) for k in range(12)]
    data += [(len(TEMPLATES), t, m) for m, t in enumerate(plain)]
    y, fold = np.array([d[0] for d in data]), np.array([d[2] for d in data]) % FOLDS
    grams, _ = _grams_of([d[1] for d in data])
    # examples alike in class, fold and features count as one of their number
    alike: dict[tuple, int] = {}
    for c, f, g in zip(y, fold, grams):
        v = np.minimum(np.searchsorted(vocabulary, g), len(vocabulary) - 1)
        key = (int(c), int(f), v[vocabulary[v] == g].tobytes())
        alike[key] = alike.get(key, 0) + 1
    y, fold, times = np.array([k[0] for k in alike]), np.array([k[1] for k in alike]), np.array(list(alike.values()), float)
    have = [np.frombuffer(k[2], np.int64) for k in alike]
    logits = np.zeros((len(y), len(families)))
    for k in range(FOLDS):
        w = _descend(have, y, times * (fold != k), len(vocabulary), len(families), steps)
        at = np.flatnonzero(fold == k)
        logits[at] = _scores(w, [have[i] for i in at])
    rows = np.arange(len(y))
    loss = {t: -(times * np.log(_softmax(logits / t)[rows, y] + 1e-12)).sum() for t in np.geomspace(0.25, 4, 33)}
    return Model(families, vocabulary, _descend(have, y, times, len(vocabulary), len(families), steps), min(loss, key=loss.get), templates, confident, contained)


def _scores(weights: np.ndarray, have: list[np.ndarray]) -> np.ndarray:
    row = np.repeat(np.arange(len(have)), [len(v) for v in have])
    return _logits(weights, row, np.concatenate([*have, np.empty(0, np.int64)]).astype(np.int64), len(have))


def _descend(have: list[np.ndarray], y: np.ndarray, times: np.ndarray, size: int, classes: int, steps: int) -> np.ndarray:
    """Weights of each feature and class, the intercepts last, from examples that count `times` each."""
    some = np.flatnonzero(times)
    have, y, times = [have[k] for k in some], y[some], times[some] / times.sum()
    n = np.array([len(v) for v in have])
    row, feature = np.repeat(np.arange(len(y)), n), np.concatenate(have)
    scale = (1 / np.sqrt(n + 2.0))[:, None]
    order = np.argsort(feature, kind="stable")
    by_feature, seen_features = row[order], np.unique(feature)
    starts = np.searchsorted(feature[order], seen_features)
    full = np.flatnonzero(n)
    row_starts = (np.cumsum(n) - n)[full]
    target = np.eye(classes)[y]
    weights = np.zeros((size + 1, classes))
    seen = np.full_like(weights, 1e-8)
    for _ in range(steps):
        z = np.zeros((len(y), classes))
        z[full] = np.add.reduceat(weights[feature], row_starts)
        err = (_softmax(z * scale + weights[-1]) - target) * times[:, None]
        g = 1e-5 * weights
        g[seen_features] += np.add.reduceat((err * scale)[by_feature], starts)
        g[-1] += err.sum(0)
        seen += g * g
        weights -= 0.5 * g / np.sqrt(seen)
    return weights


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES, confident: float = CONFIDENT, contained: float = CONTAINED) -> Model:
    """Fit on notices and on at most sample_lines lines of at most sample_docs documents of the corpus."""
    base = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null")
    chosen = base.select("i").where("i is not null").distinct().orderBy(F.xxhash64("i"), "i").limit(sample_docs)
    rows = base.join(F.broadcast(chosen), "i", "left_semi").select(F.explode(F.split("t", "\n")).alias("p")).where("length(trim(p)) > 0")
    sample = [r.p for r in rows.distinct().orderBy(F.xxhash64("p"), "p").limit(sample_lines).collect()]
    return fit(sample, confident, contained)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, paragraph, family, probability, template, similarity) of each licence notice."""
    box = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col, **options))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).where("t is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = box.value.findings(batch.column(1))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string(), pa.float64()]
            cols = [pa.array([x[k] for x in found], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(cols[0]), *cols[1:]], ["doc_id", "paragraph", "family", "probability", "template", "similarity"])

    return base.mapInArrow(run, "doc_id long, paragraph long, family string, probability double, template string, similarity double")
