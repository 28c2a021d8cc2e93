"""Licence scans: a trained classifier of paragraphs, confirmed by comparison with templates.

A paragraph is a line. Its word n-grams that occur in any template are the sparse features of a logistic regression over
licence families and an unknown class, trained on altered templates and on prose. The unknown class is calibrated on
prose held out, and a family counts only where the paragraph also shares enough n-grams with one of its templates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from matchloom.llm.common import slices, texts
from matchloom.llm.decontaminate import APART
from matchloom.llm.ngram_join import GOLD, mix, words_of

#: Notices and telling sentences of public licences.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0": [
        "Licensed under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under the CC0 1.0 Universal Public Domain Dedication.",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "All-rights-reserved": [
        "All rights reserved.",
        "Copyright 2024 the authors. All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
    ],
}
#: Ordinary words for prose that is no licence, beside the templates' own words.
PLAIN = """the of and to in a is that it for was on with as by at from are this be or an have not they which one you were all her she there would their we him been has when
who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most
made after also did many off before must well back through years much where your way down should because long each just state those people too mr how little good make world
still see own work men day get here old between both life being under three never know same last another while us might great go come since against right used take general
public version license rights software free use terms copy permission notice law source code file reserved conditions library program""".split()
WORDS_UP_TO = 3


@dataclass(frozen=True)
class ScanConfig:
    probability: float = 0.5  # of the family, at least
    overlap: float = 0.6  # n-grams shared with a template, over those of the shorter of the two
    false_alarms: float = 0.0005  # of prose held out that may pass as a licence, at most
    altered: int = 60  # training paragraphs per template
    prose: int = 6000
    steps: int = 250


def ngrams(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every n-gram of words inside a text."""
    count = np.maximum(np.diff(bounds) - n + 1, 0)
    owner = np.repeat(np.arange(len(count)), count)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + bounds[:-1][owner]
    out = np.full(len(owner), np.uint64(n))
    for k in range(n):
        out = mix(out * GOLD + hashes[start + k])
    return out, owner


class Scanner:
    def __init__(self, config: ScanConfig = ScanConfig(), seed: int = 3):
        self.config, rng = config, np.random.default_rng(seed)
        self.families = list(TEMPLATES)
        notices = [(f, t) for f, family in enumerate(self.families) for t in TEMPLATES[family]]
        hashes, bounds = words_of(pc.utf8_lower(pa.array([t for _, t in notices])), APART)
        each = [ngrams(hashes, bounds, n) for n in range(1, WORDS_UP_TO + 1)]
        self.vocabulary = np.unique(np.concatenate([h for h, _ in each]))
        self.bigrams = np.isin(self.vocabulary, each[1][0])
        self.flags = np.zeros(1 << 16, bool)
        self.flags[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True
        # Templates by their bigrams, for the comparison.
        self.template_family = np.array([f for f, _ in notices])
        self.template = np.zeros((len(notices), len(self.vocabulary)), np.float32)
        known, owner = self.lookup(*each[1])
        self.template[owner, known] = 1
        paragraphs, labels = [], []
        for f, text in notices:
            words = text.split()
            for _ in range(config.altered):
                size = len(words) if len(words) < 12 or rng.random() < 0.5 else int(rng.integers(8, len(words) + 1))  # lines are often cut
                at = int(rng.integers(0, len(words) - size + 1))
                kept = [w for w in words[at : at + size] if rng.random() > 0.06]
                around = [str(w) for w in rng.choice(PLAIN, rng.integers(0, 8))] if rng.random() < 0.5 else []
                paragraphs.append(" ".join(around[: len(around) // 2] + kept + around[len(around) // 2 :]))
                labels.append(f)
        pool = np.array(PLAIN + sorted({w.strip(".,;:()\"").lower() for _, t in notices for w in t.split()}))
        for _ in range(config.prose):
            chosen = pool if rng.random() < 0.4 else np.array(PLAIN)
            paragraphs.append(" ".join(rng.choice(chosen, rng.integers(2, 40))))
            labels.append(len(self.families))
        x, labels = self.dense(paragraphs), np.array(labels)
        held = rng.random(len(labels)) < 0.25
        self.weights, self.bias, self.unknown_gain = self._fit(x[~held], labels[~held]), None, 0.0
        scores = self.scores_dense(x[held])
        self.scale = min((0.5, 1.0, 1.5, 2.0, 3.0, 4.0), key=lambda s: self._loss(scores * s, labels[held]))
        prose = scores[labels[held] == len(self.families)] * self.scale
        margin = np.sort(prose[:, :-1].max(axis=1) - prose[:, -1])
        self.unknown_gain = max(0.0, float(margin[int(len(margin) * (1 - config.false_alarms)) - 1]))

    def lookup(self, grams: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        maybe = np.flatnonzero(self.flags[(grams >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, grams[maybe]), len(self.vocabulary) - 1)
        same = self.vocabulary[at] == grams[maybe]
        return at[same], owner[maybe[same]]

    def features(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature, paragraph) pairs of an array of paragraphs, each once, and the number of bigrams per paragraph.
        Paragraphs without a bigram of any template have no features and are unknown."""
        hashes, bounds = words_of(pc.utf8_lower(column), APART)
        two, owner_2 = self.lookup(*ngrams(hashes, bounds, 2))
        some = np.zeros(len(column), bool)
        some[owner_2] = True
        wordy = np.maximum(np.diff(bounds) - 1, 0)
        if not some.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64), wordy
        chosen = np.flatnonzero(some)
        lengths = np.diff(bounds)[chosen]
        at = np.repeat(bounds[:-1][chosen] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        few, inner = hashes[at], np.concatenate([[0], np.cumsum(lengths)])
        parts = [(two, owner_2)] + [(f, chosen[o]) for f, o in (self.lookup(*ngrams(few, inner, n)) for n in (1, 3))]
        pair = np.unique(np.concatenate([o for _, o in parts]) * len(self.vocabulary) + np.concatenate([f for f, _ in parts]))
        return pair % len(self.vocabulary), pair // len(self.vocabulary), wordy

    def dense(self, paragraphs: list[str]) -> np.ndarray:
        feature, owner, _ = self.features(pa.array(paragraphs, pa.string()))
        x = np.zeros((len(paragraphs), len(self.vocabulary)), np.float32)
        x[owner, feature] = 1
        return x

    def scores_dense(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[:-1] + self.weights[-1]

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def _loss(self, z: np.ndarray, labels: np.ndarray) -> float:
        return float(-np.log(np.maximum(self._softmax(z)[np.arange(len(labels)), labels], 1e-12)).mean())

    def _fit(self, x: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Softmax regression with a small penalty, by gradient descent with momentum; the last row is the bias."""
        k = len(self.families) + 1
        x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
        truth = np.eye(k, dtype=np.float32)[labels]
        w, step = np.zeros((x.shape[1], k), np.float32), np.zeros((x.shape[1], k), np.float32)
        for _ in range(self.config.steps):
            slope = x.T @ (self._softmax(x @ w) - truth) / len(x) + 1e-5 * w
            step = 0.9 * step - 1.0 * slope
            w += step
        return w

    def scan(self, column: pa.Array) -> list[tuple[int, str, float, float]]:
        """(paragraph, family, probability, overlap) of the paragraphs that are licences."""
        feature, owner, wordy = self.features(column)
        if not len(owner):
            return []
        rows, inverse = np.unique(owner, return_inverse=True)
        z = np.tile(self.weights[-1], (len(rows), 1)).astype(np.float64)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(inverse)) + 1])
        z += np.add.reduceat(self.weights[feature].astype(np.float64), starts, axis=0)
        z = z * self.scale
        z[:, -1] += self.unknown_gain
        p = self._softmax(z)
        best = p[:, :-1].argmax(axis=1)
        likely = np.flatnonzero((p.argmax(axis=1) == best) & (p[np.arange(len(p)), best] >= self.config.probability))
        out, ends = [], np.append(starts[1:], len(owner))
        for k in likely.tolist():
            mine = feature[starts[k] : ends[k]]
            mine = mine[self.bigrams[mine]]
            own = self.template[self.template_family == best[k]]
            shared = own[:, mine].sum(axis=1)
            overlap = float((shared / np.maximum(1, np.minimum(own.sum(axis=1), max(2, wordy[rows[k]])))).max())
            if overlap >= self.config.overlap:
                out.append((int(rows[k]), self.families[best[k]], float(p[k, best[k]]), overlap))
        return out


@lru_cache(maxsize=1)
def trained() -> Scanner:
    return Scanner()


def licences(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """One row per licence paragraph: doc_id, paragraph (number of the line, from 0), family, probability, overlap.

    A null or empty text has no paragraphs; repeated rows give repeated results; a null doc_id stays null; other columns
    are not read; an empty table gives an empty result. Every line of every text is classified. No shuffle.
    """
    scanner = scanner or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lines = pc.split_pattern(batch.column("text").cast(pa.large_string()), "\n")
            owner = pc.list_parent_indices(lines).to_numpy()
            flat, first = lines.flatten(), np.searchsorted(owner, np.arange(batch.num_rows))
            rows = scanner.scan(flat)
            parents = owner[[r[0] for r in rows]] if rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(parents, pa.int64())), pa.array([r[0] - int(first[d]) for r, d in zip(rows, parents)], pa.int64()),
                 pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.float64())],
                names=["doc_id", "paragraph", "family", "probability", "overlap"])

    return texts(docs).mapInArrow(run, "doc_id long, paragraph long, family string, probability double, overlap double")
