"""Licence scans with a trained paragraph classifier.

Paragraphs (lines) are scored by a multinomial logistic regression over sparse word 1- to 3-grams, with no other test before it.
It is trained once, on the driver, on wordings of each family (names in lead-ins, headers, grants) against paragraphs of a
bounded sample of documents; grams that are common in those have no weight. Lead-ins are split: some train, others fit the temperature that
calibrates the probabilities and, with licences of no family known here, the threshold of the class ``unknown``. A
prediction is confirmed by comparison with the family's templates: the share of a template's words and word pairs that the paragraph
has, weighed by how few families use them. What looks like a licence but falls short of the threshold or of any template is ``unknown``.

Fixed behaviour: null and empty texts have no paragraphs and the licence ``none``; ties go to the first paragraph, then to the
family first in alphabetical order; repeated rows are scored alike; very long texts are scanned whole; empty tables
give empty results; extra columns are ignored. Without sampled paragraphs the model trains on its own negatives.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Documents whose paragraphs serve as negatives, about, and paragraphs of each.
NEGATIVES, LINES = 400, 20
EPOCHS, RATE, DECAY = 14, 0.3, 1e-5
#: Share of the negatives in which a gram may be to have weight; weighed share of a template that confirms.
COMMON, CONFIRM = 0.004, 0.7
#: Characters scored together.
PORTION = 1 << 20
NONE, UNKNOWN = "none", "unknown"
#: What is said of each licence paragraph.
PARAGRAPH = {"paragraph": pa.int64(), "license": pa.string(), "probability": pa.float64(), "similarity": pa.float64(), "confirmed": pa.bool_()}
TOKEN = r"[a-z0-9][a-z0-9.+-]*[a-z0-9+]|[a-z0-9]"
WORD = re.compile(TOKEN)
#: Words, and the ends of paragraphs.
PIECE = re.compile(rf"\n|{TOKEN}")

#: Names of each family and its SPDX identifiers: fixed values.
NAMES = {
    "agpl": (["GNU Affero General Public License", "GNU AGPL v3", "AGPL", "AGPLv3", "Affero GPL"], ["AGPL-3.0-only", "AGPL-3.0-or-later"]),
    "apache": (["Apache License, Version 2.0", "Apache License", "Apache 2.0 license", "Apache Software License 2.0", "ASL 2.0"], ["Apache-2.0"]),
    "bsd": (["BSD 3-Clause License", "BSD license", "New BSD License", "BSD 2-Clause License", "Simplified BSD License", "3-clause BSD"], ["BSD-3-Clause", "BSD-2-Clause"]),
    "cc-by": (["Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC-BY 3.0", "Creative Commons Attribution License"], ["CC-BY-4.0", "CC-BY-3.0"]),
    "cc-by-nc": (["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC-BY-NC 3.0"], ["CC-BY-NC-4.0"]),
    "cc-by-sa": (["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC-BY-SA 3.0"], ["CC-BY-SA-4.0"]),
    "cc0": (["CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero", "CC0 public domain dedication"], ["CC0-1.0"]),
    "epl": (["Eclipse Public License", "Eclipse Public License 2.0", "EPL 2.0", "EPL v1.0"], ["EPL-2.0", "EPL-1.0"]),
    "gpl": (["GNU General Public License, version 3", "GNU General Public License", "GNU GPL", "GPLv3", "GPLv2", "GPL version 2"], ["GPL-3.0-only", "GPL-2.0-or-later", "GPL-2.0"]),
    "isc": (["ISC License", "ISC licence"], ["ISC"]),
    "lgpl": (["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License", "GNU LGPL", "LGPLv3", "LGPL 2.1"], ["LGPL-2.1-or-later", "LGPL-3.0-only"]),
    "mit": (["MIT License", "MIT license", "Expat License", "MIT/X11 License"], ["MIT"]),
    "mpl": (["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "Mozilla Public License", "MPL 2.0"], ["MPL-2.0"]),
    "unlicense": (["Unlicense", "The Unlicense"], ["Unlicense"]),
}
#: Sentences of the licences themselves and of their headers: fixed values.
GRANTS = {
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.", "You should have received a copy of the GNU Affero General Public License along with this program."],
    "apache": ["You may not use this file except in compliance with the Apache License.", "Licensed to the Apache Software Foundation under one or more contributor license agreements.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "cc-by": ["You are free to share and adapt the material, even commercially, if you give appropriate credit under CC BY."],
    "cc-by-nc": ["You may not use the material for commercial purposes under CC BY-NC."],
    "cc-by-sa": ["If you remix the material you must distribute your contributions under the same license, CC BY-SA."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Dedicated to the public domain under CC0."],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License."],
    "gpl": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "You should have received a copy of the GNU General Public License along with this program."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "The software is provided as is and the author disclaims all warranties with regard to this software."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "You should have received a copy of the GNU Lesser General Public License along with this library."],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the software."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, you can obtain one at https://mozilla.org/MPL/2.0/."],
    "proprietary": ["All rights reserved.", "No part of this publication may be reproduced without written permission.", "This document is proprietary and confidential.", "Unauthorized copying of this file is strictly prohibited.", "All rights reserved. No part may be reproduced without written permission of the publisher."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, for any purpose, commercial or non-commercial, and by any means."],
}
#: Lead-ins that train, and those that calibrate; {} is the name.
LEADS = ["Licensed under the {}.", "This project is released under the {}.", "{}", "Distributed under the terms of the {}.", "This work is licensed under a {}.", "The code is available under {}.", "See the {} for details.", "License: {}", "Copyright (c) 2019 the authors, {}.", "It may be used under the {} or later."]
HELD_LEADS = ["Released under the {}.", "You may copy this file under the {}.", "This software is covered by the {}.", "All files here are {} unless stated otherwise."]
#: Licences of no family here, as far as calibration knows them: fixed values.
STRANGERS = ["Artistic License 2.0", "Zlib License", "PostgreSQL License", "Open Software License 3.0", "European Union Public Licence 1.2", "Boost Software License 1.0", "SIL Open Font License 1.1", "Microsoft Public License", "Common Development and Distribution License", "Academic Free License"]
#: Sentences that use the same words without licensing anything: fixed values.
DISTRACTORS = ["The public may use the general file under the terms of the work.", "A new version of the program is released.", "You may not use this without permission from the author.", "The license office is closed.", "The terms of this work are general.", "Source code and binary files are here.", "Drive with a valid license.", "This is under the source.", "Version 2.0 is out.", "It is free of charge.", "All is reserved for the person.", "The driver lost a license and a permit.", "Anyone is free to walk here.", "The foundation was published in general terms."]


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def marks(words: list[str]) -> set[str]:
    """What templates are compared by: words and pairs of words."""
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


def wordings(leads: list[str], spdx: bool = True) -> dict[str, list[str]]:
    out = {f: [lead.format(n) for n in names for lead in leads] + [f"SPDX-License-Identifier: {i}" for i in ids if spdx] for f, (names, ids) in NAMES.items()}
    return {f: out.get(f, []) + (GRANTS[f] if spdx else []) for f in sorted({*NAMES, *GRANTS})}


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(-1, keepdims=True))
    return z / z.sum(-1, keepdims=True)


class Model:
    """Weights by gram; families in alphabetical order after none. ``scan`` and ``one`` say the same of a paragraph."""

    def __init__(self, negatives: list[str], seed: int = 5):
        rng = random.Random(seed)
        known, held = wordings(LEADS), wordings(HELD_LEADS, spdx=False)
        self.families = [NONE, *known]
        plain = [tokens(t) for t in [*DISTRACTORS, *negatives]]
        seen = Counter(g for ws in plain for g in grams(ws))
        most = COMMON * max(len(plain), 250)
        found = sorted({g for ts in known.values() for t in ts for g in grams(tokens(t)) if seen[g] <= most})
        self.index = {g: j for j, g in enumerate(found)}
        around = [w for ws in plain[:200] for w in ws]

        def examples(texts: dict[str, list[str]]) -> list[tuple[np.ndarray, int]]:
            rows = []
            for i, f in enumerate(self.families[1:], 1):
                for t in texts[f]:
                    ws = tokens(t)
                    rows += [(self.coded(ws), i), (self.coded(rng.choices(around, k=rng.randint(0, 9)) + ws + rng.choices(around, k=rng.randint(0, 9))), i)]
                    if len(ws) > 9:
                        a = rng.randint(0, len(ws) // 3)
                        rows.append((self.coded(ws[a : a + 2 * len(ws) // 3]), i))
            return rows

        nothing = [(self.coded(ws), 0) for ws in plain]
        nothing = [r for r in nothing if len(r[0])] + [(np.empty(0, int), 0)] * 50
        rng.shuffle(nothing)
        train = examples(known) + [(self.coded(tokens(t)), 0) for t in DISTRACTORS * 4] + nothing[: len(nothing) * 4 // 5]
        self.weights, self.bias, self.temperature = np.zeros((len(found), len(self.families))), np.zeros(len(self.families)), 1.0
        for epoch in range(EPOCHS):
            rng.shuffle(train)
            step = RATE / (1 + epoch / 2)
            for x, y in train:
                p = softmax(self.weights[x].sum(0) + self.bias)
                p[y] -= 1
                self.weights[x] -= step * (p / max(1, len(x)) ** 0.5 + DECAY * self.weights[x])
                self.bias -= 0.1 * step * p
        self.key_words()
        fit = examples(held) + nothing[len(nothing) * 4 // 5 :]
        logits = np.stack([self.weights[x].sum(0) + self.bias for x, _ in fit])
        y = np.array([y for _, y in fit])
        loss = {t: -np.log(np.maximum(1e-12, softmax(logits / t)[np.arange(len(y)), y])).sum() for t in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)}
        self.temperature = min(loss, key=loss.get)
        p = softmax(logits / self.temperature)
        sure = np.sort(p[np.arange(len(y)), y][(y > 0) & (p.argmax(1) == y)])
        odd = np.sort([softmax((self.weights[self.coded(tokens(lead.format(s)))].sum(0) + self.bias) / self.temperature)[1:].max() for s in STRANGERS for lead in HELD_LEADS])
        # As high as nine in ten strangers are, but no more than one in fifty true ones below it.
        self.threshold = float(min(odd[len(odd) * 9 // 10], sure[len(sure) // 50] if len(sure) else 0.5))
        users = Counter(m for ts in known.values() for m in {m for t in ts for m in marks(tokens(t))})
        self.weigh = {m: 1.0 / n**2 for m, n in users.items()}
        core = {f: [*(names := NAMES.get(f, ([], [])))[0], *names[1], *GRANTS.get(f, [])] for f in known}
        self.templates = {f: [(ms := marks(tokens(t)), sum(self.weigh.get(m, 1.0) for m in ms)) for t in ts] for f, ts in core.items()}

    def coded(self, words: list[str]) -> np.ndarray:
        return np.array(sorted(self.index[g] for g in grams(words) if g in self.index), int)

    def key_words(self) -> None:
        """Words as numbers, grams as sorted keys made of them, for many paragraphs at once."""
        self.words = {w: i for i, w in enumerate(sorted({w for g in self.index for w in g.split()}))}
        base = len(self.words) + 1
        self.keys = []
        for n in (1, 2, 3):
            rows = sorted((sum((self.words[w] + 1) * base**k for k, w in enumerate(g.split())), j) for g, j in self.index.items() if g.count(" ") == n - 1)
            self.keys.append((np.array([k for k, _ in rows], np.int64), np.array([j for _, j in rows], np.int64)))

    def verdict(self, p: np.ndarray, words: list[str]) -> tuple[str, float, float, bool] | None:
        """Family, calibrated probability, likeness to its nearest template, whether that confirms it; None if it is no licence."""
        best = int(p[1:].argmax()) + 1
        if p[0] >= 0.5:
            return None
        own = marks(words)
        like = max((sum(self.weigh.get(m, 1.0) for m in ms & own) / total for ms, total in self.templates[self.families[best]]), default=0.0)
        ok = bool(p[best] >= self.threshold and like >= CONFIRM)
        return (self.families[best] if ok else UNKNOWN), float(p[best]), float(like), ok

    def one(self, paragraph: str) -> tuple[str, float, float, bool] | None:
        words = tokens(paragraph)
        return self.verdict(softmax((self.weights[self.coded(words)].sum(0) + self.bias) / self.temperature), words)

    def scan(self, texts: list[str]) -> dict[int, list[tuple]]:
        """Licence paragraphs by text number: (paragraph, family, probability, likeness, confirmed), all paragraphs scored at once."""
        pieces = [PIECE.findall(t.lower()) for t in texts]
        first = np.cumsum([0, *(len(p) + 1 for p in pieces)])
        number = self.words.get
        coded = np.full(first[-1], -2, np.int64)  # the end of a text ends a paragraph
        for p, a in zip(pieces, first, strict=False):
            coded[a : a + len(p)] = [-2 if w == "\n" else number(w, -1) for w in p]
        line = np.cumsum(coded == -2) - (coded == -2)
        base = np.int64(len(self.words) + 1)
        hits = []
        for n, (keys, at) in enumerate(self.keys, 1):
            if not len(keys) or len(coded) < n:
                continue
            rows = np.flatnonzero(np.logical_and.reduce([coded[k : len(coded) - n + 1 + k] >= 0 for k in range(n)]))
            key = sum((coded[rows + k] + 1) * base**k for k in range(n))
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            good = keys[place] == key
            hits.append(line[rows[good]] * len(self.index) + at[place[good]])
        found: dict[int, list[tuple]] = {}
        if not hits:
            return found
        pair = np.unique(np.concatenate(hits))
        if not len(pair):
            return found
        lines, which = np.divmod(pair, len(self.index))
        start = np.flatnonzero(np.concatenate([[True], lines[1:] != lines[:-1]]))
        p = softmax((np.add.reduceat(self.weights[which], start, axis=0) + self.bias) / self.temperature)
        ends = np.flatnonzero(coded == -2)
        for i in np.flatnonzero(p[:, 0] < 0.5).tolist():
            at = int(lines[start[i]])
            a = int(ends[at - 1]) + 1 if at else 0
            text = int(np.searchsorted(first, a, "right")) - 1
            words = pieces[text][a - first[text] : int(ends[at]) - first[text]]
            said = self.verdict(p[i], words)
            found.setdefault(text, []).append((at - int(np.searchsorted(ends, first[text])), *said))
        return found


def scan(docs: DataFrame, negatives: list[str]) -> DataFrame:
    """For each document all its licence paragraphs, in order, and the most certain of them, confirmed ones first."""
    model = docs.sparkSession.sparkContext.broadcast(Model(negatives))  # a few thousand grams, whatever the table's size

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            lo = 0
            while lo < len(b):
                texts, size = [], 0
                while lo + len(texts) < len(b) and size < PORTION:
                    texts.append(b.column(1)[lo + len(texts)].as_py() or "")
                    size += len(texts[-1])
                found, rows = model.value.scan(texts), []
                for i, text in enumerate(texts):
                    mine = found.get(i, [])
                    best = max(mine, key=lambda m: (m[4], m[2], -m[0]), default=(-1, NONE, 0.0, 0.0, False))
                    n = sum(bool(x.strip()) for x in text.split("\n"))
                    rows.append((n, len(mine), best[1], best[2], best[3], best[4], best[0], [dict(zip(PARAGRAPH, m, strict=True)) for m in mine]))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.int64(), pa.list_(pa.struct(list(PARAGRAPH.items()))))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(texts)), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names=["doc_id", "n_paragraphs", "n_hits", "license", "probability", "similarity", "confirmed", "paragraph", "paragraphs"])
                lo += len(texts)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_paragraphs long, n_hits long, license string, probability double, similarity double, confirmed boolean, paragraph long, paragraphs array<struct<paragraph: long, license: string, probability: double, similarity: double, confirmed: boolean>>")


def negatives(docs: DataFrame) -> list[str]:
    """Paragraphs from anywhere in the documents of lowest hashes, without those that speak of licences."""
    ids = docs.filter("text is not null and doc_id is not null")
    n = ids.count()
    if not n:
        return []
    span = 1 << 30
    few = ids.filter(F.pmod(F.xxhash64("doc_id"), F.lit(span)) <= span * min(1.0, NEGATIVES / n))  # about NEGATIVES documents
    lines = F.filter(F.split("text", "\n"), lambda x: F.size(F.split(F.trim(x), r"\s+")) > 3)
    drawn = F.transform(F.slice(F.array_sort(F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.trim(x).alias("x")))), 1, LINES), lambda r: r["x"])
    rows = few.select("doc_id", drawn.alias("x")).limit(4 * NEGATIVES).collect()
    found = sorted({x for r in rows for x in r["x"]})
    return [x for x in found if not re.search("licen|copyright|spdx|permission|reserved|proprietary|public domain|gpl|prohibited", x, re.I)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, negatives(docs))
