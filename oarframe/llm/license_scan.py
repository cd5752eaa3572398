"""Licence scan: a paragraph classifier with an unknown class, confirmed by comparing with templates.

Paragraphs are lines, and notices that are wrapped over adjacent lines: inside a block without blank
lines, the words in which `confirm` of some template's three-word sequences stand near each other,
counted over the line ends.  Words that consist of comment marks or rules alone do not count.  Each
paragraph becomes a sparse bag of hashed word n-grams (1 to 3 words) of unit length; a multinomial
logistic regression gives the licence family, `unknown` (legal notices of no listed family) or
`none`.  It is trained on the templates below, varied by leaving out and adding words, and on
paragraphs of the scanned corpus itself that share no three-word sequence with a template (at most
`max_negatives` of them, those of least hash: a documented bound).

The probabilities are calibrated by a temperature that fits the predictions of a second model on
notices it has never seen: one whole template of every class that has several, a fifth of the variants
of the others, and a fifth of the paragraphs without a licence are held back from it.  `threshold` is
low for that reason: a known notice reaches about twice that among the many classes.

A family is reported only if its probability reaches `threshold` and the paragraph contains `confirm`
of some template's three-word sequences of that family; a confident family that no template confirms,
though some three words of a template occur, is `unknown` too.  A wrapped notice takes the place of
what its lines would give alone.  An SPDX tag names its family by itself.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_name, gram_hashes, pieces, span_hashes, text_buffers, word_spans

DIMS = 1 << 13
NONE, UNKNOWN = "none", "unknown"
NEAR = 12  # template sequences at most so many words apart may belong to one wrapped notice

# Customary notices of each licence family.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "gpl": [
        "Licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "isc": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "agpl": [
        "Licensed under the GNU Affero General Public License.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "epl-2.0": [
        "Licensed under the Eclipse Public License, version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "bsl-1.0": ["Distributed under the Boost Software License, Version 1.0.", "Licensed under the Boost Software License, Version 1.0."],
    "cc0": [
        "Licensed under CC0 1.0 Universal.",
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    ],
    "zlib": [
        "Licensed under the zlib license.",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    ],
}

# Legal notices that name no listed licence.
UNKNOWN_NOTICES = [
    "All rights reserved.",
    "This software is proprietary and confidential.",
    "Unauthorized copying of this file, via any medium, is strictly prohibited.",
    "Use of this software is subject to the terms of the accompanying license agreement.",
    "No part of this publication may be reproduced or distributed without the prior written permission of the publisher.",
    "This material may not be copied, modified or redistributed except as permitted by the license terms of the owner.",
    "Licensed under the terms of our end user license agreement.",
]

# Identifiers of licence tags.
SPDX = {
    "Apache-2.0": "apache-2.0", "MIT": "mit", "BSD-2-Clause": "bsd", "BSD-3-Clause": "bsd", "GPL-2.0": "gpl", "GPL-2.0-only": "gpl", "GPL-2.0-or-later": "gpl",
    "GPL-3.0": "gpl", "GPL-3.0-only": "gpl", "GPL-3.0-or-later": "gpl", "LGPL-2.1": "lgpl", "LGPL-2.1-only": "lgpl", "LGPL-2.1-or-later": "lgpl", "LGPL-3.0-only": "lgpl",
    "LGPL-3.0-or-later": "lgpl", "MPL-2.0": "mpl-2.0", "ISC": "isc", "CC-BY-4.0": "cc-by", "Unlicense": "unlicense", "AGPL-3.0-only": "agpl", "AGPL-3.0-or-later": "agpl",
    "EPL-2.0": "epl-2.0", "BSL-1.0": "bsl-1.0", "CC0-1.0": "cc0", "Zlib": "zlib",
}
TAG = re.compile(rb"SPDX-License-Identifier:[\x20\t]*([A-Za-z0-9.+-]+)")


_MARK = np.zeros(256, bool)
_MARK[list(b"#*/;-%!=|<>+~_")] = True


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of words that are more than marks, and the first of each text."""
    starts, ends = word_spans(data, offsets)
    if len(starts):
        marks = np.concatenate([[0], np.cumsum(_MARK[data])])
        real = marks[ends] - marks[starts] < ends - starts
        starts, ends = starts[real], ends[real]
    return starts, ends, span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Paragraph, dimension and weight of every n-gram; a paragraph's weights have unit length."""
    words, first = _words(data, offsets)[2:]
    rows, dims = [], []
    for n in (1, 2, 3):
        grams, bounds = (words, first) if n == 1 else gram_hashes(words, first, n)
        rows.append(np.repeat(np.arange(len(offsets) - 1), np.diff(bounds)))
        dims.append(((grams >> np.uint64(20)) % np.uint64(DIMS)).astype(np.int64))
    rows, dims = np.concatenate(rows), np.concatenate(dims)
    norm = np.sqrt(np.maximum(np.bincount(rows, minlength=len(offsets) - 1), 1))
    return rows, dims, 1.0 / norm[rows]


def _buffers(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "replace") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def _logits(weights: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows, dims, value = _features(data, offsets)
    order = np.argsort(rows, kind="stable")
    rows, dims, value = rows[order], dims[order], value[order]
    out = np.tile(weights[-1], (len(offsets) - 1, 1))
    for lo in range(0, len(rows), 1 << 18):  # a bounded piece of the gathered weights at a time
        r = rows[lo : lo + (1 << 18)]
        head = np.flatnonzero(np.diff(r, prepend=-1))
        out[r[head]] += np.add.reduceat(weights[dims[lo : lo + (1 << 18)]] * value[lo : lo + (1 << 18), None], head, axis=0)
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class LicenseModel:
    classes: list[str]
    weights: np.ndarray  # DIMS rows and one of biases
    temperature: float
    templates: list[tuple[int, np.ndarray]]  # class and sorted three-word hashes

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = _softmax(_logits(self.weights, data, offsets) / self.temperature)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(best)), best]

    def confirmed(self, grams: np.ndarray, family: int) -> float:
        """The largest share of a template of the family that the paragraph holds."""
        return max((np.isin(t, grams).mean() for c, t in self.templates if c == family), default=0.0)


def _template_grams(text: str) -> np.ndarray:
    return np.unique(gram_hashes(*_words(*_buffers([text]))[2:], 3)[0])


def _regression(texts: list[str], labels: np.ndarray, n_classes: int, rounds: int) -> np.ndarray:
    """Weights, DIMS rows and one of biases; classes weigh the same."""
    weights = np.zeros((DIMS + 1, n_classes))
    rows, dims, value = _features(*_buffers(texts))
    target = np.eye(n_classes)[labels]
    share = 1.0 / np.bincount(labels, minlength=n_classes)[labels]
    share *= len(share) / share.sum()
    for _ in range(rounds):
        logits = np.tile(weights[-1], (len(target), 1))
        for c in range(n_classes):
            logits[:, c] += np.bincount(rows, weights=value * weights[dims, c], minlength=len(target))
        error = (_softmax(logits) - target) * share[:, None] / len(target)
        for c in range(n_classes):
            weights[:-1, c] -= 20.0 * (np.bincount(dims, weights=value * error[rows, c], minlength=DIMS) + 1e-6 * weights[:-1, c])
        weights[-1] -= 20.0 * error.sum(axis=0)
    return weights


def fit(negatives: list[str], copies: int = 40, rounds: int = 150, seed: int = 5) -> LicenseModel:
    """Logistic regression on varied templates and the given paragraphs without a licence."""
    rng = np.random.default_rng(seed)
    classes = [*TEMPLATES, UNKNOWN, NONE]
    negatives = negatives or [""]
    spare = [w for i in rng.permutation(len(negatives))[:200] for w in negatives[i].split()] or ["text"]
    texts, labels, held = list(negatives), [len(classes) - 1] * len(negatives), [i % 5 == 0 and len(negatives) > 1 for i in range(len(negatives))]
    for c, notices in enumerate([*TEMPLATES.values(), UNKNOWN_NOTICES]):
        for t, template in enumerate(notices):
            for i in range(copies):
                words = [w for w in template.split() if i == 0 or rng.random() > 0.08]
                before, after = rng.integers(0, 9, 2) if i % 2 else (0, 0)
                texts.append(" ".join([*rng.choice(spare, before), *words, *rng.choice(spare, after)]))
                labels.append(c)
                held.append(i % 5 == 4 or (t == len(notices) - 1 and t > 0))  # a whole template of the class, and some of each
    labels, held = np.array(labels), np.array(held)
    part = _regression([t for t, h in zip(texts, held) if not h], labels[~held], len(classes), rounds)
    logits, truth = _logits(part, *_buffers([t for t, h in zip(texts, held) if h])), labels[held]
    share = 1.0 / np.bincount(truth, minlength=len(classes))[truth]
    grid = np.geomspace(0.05, 20, 60)
    loss = [-(share * np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12))).sum() for t in grid]
    weights = _regression(texts, labels, len(classes), rounds)
    templates = [(c, _template_grams(t)) for c, family in enumerate(TEMPLATES) for t in TEMPLATES[family]]
    return LicenseModel(classes, weights.astype(np.float32), float(grid[int(np.argmin(loss))]), templates)


def train(df: DataFrame, text_col: str = "text", max_negatives: int = 2000) -> LicenseModel:
    """Fits with paragraphs of df that look like no template; at most max_negatives reach the driver."""
    notices = [t for ts in TEMPLATES.values() for t in ts] + UNKNOWN_NOTICES
    known = np.unique(np.concatenate([_template_grams(t) for t in notices]))
    rows = df.select(F.col(f"`{text_col}`").cast("string").alias("t")).filter(F.col("t").isNotNull())
    share = min(1.0, 2 * max_negatives / max(1, rows.count()))
    chance = F.shiftrightunsigned(F.xxhash64(F.lit("licence"), "t"), 11) / float(1 << 53)

    def pick(batches):
        for batch in batches:
            chosen, order = [], []
            for text, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines = [x for x in text.split("\n") if x.strip()]
                line = lines[len(text) % len(lines)] if lines else ""
                if line and not np.isin(_template_grams(line), known).any():
                    chosen.append(line)
                    order.append(u)
            yield pa.RecordBatch.from_arrays([pa.array(chosen, pa.string()), pa.array(order, pa.float64())], names=["line", "u"])

    picked = rows.select("t", chance.alias("u")).filter(F.col("u") < share).distinct().mapInArrow(pick, "line string, u double")
    return fit(sorted(r["line"] for r in picked.orderBy("u", "line").limit(max_negatives).collect()))


def _windows(at: np.ndarray, grams: np.ndarray, need: int, reach: int) -> list[tuple[int, int, int]]:
    """(first, last, count) of disjoint runs of hits within `reach` words that hold at least `need` distinct grams.

    `at` (ascending) and `grams` are the hits of one template.  Where runs compete, the one with most
    distinct grams wins, then the shortest, then the first.
    """
    out, todo = [], [(0, len(at))]
    at, grams = at.tolist(), grams.tolist()
    while todo:
        i, end = todo.pop()
        while i < end:
            if end - i < need:
                break
            best, left, stop = None, i, i + 1
            while left < stop:  # the first run, and those that start inside it
                seen, last, j = set(), left, left
                while j < end and at[j] <= at[left] + reach:
                    if grams[j] not in seen:
                        seen.add(grams[j])
                        last = j
                    j += 1
                if left == i:
                    if len(seen) < need:
                        break
                    stop = j
                if len(seen) >= need and (best is None or (len(seen), at[left] - at[last]) > best[0]):
                    best = (len(seen), at[left] - at[last]), left, last
                left += 1
            if best is None:
                i += 1
                continue
            out.append((best[1], best[2], best[0][0]))
            todo.append((i, best[1]))
            i = best[2] + 1
    return out


def _wrapped(model: LicenseModel, data: np.ndarray, lines: np.ndarray, owner: np.ndarray, sure: dict, known: np.ndarray, threshold: float, confirm: float) -> list[tuple]:
    """(first line, last line, family, probability, share) of the notices that reach over line ends.

    `sure` has the lines that are notices of their own; they count for longer notices of templates,
    but are no part of an `unknown` one.
    """
    starts, ends, words, first = _words(data, lines)
    filled = np.diff(first) > 0
    head = filled & ~(np.concatenate([[False], filled[:-1]]) & np.concatenate([[False], owner[1:] == owner[:-1]]))
    bounds = np.concatenate([first[:-1][head], [len(words)]])
    grams, gram_first = gram_hashes(words, bounds, 3)
    hits = np.flatnonzero(np.isin(grams, known))
    if not len(hits):
        return []
    block = np.searchsorted(gram_first, hits, "right") - 1
    word = hits - gram_first[block] + bounds[block]  # the first word of each hit
    hit_grams, line_of = grams[hits], lambda w: np.searchsorted(first, w, "right") - 1
    ranges, cut = [], np.flatnonzero(np.diff(block, prepend=-1, append=-1))
    for lo, hi in zip(cut[:-1], cut[1:]):
        if line_of(word[lo]) == line_of(word[hi - 1] + 2):
            continue  # all on one line
        for family, template in model.templates:
            own = lo + np.flatnonzero(np.isin(hit_grams[lo:hi], template))
            for a, z, n in _windows(word[own], hit_grams[own], int(np.ceil(confirm * len(template) - 1e-9)), 2 * len(template) + NEAR):
                ranges.append((word[own[a]], word[own[z]] + 3, family, n))
    out, taken = [], np.zeros(len(words), bool)

    def judge(found: list) -> tuple[np.ndarray, np.ndarray]:
        parts = [data[starts[a] : ends[z - 1]] for a, z, *_ in found]
        return model.predict(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64))

    if ranges:
        ranges.sort(key=lambda r: (-r[3], r[0]))
        for (a, z, family, _), best, p in zip(ranges, *judge(ranges)):
            if best == family and p >= threshold and not taken[a:z].any():
                taken[a:z] = True
                if line_of(a) < line_of(z - 1):
                    share = model.confirmed(gram_hashes(words[a:z], np.array([0, z - a]), 3)[0], family)
                    out.append((int(line_of(a)), int(line_of(z - 1)), model.classes[family], float(p), float(share)))
    rest = np.array([k for k, w in enumerate(word) if not taken[w : w + 3].any() and not any(int(x) in sure for x in (line_of(w), line_of(w + 2)))], np.int64)
    groups = np.split(rest, np.flatnonzero((np.diff(word[rest]) > NEAR) | (np.diff(block[rest]) != 0)) + 1) if len(rest) else []
    vague = [(word[g[0]], word[g[-1]] + 3) for g in groups if line_of(word[g[0]]) < line_of(word[g[-1]] + 2)]
    vague = [(a, z) for a, z in vague if not taken[a:z].any() and not any(x in sure for x in range(line_of(a), line_of(z - 1) + 1))]
    if vague:
        for (a, z), best, p in zip(vague, *judge(vague)):
            if model.classes[best] != NONE and p >= threshold:
                share = model.confirmed(gram_hashes(words[a:z], np.array([0, z - a]), 3)[0], best)
                out.append((int(line_of(a)), int(line_of(z - 1)), model.classes[best] if share >= confirm else "unknown", float(p), float(share)))
    return out


def scan_licenses(df: DataFrame, model: LicenseModel, text_col: str = "text", threshold: float = 0.25, confirm: float = 0.6) -> DataFrame:
    """df with `licenses` (array of family, probability, share, paragraph number), by paragraph.

    A paragraph's number is that of its first line, from 0, blank lines included.

    A null or empty text, and one without a licence, has an empty array.  Probability is calibrated,
    share says how much of a template stands in the paragraph; `unknown` is a paragraph that looks
    like a licence but holds too little of every template; one that shares no three words in a row
    with any template is no licence.  Rows stand for themselves; a column
    named licenses is replaced.
    """
    kept = [c for c in df.columns if c.lower() != "licenses"]
    text = fresh_name(kept, "text_in")
    kind = pa.list_(pa.struct([("family", pa.string()), ("probability", pa.float64()), ("share", pa.float64()), ("paragraph", pa.int32())]))
    none, vague = len(model.classes) - 1, len(model.classes) - 2
    known = np.unique(np.concatenate([t for _, t in model.templates]))

    def found_in(data: np.ndarray, offsets: np.ndarray) -> list[list]:
        lines = np.concatenate([[0], np.flatnonzero(data == 10) + 1, offsets[:-1], [len(data)]])
        lines = np.unique(lines[lines <= len(data)])
        out = [[] for _ in range(len(offsets) - 1)]
        if len(lines) < 2:
            return out
        best, p = model.predict(data, lines)
        owner = np.searchsorted(offsets, lines[:-1], "right") - 1
        start = np.searchsorted(lines, offsets[:-1])
        found = {}
        for i in np.flatnonzero((best != none) & (p >= threshold)):
            piece = data[lines[i] : lines[i + 1]]
            grams = gram_hashes(*_words(piece, np.array([0, len(piece)]))[2:], 3)[0]
            if best[i] != vague and not np.isin(grams, known).any():
                continue  # no template speaks for it
            share = model.confirmed(grams, best[i])
            name = model.classes[best[i]] if share >= confirm else UNKNOWN
            found[int(i)] = (name, float(p[i]), float(share))
        for tag in TAG.finditer(data.tobytes()):
            family = SPDX.get(tag[1].decode())
            i = int(np.searchsorted(lines, tag.start(), "right")) - 1
            if family or i not in found:
                found[i] = (family or UNKNOWN, 1.0, 1.0 if family else 0.0)
        sure = {i for i, x in found.items() if x[0] != "unknown"}
        notices = []
        for a, z, *notice in _wrapped(model, data, lines, owner, sure, known, threshold, confirm):
            for i in range(a, z + 1):
                if i in found and found[i][0] in ("unknown", notice[0]):
                    del found[i]
            notices.append((a, *notice))
        for i, name, probability, share in sorted([*notices, *((i, *x) for i, x in found.items())]):
            out[owner[i]].append({"family": name, "probability": probability, "share": share, "paragraph": int(i - start[owner[i]])})
        return out

    def run(batches):
        for batch in batches:
            _, at = text_buffers(batch.column(0))
            for lo, hi in pieces(at, 1 << 20):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(found_in(*text_buffers(part.column(0))), kind)], names=[*kept, "licenses"])

    item = T.StructType().add("family", T.StringType()).add("probability", T.DoubleType()).add("share", T.DoubleType()).add("paragraph", T.IntegerType())
    schema = T.StructType([df.schema[c] for c in kept]).add("licenses", T.ArrayType(item))
    return df.select(F.col(f"`{text_col}`").cast("string").alias(text), *[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    """The licence families found in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_licenses(docs, train(docs))
    sure = F.filter("licenses", lambda x: x["family"] != "unknown")
    return found.select(
        "doc_id",
        F.size(sure).cast("long").alias("n_paragraphs"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
        F.coalesce(F.array_max(F.transform(sure, lambda x: F.round(x["probability"], 4))), F.lit(0.0)).alias("probability"),
        (F.size("licenses") - F.size(sure)).cast("long").alias("n_unknown"),
    )
