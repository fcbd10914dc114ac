"""Licence notices in documents, by a trained paragraph classifier that templates confirm.

A sparse multinomial logistic regression over word one- and two-grams tells licence families from each other and from
unknown text. It is trained here: on variants of the templates below (words left out, cut, versions changed, set into
other text) and on background lines, ``BACKGROUND_LINES`` at most, of the ``BACKGROUND_DOCS`` documents with the smallest hash; that
sample is the only part of the corpus that training sees. An L1 penalty leaves few weights; the temperature that
calibrates the probabilities is chosen on variants and lines held out from training. A paragraph whose likeliest
class is unknown, or whose probability stays below ``LEAST_PROBABILITY``, is no notice. A found family is confirmed if
enough of the two-grams of one of its templates stand in the paragraph.

Every line of every whole text is a paragraph, and so is every block of consecutive non-blank lines, so that a wrapped notice
is seen whole; a notice found in both is one row. Longer ones are read in windows of ``WINDOW`` words that overlap by
half, so that a notice within a long line is not outvoted. Windows without any weighted word are unknown by the
intercepts alone, and are skipped without being scored. Scanning is one narrow pass; only the model, bounded by the
templates, is sent to the tasks.

Defined results: null and empty texts have no notices; null ids are passed on; repeated rows, lines and notices give a row each; an empty
table gives an empty result; other input columns are ignored, whatever their names.
"""

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "unknown"
BACKGROUND_DOCS = 400
BACKGROUND_LINES = 1500
VARIANTS = 30
WINDOW = 48
LEAST_PROBABILITY = 0.5
LEAST_SIMILARITY = 0.5

# Short notices by which public licences are commonly invoked.
TEMPLATES = {
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "BSD": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC": [
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Published under the Creative Commons CC0 1.0 Universal public domain dedication.",
    ],
    "Proprietary": [
        "Copyright 2020. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced or distributed without the prior written permission of the publisher.",
    ],
}

_TOKEN = re.compile(r"[^\W_]+", re.UNICODE)


def tokens(text: str) -> list[str]:
    """Lower-case words and numbers; every number is the same token."""
    return ["0" if t.isdigit() else t for t in _TOKEN.findall(text.lower())]


def grams(parts: list[str]) -> list[str]:
    return [*parts, *[f"{a} {b}" for a, b in zip(parts, parts[1:], strict=False)]]


@dataclass
class Model:
    """Classes, and per n-gram with any weight its weights; ``templates`` holds the two-grams of each template."""

    classes: list[str]
    intercepts: np.ndarray
    weights: dict[str, np.ndarray]
    starts: frozenset[str]
    temperature: float
    templates: dict[str, list[frozenset[str]]]

    def probabilities(self, parts: list[str]) -> np.ndarray:
        logits = self.intercepts.copy()
        for gram in set(grams(parts)):
            found = self.weights.get(gram)
            if found is not None:
                logits += found
        logits = logits / self.temperature
        odds = np.exp(logits - logits.max())
        return odds / odds.sum()

    def similarity(self, family: str, parts: list[str]) -> float:
        """The largest share of a template's two-grams that stand in the words."""
        own = set(zip(parts, parts[1:], strict=False))
        return max(len(template & own) / len(template) for template in self.templates[family])

    def stretch(self, family: str, parts: list[str]) -> tuple[int, int]:
        """First word and end of the words that match a template of the family best, all words if none do."""
        pairs = list(zip(parts, parts[1:], strict=False))
        best = (0.0, 0, 0, len(parts))  # share, two-grams, first word, end
        for template in self.templates[family]:
            at = [i for i, pair in enumerate(pairs) if pair in template]
            for start in at:
                inside = [i for i in at if start <= i < start + len(template)]
                met = len({pairs[i] for i in inside})
                if (met / len(template), met) > best[:2]:
                    best = (met / len(template), met, start, inside[-1] + 2)
        return best[2:]

    def notices(self, parts: list[str]) -> tuple[str, float, float, int] | None:
        """Family, probability, similarity and first word of the paragraph's surest notice."""
        return max((found[:4] for found in self.all_notices(parts)), key=lambda found: found[1:3], default=None)

    def all_notices(self, parts: list[str]) -> list[tuple[str, float, float, int, int]]:
        """Family, probability, similarity, first word and end of every notice of the paragraph, in order.

        The words of a confirmed notice are taken out of its window and the rest is judged again, so that a window may hold several.
        """
        hits = [i for i, part in enumerate(parts) if part in self.starts]
        if not hits:
            return []
        half = WINDOW // 2
        last = max(0, math.ceil((len(parts) - WINDOW) / half))
        windows = {w for i in hits for w in (i // half - 1, i // half) if 0 <= w <= last} | {last for i in hits if i >= last * half}
        made = []
        for w in sorted(windows):
            window = parts[w * half:w * half + WINDOW]
            places = list(range(w * half, w * half + len(window)))
            while window:
                odds = self.probabilities(window)
                k = int(odds.argmax())
                if self.classes[k] == UNKNOWN:
                    break
                family, similarity = self.classes[k], self.similarity(self.classes[k], window)
                if odds[k] < LEAST_PROBABILITY and similarity < LEAST_SIMILARITY:
                    break
                start, end = self.stretch(family, window)
                made.append((family, float(odds[k]), similarity, places[start], places[end - 1] + 1))
                if similarity < LEAST_SIMILARITY:
                    break
                window = [*window[:start], "", *window[end:]]  # no word, so that its neighbours make no two-gram
                places = [*places[:start], places[start], *places[end:]]
        return merged(made)


def merged(found: list[tuple[str, float, float, int, int]]) -> list[tuple[str, float, float, int, int]]:
    """Notices of one family whose words overlap become one: that of the largest similarity, then probability."""
    made: list[tuple[str, float, float, int, int]] = []
    reach: dict[str, tuple[int, int]] = {}  # by family the end of its last notice and the notice's place
    for notice in sorted(found, key=lambda n: n[3:]):
        family, _, _, first, end = notice
        if family in reach and first < reach[family][0]:
            end, place = max(end, reach[family][0]), reach[family][1]
            if (notice[2], notice[1]) > (made[place][2], made[place][1]):
                made[place] = notice
        else:
            place = len(made)
            made.append(notice)
        reach[family] = (end, place)
    return made


def variants(template: list[str], background: list[list[str]], rng: np.random.Generator, count: int) -> list[list[str]]:
    """The template as it is, then with words left out, cut, or set between words of a background line."""
    made = [template]
    while len(made) < count:
        parts = [p for p in template if rng.random() > 0.08] or template
        if len(parts) > 8 and rng.random() < 0.4:
            size = int(rng.integers(max(6, len(parts) // 2), len(parts) + 1))
            start = int(rng.integers(0, len(parts) - size + 1))
            parts = parts[start:start + size]
        if background and rng.random() < 0.5:
            line = background[int(rng.integers(len(background)))][:WINDOW - len(parts)] if len(parts) < WINDOW else []
            cut = int(rng.integers(0, len(line) + 1))
            parts = [*line[:cut], *parts, *line[cut:]]
        made.append(parts)
    return made


def _fitted(rows: list[list[str]], labels: np.ndarray, classes: int, vocabulary: list[str], *, penalty: float = 2e-4,
            steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts by proximal gradient descent on the mean log loss with an L1 penalty."""
    place = {gram: i for i, gram in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, row in enumerate(rows):
        x[i, [place[g] for g in set(grams(row)) if g in place]] = 1
    y = np.eye(classes, dtype=np.float32)[labels]
    share = (1 / np.maximum(1, y.sum(axis=0))) @ y.T  # every class weighs the same
    share = (share / share.sum()).astype(np.float32)[:, None]
    w, b = np.zeros((len(vocabulary), classes), np.float32), np.zeros(classes, np.float32)
    rate = 1.0
    for _ in range(steps):
        logits = x @ w + b
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        slope = (odds / odds.sum(axis=1, keepdims=True) - y) * share
        w = w - rate * (x.T @ slope)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0)
        b = b - rate * slope.sum(axis=0)
    return w, b


def train(background: list[str], *, seed: int = 0) -> Model:
    """A model of the templates against background lines; lines that look like a template are left out."""
    rng = np.random.default_rng(seed)
    templates = {f: [tokens(t) for t in texts] for f, texts in TEMPLATES.items()}
    pairs = {f: [frozenset(zip(t, t[1:], strict=False)) for t in texts] for f, texts in templates.items()}
    everything = [p for own in pairs.values() for p in own]

    def alike(parts: list[str]) -> bool:
        own = set(zip(parts, parts[1:], strict=False))
        return any(len(p & own) >= 0.5 * len(p) for p in everything)

    plain = [parts[:WINDOW] for parts in map(tokens, background) if parts]
    plain = [parts for parts in plain if not alike(parts)]
    classes = [UNKNOWN, *templates]
    rows, labels = list(plain), [0] * len(plain)
    for family, texts in templates.items():
        for text in texts:
            made = variants(text, plain, rng, VARIANTS)
            rows += made
            labels += [classes.index(family)] * len(made)
        # Words of the notices out of order are no notice.
        for text in texts:
            rows += [[str(p) for p in rng.permutation(text)] for _ in range(2)]
            labels += [0, 0]
    vocabulary = sorted({g for texts in templates.values() for t in texts for g in grams(t)})
    label = np.array(labels)
    held = rng.random(len(rows)) < 0.25
    w, b = _fitted([r for r, h in zip(rows, held, strict=True) if not h], label[~held], len(classes), vocabulary)
    used = np.flatnonzero((w != 0).any(axis=1))
    weights = {vocabulary[i]: w[i].astype(float) for i in used}
    model = Model(classes, b.astype(float), weights, frozenset(), 1.0, pairs)

    def loss(temperature: float) -> float:
        model.temperature = temperature
        return -sum(math.log(max(1e-12, model.probabilities(r)[k])) for r, k, h in zip(rows, labels, held, strict=True) if h)

    model.temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss)
    # The unknown class stands for text without any weighted n-gram, so it must win there.
    others = np.delete(model.intercepts, 0).max()
    model.intercepts[0] = max(model.intercepts[0], others + model.temperature)
    # A window can only be a notice if it has a word that some family's weights favour over the unknown class.
    model.starts = frozenset(g.split()[0] for g, v in weights.items() if v[1:].max() > v[0])
    return model


def background_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> list[str]:
    """At most ``BACKGROUND_LINES`` lines of the ``BACKGROUND_DOCS`` documents with the smallest hash.

    Hashes are spread evenly, so a bound on them leaves about twice the documents wanted, before any text is moved.
    """
    rows = df.count()
    bound = -(2**63) + min(2**64 - 1, 2**64 * 2 * BACKGROUND_DOCS // max(1, rows))
    docs = df.select(F.xxhash64(F.col(doc_id).cast("string"), F.col(text)).alias("h"), F.col(text).alias("text")).where(
        F.col(text).isNotNull() & (F.col("h") <= F.lit(bound))).orderBy("h", "text").limit(BACKGROUND_DOCS)
    lines = docs.select("h", F.posexplode(F.split("text", "\n")).alias("place", "line")).where(F.length("line") > 0)
    return [r["line"] for r in lines.orderBy(F.xxhash64("h", "place"), "line").limit(BACKGROUND_LINES).collect()]


def notices_of_text(model: Model, text: str) -> Iterator[tuple[tuple[int, int], tuple]]:
    """Line and first word within it, and the notice, for every notice of the lines and of the blocks of non-blank lines."""
    block: list[tuple[int, list[str]]] = []

    def result() -> Iterator[tuple[tuple[int, int], tuple]]:
        if not any(part in model.starts for _, parts in block for part in parts):
            return
        found, begins, whole = [], [], []
        for _, parts in block:
            begins.append(len(whole))
            found += [(*n[:3], n[3] + len(whole), n[4] + len(whole)) for n in model.all_notices(parts)]
            whole += parts
        if len(block) > 1:
            found = merged(found + model.all_notices(whole))
        for notice in found:
            at = bisect_right(begins, notice[3]) - 1
            yield (block[at][0], notice[3] - begins[at]), notice

    for number, line in enumerate(text.split("\n")):
        if line and not line.isspace():
            block.append((number, tokens(line)))
        else:
            yield from result()
            block = []
    yield from result()


def scan(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per notice: id, line number, first word of the notice, family, probability, similarity, confirmed."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                for number, notice in notices_of_text(model, value or ""):
                    rows.append(i)
                    found.append((*number, *notice[:3], notice[2] >= LEAST_SIMILARITY))
            columns = list(zip(*found, strict=True)) if found else [[]] * 6
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(rows, pa.int64())), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                pa.array(columns[2], pa.string()), pa.array(columns[3], pa.float64()), pa.array(columns[4], pa.float64()), pa.array(columns[5], pa.bool_()),
            ], names=["doc_id", "line", "first_word", "family", "probability", "similarity", "confirmed"])

    slim = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kinds = "line long, first_word long, family string, probability double, similarity double, confirmed boolean"
    schema = T.StructType([slim.schema["doc_id"], *T._parse_datatype_string(kinds).fields])
    return slim.mapInArrow(task, schema)


def scan_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *, seed: int = 0) -> DataFrame:
    """Trains on the templates and a bounded sample of ``df``'s lines, then scans every row of ``df``."""
    return scan(df, train(background_lines(df, doc_id, text), seed=seed), doc_id, text)
