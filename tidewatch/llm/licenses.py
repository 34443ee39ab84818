"""Licence scan: a trained paragraph classifier over word n-grams, confirmed by comparison with templates."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from tidewatch.llm.quality import COMMON_WORDS

WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
ORDERS = (1, 2, 3)
UNKNOWN = "unknown"
#: Notices and openings of licences by family (fixed values).
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0", "This project is released under the Apache 2.0 license.", "Apache License Version 2.0, January 2004"),
    "mit": (
        "Released under the MIT License.", "Licensed under the MIT license.", "SPDX-License-Identifier: MIT", "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.", "GNU General Public License Version 3, 29 June 2007", "Distributed under the GPL v3."),
    "gpl-2.0": (
        "SPDX-License-Identifier: GPL-2.0-only", "Licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; "
        "either version 2 of the License, or (at your option) any later version.", "GNU General Public License Version 2, June 1991"),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License.", "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 2.1 of the License, or (at your option) any later version."),
    "agpl-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version."),
    "bsd": (
        "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "Licensed under the BSD license.", "BSD 2-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related rights to this work.", "Released under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"),
}
#: Sentences that speak of rights without being a licence, and licences of no family here (fixed values).
OTHERS = (
    "All rights reserved.", "You need a driving license to rent a car.", "The license fee is due every year.", "The software version 3 was released in June.", "He works for the Free Software Foundation.",
    "The general public may visit the museum.", "A copy of the minutes was published.", "See the terms of use.", "The license plate was missing.", "Terms and conditions apply to this offer.",
    "The author has the right to appeal.", "The Apache helicopter landed.", "She graduated from MIT in 2004.", "The commons were open to all.", "The permission slip must be signed by a parent.")
ROUNDS, VARIANTS, SEED = 250, 12, 11
LEAST_PROBABILITY = 0.5
#: A template confirms with this share of its n-grams, or where that share of the paragraph's and so many are its own.
LEAST_OVERLAP, LEAST_SHARED = 0.6, 12

_COMMON = frozenset(w for words in COMMON_WORDS.values() for w in words)


def ngrams(words: Sequence[str]) -> set[str]:
    """Word n-grams of order 1 to 3 that hold at least one word that is not a mere function word."""
    rare = [w not in _COMMON for w in words]
    return {" ".join(words[i:i + n]) for n in ORDERS for i in range(len(words) - n + 1) if any(rare[i:i + n])}


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class LicenceModel:
    """Families, n-gram numbers, weights, bias and temperature; the last class is the unknown one."""

    families: list[str]
    place: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    templates: list[tuple[str, frozenset[str]]]
    words: frozenset[str]

    def __post_init__(self) -> None:
        self.holders: dict[str, list[int]] = {}
        for k, (_, grams) in enumerate(self.templates):
            for g in grams:
                self.holders.setdefault(g, []).append(k)

    def explained(self, words: Sequence[str]) -> float:
        """The largest share of a template's n-grams that these words hold."""
        shared = Counter(k for g in ngrams(words) for k in self.holders.get(g, ()))
        return max((n / len(self.templates[k][1]) for k, n in shared.items()), default=0.0)

    def paragraphs(self, lines: Sequence[str]) -> Iterator[tuple[int, int, list[str]]]:
        """(first line, last line, words) of the paragraphs that hold a word of a template.

        A line is joined to the lines before it where both hold template words
        and together explain a template better than either explains any.  So a
        notice that is wrapped over lines becomes one paragraph, whole notices
        on lines of their own stay apart, and prose around them is not joined.
        A template's word that was broken at a hyphen is put together on the second line.
        """
        rows = [WORD.findall(line.lower()) for line in lines]
        for k in range(1, len(rows)):
            if rows[k] and rows[k - 1] and lines[k - 1].rstrip().endswith("-") and (whole := f"{rows[k - 1][-1]}-{rows[k][0]}") in self.words:
                rows[k - 1][-1:], rows[k] = [], [whole, *rows[k][1:]]
        first, last, held, share = 0, -1, [], 0.0
        for k, words in enumerate(rows):
            if self.words.isdisjoint(words):
                continue
            alone = self.explained(words)
            if held and last == k - 1 and max(share, alone) < (both := self.explained(held + words)):
                last, held, share = k, held + words, both
                continue
            if held:
                yield first, last, held
            first, last, held, share = k, k, words, alone
        if held:
            yield first, last, held

    def classify(self, paragraph: Sequence[str]) -> tuple[str, float, bool]:
        """(family or unknown, calibrated probability, confirmed by a template) of one paragraph's words."""
        grams = ngrams(paragraph)
        at = [self.place[g] for g in grams if g in self.place]
        p = softmax((self.weights[at].sum(axis=0) + self.bias)[None, :] / self.temperature)[0]
        best = int(p.argmax())
        family = self.families[best] if best < len(self.families) else UNKNOWN
        if family == UNKNOWN or p[best] < LEAST_PROBABILITY:
            return UNKNOWN, float(p[best]), False
        confirmed = any(
            len(t & grams) >= LEAST_OVERLAP * len(t) or LEAST_SHARED <= len(t & grams) >= LEAST_OVERLAP * len(grams) for f, t in self.templates if f == family)
        return family, float(p[best]), confirmed


def _variants(words: list[str], rng: np.random.Generator, filler: list[str]) -> Iterator[list[str]]:
    """A notice as it occurs: whole, with words lost, broken off, and within other words."""
    yield words
    for _ in range(VARIANTS):
        cut = len(words) if len(words) < 16 else int(rng.integers(len(words) // 2, len(words) + 1))
        kept = [w for w in words[:cut] if len(words) < 5 or rng.random() > 0.08]
        before, after = rng.integers(0, 6, 2)
        yield [*rng.choice(filler, before), *kept, *rng.choice(filler, after)]


def fit_licences(templates: dict[str, Sequence[str]] = TEMPLATES, others: Sequence[str] = OTHERS) -> LicenceModel:
    """Multinomial logistic regression on variants of the templates, with an unknown class of other sentences.

    The n-grams of the templates are the features, so the model's size is fixed
    by them.  Half of the variants fit the weights; the other half fit one
    temperature that calibrates the probabilities.
    """
    rng = np.random.default_rng(SEED)
    filler = [w for s in others for w in WORD.findall(s.lower())]
    families = list(templates)
    known = [(f, frozenset(ngrams(WORD.findall(t.lower())))) for f, ts in templates.items() for t in ts]
    place = {g: k for k, g in enumerate(sorted(set().union(*(t for _, t in known))))}
    rows, labels = [], []
    for label, texts in [*enumerate(templates.values()), (len(families), others)]:
        for text in texts:
            for variant in _variants(WORD.findall(text.lower()), rng, filler):
                rows.append([place[g] for g in ngrams(variant) if g in place])
                labels.append(label)
    for _ in range(len(rows) // 4):  # loose words of the templates in any order are no licence
        loose = [str(w) for w in rng.choice(filler, 6)]
        rows.append([place[g] for g in ngrams(loose) if g in place])
        labels.append(len(families))
    x = np.zeros((len(rows), len(place)))
    for k, row in enumerate(rows):
        x[k, row] = 1.0
    y = np.eye(len(families) + 1)[labels]
    fit = np.arange(len(rows)) % 2 == 0
    w, b = np.zeros((len(place), y.shape[1])), np.zeros(y.shape[1])
    for _ in range(ROUNDS):
        off = (softmax(x[fit] @ w + b) - y[fit]) / fit.sum()
        w -= 8.0 * (x[fit].T @ off + 1e-4 * w)
        b -= 8.0 * off.sum(axis=0)
    z = x[~fit] @ w + b
    losses = [(-np.log((softmax(z / t) * y[~fit]).sum(axis=1) + 1e-12).mean(), t) for t in np.geomspace(0.25, 4, 25)]
    words = frozenset(g for g in place if " " not in g)
    return LicenceModel(families, place, w, b, float(min(losses)[1]), known, words)


def scan_licences(docs: DataFrame, columns: Sequence[str], model: LicenceModel | None = None, text: str = "text") -> DataFrame:
    """``columns`` of the documents, n_paragraphs, licences, n_licensed, probability, confirmed, and the matched paragraphs.

    A paragraph is a line with a word, or lines in a row that together explain
    a template better than each part explains any: a notice wrapped over them.
    Each is classified.  One that holds no word of any template has the
    probabilities of an empty one, which is unknown, so it is passed over at
    once.  ``licences`` lists the families that a template confirms,
    ``notices`` each paragraph that a family was found in (line and last line
    from 0, family, calibrated probability, confirmed by template comparison);
    ``probability`` is the highest of them and ``confirmed`` says whether a
    template confirms one.  Null and empty texts have no paragraphs and no
    licence; columns of the same names are replaced.  The model is fixed in
    size by its templates and broadcast.
    """
    model = model or fit_licences()
    added = ["n_paragraphs", "n_licensed", "licences", "probability", "confirmed", "notices"]
    columns = [c for c in columns if c not in added]
    kept = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text}`").alias("_body"))
    parts = (model.families, model.place, model.weights, model.bias, model.temperature, model.templates, model.words)
    shared = docs.sparkSession.sparkContext.broadcast(parts)
    notice = StructType([StructField("line", LongType()), StructField("last_line", LongType()), StructField("family", StringType()), StructField("probability", DoubleType()), StructField("confirmed", BooleanType())])
    fields = [StructField("n_paragraphs", LongType()), StructField("notices", ArrayType(notice))]
    arrow = pa.list_(pa.struct([("line", pa.int64()), ("last_line", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("confirmed", pa.bool_())]))

    def scan(model: LicenceModel, body: str) -> tuple[int, list[dict]]:
        lines = body.split("\n")
        n, found = sum(1 for line in lines if line.split()), []
        if model.words.isdisjoint(WORD.findall(body.lower())):
            return n, found
        for first, last, words in model.paragraphs(lines):
            n -= last - first
            family, p, confirmed = model.classify(words)
            if family != UNKNOWN:
                found.append({"line": first, "last_line": last, "family": family, "probability": p, "confirmed": confirmed})
        return n, found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = LicenceModel(*shared.value)
        for batch in batches:
            seen = [scan(known, t.as_py() or "") for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([n for n, _ in seen], pa.int64()), pa.array([f for _, f in seen], arrow)], names=[*columns, "n_paragraphs", "notices"])

    found = kept.mapInArrow(run, StructType([*kept.schema.fields[:-1], *fields]))
    return found.select(
        *[F.col(f"`{c}`") for c in columns], "n_paragraphs", F.size("notices").cast("long").alias("n_licensed"),
        F.array_sort(F.array_distinct(F.transform(F.filter("notices", lambda x: x["confirmed"]), lambda x: x["family"]))).alias("licences"), F.array_max(F.col("notices.probability")).alias("probability"),
        F.exists("notices", lambda x: x["confirmed"]).alias("confirmed"), "notices")
