"""Licence scans by a trained paragraph classifier (DataFrame functions only on the data).

A paragraph is a line of a text with a cue word, or a run of neighbouring lines that all have one (notices are wrapped).  It is
classified by a sparse logistic regression over word 1- and 2-grams: licence families against "unknown", which stands for prose and for
licences that are not listed.  Cue words are not chosen by hand: for every gram that speaks for any family more than for "unknown"
there is one, its least common word.  As the biases speak for "unknown", a line without one is "unknown" for certain, so every line is judged
and nothing is lost by not scoring it.  Words are compared in small letters; "mit" is another word than "MIT".

Training texts are the fixed notices below with variants (words left out), the fixed unknown texts, and a bounded sample of
the lines of the scanned texts: BACKGROUND_TEXTS texts with the smallest hashes that have at most BACKGROUND_CHARS characters, and of
their lines BACKGROUND_LINES; a line that is a template counts as its family, others as "unknown".  Probabilities are tempered on
notices that were held out whole (FOLDS folds), so that "unknown" is calibrated on wordings that training has not seen.

A predicted family is confirmed if the paragraph has words of MIN_SHARED of the weight of one of the family's templates; words weigh by
how few classes use them, so "distributed under the ... license" alone confirms nothing.

Weights are a small table (bounded by the fixed texts' n-grams) that is broadcast.  Only lines with a cue word leave their row.

Defined results: null texts have no paragraphs; listed are paragraphs with a cue word and a probability of MIN_LISTED or more for some
family; of two families with equal scores the first by name counts, and a family that only equals "unknown" is "unknown"; a run is listed only if it is
confirmed and no line of it is for the same family; repeated rows give their paragraphs each time; an empty table gives
an empty table; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read

#: Notices and opening lines of public licences, by family.
TEMPLATES = {
    "agpl": [
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "Licensed under the AGPL v3.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Apache License Version 2.0, January 2004",
        "SPDX-License-Identifier: Apache-2.0",
        "Distributed under the Apache 2.0 terms.",
        "This project is released under the Apache 2.0 license.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Distributed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "BSD 2-Clause License",
        "BSD 3-Clause",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "Available under the Creative Commons Attribution license.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "Free for non-commercial use under CC BY-NC.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related rights to this work (CC0 1.0).",
        "CC0 1.0 Universal, public domain dedication",
        "This work is dedicated to the public domain under CC0.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "either version 3 of the License, or (at your option) any later version of the GNU General Public License",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GPL v2 or later.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Distributed under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "Distributed under the LGPL v2.1 or later.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "The MIT License (MIT)",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Mozilla Public License Version 2.0",
        "Covered by the MPL 2.0.",
    ],
    "proprietary": [
        "Copyright. All rights reserved.",
        "All rights reserved.",
        "No part of this publication may be reproduced or distributed in any form without prior written permission.",
        "Unauthorized copying of this file is strictly prohibited. Proprietary and confidential.",
    ],
}
#: Licences that are not listed, and prose with licence words that grants nothing.
UNKNOWN = [
    "Distributed under the Boost Software License, Version 1.0.",
    "This program is made available under the terms of the Eclipse Public License v. 2.0",
    "Licensed under the zlib license.",
    "You may redistribute this program under the terms of the Artistic License 2.0.",
    "Licensed under the EUPL, Version 1.2 or later.",
    "Do what the fuck you want to public license",
    "Licensed under the SIL Open Font License, Version 1.1.",
    "This file is released under the Common Development and Distribution License.",
    "Released under the terms of the Open Database License.",
    "Please read the license before you use the software.",
    "See the license file for details.",
    "He lost his driving license after the accident.",
    "The software was updated and the file was copied to the new disk.",
    "You need permission from your parents to attend the trip.",
    "The restaurant applied for a liquor license last year.",
    "The warranty covers repairs for two years from the date of purchase.",
    "The professor at MIT published a paper on free energy.",
    "She studied at MIT and later taught there.",
    "The general said that the public had a right to know.",
    "Copyright law is taught in the second year of the course.",
    "The apache helicopter landed near the village at dawn.",
    "A creative person shares common ideas with others in the version they like.",
    "The conditions of the contract were met by both sides.",
    "Terms used in this chapter are explained in the glossary.",
    "The fishing license costs ten dollars and is valid for one season.",
    "Das Haus mit dem Garten liegt mit der Bank am Weg, und mit ihm der Brunnen.",
    "Mit und mit der mit.",
    "Is the old version of the work still distributed in print?",
    "All rights and duties of the members were discussed, and some seats were reserved.",
    "The public domain of the village was sold.",
    "The prisoner was released under certain terms.",
    "The grant was given to any person with a copy of the form, free of charge.",
]
UNKNOWN_CLASS = "unknown"
MIN_PROBABILITY, MIN_SHARED, MIN_LISTED = 0.5, 0.75, 0.1
BACKGROUND_TEXTS, BACKGROUND_CHARS, BACKGROUND_LINES = 200, 20_000, 800
FOLDS, VARIANTS, ROUNDS, RATE, RIDGE = 4, 6, 120, 0.3, 2e-4
#: Weights below are left out, and every family's bias is at least so far under that of "unknown".
LEAST_WEIGHT, LEAST_BIAS = 0.1, 0.5
#: Words that are no feature, alone or beside one another.
STOP = frozenset("a an and all any are as at be by can do for from has have if in is it may no not of on or that the this to was what with you your".split())
_WORD = r"[^A-Za-z0-9.+\-]+"


def words_of(text: str) -> list[str]:
    parts = (x.strip(".") for x in re.split(_WORD, text.replace("icence", "icense")))
    return [{"mit": "with", "Mit": "with"}.get(w, w.lower()) for w in parts if w]


def grams_of(text: str) -> set[str]:
    w = words_of(text)
    return set(w) | {f"{a} {b}" for a, b in zip(w, w[1:])}


def _word_weights() -> dict[str, float]:
    """How much a word tells: classes over classes that use it, as a logarithm."""
    users: dict[str, set] = {}
    for k, texts in [*TEMPLATES.items(), (UNKNOWN_CLASS, UNKNOWN)]:
        for t in texts:
            for w in words_of(t):
                users.setdefault(w, set()).add(k)
    return {w: 1 + math.log(1 + len(TEMPLATES)) - math.log(len(u)) for w, u in users.items()}


@functools.cache
def template_shares() -> list[tuple[str, dict[str, float]]]:
    """(family, word to its share of the template's weight) of every template."""
    weight = _word_weights()
    found = []
    for k in sorted(TEMPLATES):
        for t in TEMPLATES[k]:
            own = {w: weight[w] for w in set(words_of(t))}
            found.append((k, {w: v / sum(own.values()) for w, v in own.items()}))
    return found


def confirmed_by(family: str, text: str) -> float:
    """The largest share of a template of ``family`` whose words are in ``text``."""
    have = set(words_of(text))
    return max(sum(v for w, v in t.items() if w in have) for k, t in template_shares() if k == family)


@dataclass
class Model:
    classes: list[str]
    weights: dict[str, np.ndarray]
    bias: np.ndarray
    #: In how many unknown training texts a word occurs.
    common: Counter

    @functools.cached_property
    def cues(self) -> list[str]:
        """A word of each gram that speaks for a family more than for "unknown"."""
        positive = [g.split(" ") for g, v in self.weights.items() if (v[1:] - v[0]).max() > 0]
        return sorted({min(g, key=lambda w: (self.common[w], w)) for g in positive})

    def logits(self, text: str) -> np.ndarray:
        known = [self.weights[g] for g in grams_of(text) if g in self.weights]
        return (self.bias + sum(known)) / math.sqrt(max(1, len(known)))

    def predict(self, text: str) -> tuple[str, float]:
        z = self.logits(text)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        k = int(z.argmax())
        return (self.classes[k] if k and p[k] >= MIN_PROBABILITY else UNKNOWN_CLASS), float(p[k])


def _rows(texts: list[tuple[str, int]], seed: int) -> list[tuple[set[str], int]]:
    """Grams and class of every text and its variants."""
    g = random.Random(seed)
    found = []
    for text, y in texts:
        found.append((grams_of(text), y))
        found += [(grams_of(" ".join(x for x in text.split() if g.random() > 0.1)), y) for _ in range(VARIANTS)]
    return found


def _fit(rows: list[tuple[set[str], int]], vocab: list[str], n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (gram, class) and biases of a softmax regression by accelerated gradient descent."""
    at = {v: k for k, v in enumerate(vocab)}
    own = [[*(at[g] for g in sorted(grams) if g in at), len(vocab)] for grams, _ in rows]
    sizes = np.array([len(c) for c in own])
    column = np.concatenate([np.array(c) for c in own])
    value = np.repeat(1 / np.sqrt(np.maximum(1, sizes - 1)), sizes)[:, None]
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    by_column, row = np.argsort(column, kind="stable"), np.repeat(np.arange(len(own)), sizes)
    used, first = np.unique(column[by_column], return_index=True)
    y = np.eye(n_classes)[[r[1] for r in rows]]
    each = (y / np.maximum(y.sum(0), 1)).sum(1, keepdims=True) * len(rows) / n_classes  # classes weigh alike, up to a point
    each = np.minimum(each, 4)
    w = np.zeros((len(vocab) + 1, n_classes))
    speed = np.zeros_like(w)
    for _ in range(ROUNDS):
        ahead = w + 0.9 * speed
        z = np.add.reduceat(ahead[column] * value, start)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        grad = RIDGE * len(rows) * ahead
        grad[used] += np.add.reduceat(((each * (p - y))[row] * value)[by_column], first) / 8
        speed = 0.9 * speed - RATE / math.sqrt(len(rows)) * grad
        w = w + speed
    return w[:-1], w[-1]


@functools.lru_cache(4)
def train(background: tuple[str, ...] = ()) -> Model:
    classes = [UNKNOWN_CLASS, *sorted(TEMPLATES)]
    fixed = [(t, classes.index(k)) for k in sorted(TEMPLATES) for t in TEMPLATES[k]] + [(t, 0) for t in UNKNOWN]
    often = Counter(w for t in UNKNOWN for w in set(words_of(t)))
    vocab = sorted({g for t, y in fixed if y for g in grams_of(t) if not STOP.issuperset(g.split(" "))})
    common, real = Counter(often), []
    for line in background:
        best = max((confirmed_by(k, line), k) for k in TEMPLATES)
        real.append((grams_of(line), classes.index(best[1]) if best[0] >= 0.95 else 0))
        common.update(set(words_of(line)) if best[0] < 0.95 else ())
    held: list[tuple[np.ndarray, int]] = []
    for fold in range(FOLDS):
        near = _rows([r for k, r in enumerate(fixed) if k % FOLDS != fold], fold)
        w, b = _fit([*near, *real[: len(real) // 2]], vocab, len(classes))
        m = Model(classes, dict(zip(vocab, w)), b, common)
        held += [(m.logits(t), y) for k, (t, y) in enumerate(fixed) if k % FOLDS == fold]
    z, y = np.array([h[0] for h in held]), np.array([h[1] for h in held])

    def loss(heat: float) -> float:
        q = z * heat
        q = q - q.max(1, keepdims=True)
        return float((np.log(np.exp(q).sum(1)) - q[np.arange(len(y)), y]).sum())

    heat = min((0.2, 0.3, 0.4, 0.5, 0.7, 0.85, 1.0, 1.2, 1.5), key=loss)
    w, b = _fit([*_rows(fixed, FOLDS), *real], vocab, len(classes))
    w, b = w * heat, b * heat
    w = w - w[:, :1]  # "unknown" weighs nothing, so a weight says what speaks for a family against it
    w[np.abs(w) < LEAST_WEIGHT] = 0
    b = np.minimum(b - b[0], -LEAST_BIAS)
    b[0] = 0
    weights = {g: v.astype(np.float64) for g, v in zip(vocab, w) if v.any()}
    return Model(classes, weights, b.astype(np.float64), common)


def background(docs: DataFrame) -> tuple[str, ...]:
    """The bounded sample of lines that training takes from ``docs``."""
    short = docs.where(F.length("text") <= BACKGROUND_CHARS).select("text", F.xxhash64("text").alias("h"))
    texts = [r.text for r in short.orderBy("h", "text").limit(BACKGROUND_TEXTS).collect()]
    lines = sorted({x for t in texts for x in t.split("\n") if x.strip()}, key=lambda x: xxhash.xxh64_intdigest(x.encode()))
    return tuple(lines[:BACKGROUND_LINES])


def signed_hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def _tokens(line: Column) -> Column:
    parts = F.split(F.replace(line, F.lit("icence"), F.lit("icense")), _WORD)
    plain = lambda w: F.when(w.isin("mit", "Mit"), "with").otherwise(F.lower(w))
    return F.array_remove(F.transform(parts, lambda w: plain(F.trim(w, F.lit(".")))), "")


def paragraphs(docs: DataFrame, cues: list[str]) -> DataFrame:
    """row, doc_id, line_no, n_lines and words of every line with a cue word and every run of two or more of them."""
    known = F.array(*[F.lit(c) for c in cues])
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.transform(F.split("text", "\n"), _tokens).alias("t"))
    rows = rows.where(F.arrays_overlap(F.flatten("t"), known))

    def units(flags: Column) -> Column:
        run = lambda at: F.array_position(F.concat(F.slice(flags, at + 1, F.size(flags)), F.array(F.lit(False))), F.lit(False)) - 1
        begins = lambda f, k: f & ~F.coalesce(F.get(flags, k - 1), F.lit(False)) & F.coalesce(F.get(flags, k + 1), F.lit(False))
        lines = F.transform(flags, lambda f, k: F.when(f, F.struct(k.alias("line_no"), F.lit(1).cast("long").alias("n_lines"))))
        runs = F.transform(flags, lambda f, k: F.when(begins(f, k), F.struct(k.alias("line_no"), run(k).alias("n_lines"))))
        return F.array_compact(F.concat(lines, runs))

    found = F.explode(let(F.transform("t", lambda t: F.arrays_overlap(t, known)), units)).alias("u")
    rows = rows.select("row", "doc_id", "t", found)
    words = F.flatten(F.slice("t", F.col("u.line_no") + 1, F.col("u.n_lines").cast("int")))
    return rows.select("row", "doc_id", "u.line_no", "u.n_lines", words.alias("w"))


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, line_no, n_lines, family, probability, shared, confirmed of every paragraph that may be of a family."""
    model = model or train(background(docs))
    spark, classes, shares = docs.sparkSession, model.classes, template_shares()
    grams = sorted(set(model.weights) | {w for _, t in shares for w in t})
    none = np.zeros(len(classes))
    table = [
        (signed_hash(g), g in model.weights, model.weights.get(g, none).tolist(), [t.get(g, 0.0) for _, t in shares]) for g in grams
    ]
    table = F.broadcast(spark.createDataFrame(table, "gram long, known boolean, weight array<double>, share array<double>"))
    pairs = F.transform(
        F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda x, k: F.concat(F.get(F.col("w"), k), F.lit(" "), x)
    )
    unit = ["row", "doc_id", "line_no", "n_lines"]
    one = paragraphs(docs, model.cues).select(*unit, F.explode(F.array_distinct(F.concat("w", pairs))).alias("g"))
    met = one.select(*unit, F.xxhash64("g").alias("gram")).join(table, "gram")
    sums = lambda c, n: F.array(*[F.sum(F.get(c, F.lit(k))) for k in range(n)])
    scored = met.groupBy(*unit).agg(
        F.count_if("known").alias("known"), sums("weight", len(classes)).alias("z"), sums("share", len(shares)).alias("s")
    )
    root = F.sqrt(F.greatest(F.col("known"), F.lit(1)))
    bias = F.array(*[F.lit(float(b)) for b in model.bias])
    scored = scored.withColumn("z", F.zip_with("z", bias, lambda a, b: (a + b) / root))
    scored = scored.withColumn("top", F.array_max("z"))
    total = F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    family_top = F.array_max(F.slice("z", 2, len(classes)))
    best = (F.array_position("z", F.col("top")) - 1).cast("int")
    scored = scored.select(
        *unit, "s", best.alias("best"), (F.lit(1.0) / total).alias("probability"), (F.exp(family_top - F.col("top")) / total).alias("chance")
    )
    by_family = F.array(
        F.lit(0.0), *[F.greatest(F.lit(0.0), *[F.get("s", F.lit(k)) for k, (f, _) in enumerate(shares) if f == c]) for c in classes[1:]]
    )
    known = (F.col("best") > 0) & (F.col("probability") >= MIN_PROBABILITY)
    similar = F.get(by_family, F.col("best"))
    judged = scored.where(F.col("chance") >= MIN_LISTED).select(
        *unit,
        F.when(known, F.get(F.array(*[F.lit(c) for c in classes]), F.col("best"))).otherwise(UNKNOWN_CLASS).alias("family"),
        F.round("probability", 6).alias("probability"),
        F.round(similar, 6).alias("shared"),
        (known & (similar >= MIN_SHARED)).alias("confirmed"),
    )
    # all paragraphs of a text that are left: few, as each has a fair chance of being a notice
    near = judged.groupBy("row").agg(F.collect_list(F.struct(*judged.columns[1:])).alias("all"))

    def wanted(x: Column) -> Column:
        inside = lambda y: (
            y["confirmed"] & (y["n_lines"] == 1) & (y["family"] == x["family"])
            & (y["line_no"] >= x["line_no"]) & (y["line_no"] < x["line_no"] + x["n_lines"])
        )
        return (x["n_lines"] == 1) | (x["confirmed"] & ~F.exists("all", inside))

    out = near.select(F.explode(F.filter("all", wanted)).alias("p")).select("p.*")
    return out.withColumn("line_no", F.col("line_no").cast("long"))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
