"""Licence scans: a trained paragraph classifier over sparse word n-grams.

Notices stand in lines and in blocks (lines up to one without words, read as one
paragraph, so that a wrapped notice is whole). Words are lower-case runs of
letters, digits, `.`, `+` and `-` with outer punctuation cut. A multinomial
logistic regression over word bigrams and trigrams is trained here, on the
templates below, on parts of them and on ordinary sentences.

Temperature and the unknown class are calibrated on what a model has not seen: in
each of FOLDS rounds it lacks a third of the templates and whole families. The
temperature has the least loss on the templates left out; a paragraph that is not
`none` is `unknown` if its best family stays below the cut that best tells the
templates left out from those of the families left out. A prediction is confirmed
when the paragraph, or the block it is in, holds at least CONFIRM of the n-grams
of one template of the family.

The weight table has at most a few thousand n-grams: it is fixed by the
templates, so its broadcast does not grow with the data. Scoring uses DataFrame
operations only; training is plain Python on the driver over the templates.
Every block is read, in the same pass as its lines.

Defined cases: null or empty text has no paragraphs; repeated rows each get a
row, null ids as well; an empty table gives an empty result; of equally likely
classes the first in CLASSES counts; very long texts count whole; columns beyond
doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, sized, table

CONFIRM = 0.6
FOLDS = 3
BLOCK_END = r"\n[^a-zA-Z0-9\n]*(?=\n)"
#: Notices by which works name their licence.
TEMPLATES = {
    "mit": ["Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "This project is licensed under the terms of the MIT license."],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Released under the Apache License 2.0."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "Released under the GNU General Public License version 2 or later.", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 3.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"],
    "bsd": ["Released under the BSD License.", "Licensed under the 3-Clause BSD license.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Use of this source code is governed by a BSD-style license"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "cc": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under the Creative Commons Attribution-ShareAlike license.", "Dedicated to the public domain under the Creative Commons CC0 1.0 Universal waiver.",
        "Licensed under CC BY 4.0.", "Licensed under CC BY-SA 4.0.", "Licensed under CC BY-NC 4.0.", "Released under CC BY-ND 4.0.", "This work is licensed under CC BY-NC-SA 3.0."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License."],
    "zlib": ["Released under the zlib license.", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"],
    "proprietary": ["All rights reserved.", "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited."],
}
#: Sentences without a licence notice that share phrases with notices.
ORDINARY = [
    "The driver lost his license after the accident.", "You can use the work of the public library free of charge.", "It was released under the name of the band in the spring.",
    "The file is in the hope of the people and the terms of the deal.", "This work is one of the best in the world.", "Permission was granted to the city by the state.", "The software is used by any person in the office.",
    "They may not use the road in the winter.", "A copy of the book is in the hands of the owner.", "The conditions are met by the players of the team.", "Without the help of the public the project would not be what it is.",
    "The general public is invited to the opening of the new version of the show.", "This program is on the air in the evening and the morning.", "A license plate was found under the bridge.", "The work is to be done under the eyes of the public.", "It is with or without you that this will be.",
]
#: Identifiers by which source files name their licence.
IDENTIFIERS = {"mit": ["MIT"], "apache-2.0": ["Apache-2.0"], "gpl": ["GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"], "lgpl": ["LGPL-2.1-only", "LGPL-3.0-or-later"], "bsd": ["BSD-2-Clause", "BSD-3-Clause"], "mpl-2.0": ["MPL-2.0"], "cc": ["CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0"], "isc": ["ISC"], "zlib": ["Zlib"]}
for _family, _names in IDENTIFIERS.items():
    TEMPLATES[_family] += [f"SPDX-License-Identifier: {name}" for name in _names]
NONE, UNKNOWN = "none", "unknown"
CLASSES = [NONE, *TEMPLATES]
WORD = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"


def grams_of(text: str) -> list[str]:
    words = re.findall(WORD, text.lower())
    return sorted({" ".join(words[k : k + n]) for n in (2, 3) for k in range(len(words) - n + 1)})


class LicenceModel:
    """vocabulary: n-gram -> position; weights[position][class] and bias[class], already divided by the temperature; cut: below it is unknown."""

    def __init__(self, vocabulary: dict[str, int], weights: list[list[float]], bias: list[float], cut: float = 0.5):
        self.vocabulary, self.weights, self.bias, self.cut = vocabulary, weights, bias, cut

    def scores(self, grams: list[str]) -> list[float]:
        z = list(self.bias)
        for g in sorted(grams):
            if g in self.vocabulary:
                for c, w in enumerate(self.weights[self.vocabulary[g]]):
                    z[c] += w
        return z

    def probabilities(self, grams: list[str], temperature: float = 1.0) -> list[float]:
        z = [x / temperature for x in self.scores(grams)]
        top = max(z)
        e = [math.exp(x - top) for x in z]
        return [x / sum(e) for x in e]

    def decide(self, text: str) -> tuple[str, float, bool]:
        """Class, probability and confirmation of one paragraph; the SQL form must agree."""
        grams = grams_of(text)
        p = self.probabilities(grams)
        best = max(range(len(p)), key=lambda c: (p[c], -c))
        name = CLASSES[best]
        if best == 0:
            return NONE, p[0], False
        if p[best] < self.cut:
            return UNKNOWN, p[best], False
        return name, p[best], any(len(set(t) & set(grams)) >= CONFIRM * len(t) for t in map(grams_of, TEMPLATES[name]))


def _fitted(templates: dict[str, list[str]], rounds: int, rate: float, l2: float, seed: int) -> LicenceModel:
    """Stochastic gradient descent over templates, parts of them, and ordinary sentences; classes without templates get no weight."""
    draw = random.Random(seed)
    examples: list[tuple[list[str], int]] = []
    for c, name in enumerate(CLASSES):
        for text in ORDINARY if c == 0 else templates[name]:
            words = text.split()
            parts = [text] * 3
            for _ in range(6):
                k = draw.randint(max(2, (2 * len(words)) // 3), max(2, len(words)))
                at = draw.randint(0, max(0, len(words) - k))
                parts.append(" ".join(words[at : at + k]))
            if c:  # notices amid ordinary words
                parts += [f"{draw.choice(ORDINARY)} {text} {draw.choice(ORDINARY)}" for _ in range(2)]
            examples += [(grams_of(p), c) for p in parts]
    examples += [([], 0)] * 20
    draw.shuffle(examples)
    vocabulary = {g: k for k, g in enumerate(sorted({g for t in [*ORDINARY, *(t for ts in templates.values() for t in ts)] for g in grams_of(t)}))}
    model = LicenceModel(vocabulary, [[0.0] * len(CLASSES) for _ in vocabulary], [0.0] * len(CLASSES))
    for step in range(rounds):
        now = rate / (1 + 0.1 * step)
        for grams, c in examples:
            p = model.probabilities(grams)
            known = [vocabulary[g] for g in grams if g in vocabulary]
            scale = now / max(1.0, math.sqrt(len(known)))
            for k in range(len(CLASSES)):
                d = (k == c) - p[k]
                model.bias[k] += 0.1 * now * d
                for f in known:
                    model.weights[f][k] += scale * d - now * l2 * model.weights[f][k] / len(examples)
    return model


def calibration(rounds: int, rate: float, l2: float, seed: int) -> tuple[float, float]:
    """Temperature and cut from templates and families that a model has not seen."""
    known: list[tuple[LicenceModel, list[str], int]] = []
    strange: list[tuple[LicenceModel, list[str]]] = []
    for fold in range(FOLDS):
        gone = {name for k, name in enumerate(TEMPLATES) if k % FOLDS == fold}
        rest = {name: [] if name in gone else [t for k, t in enumerate(ts) if k % FOLDS != fold] for name, ts in TEMPLATES.items()}
        model = _fitted(rest, rounds, rate, l2, seed)
        for c, name in enumerate(CLASSES[1:], 1):
            for k, text in enumerate(TEMPLATES[name]):
                if name in gone:
                    strange.append((model, grams_of(text)))
                elif k % FOLDS == fold:
                    known.append((model, grams_of(text), c))

    def loss(t: float) -> float:
        return -sum(math.log(max(m.probabilities(g, t)[c], 1e-12)) for m, g, c in known)

    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8), key=loss)
    best = lambda m, g: max(m.probabilities(g, temperature)[1:])
    right = [best(m, g) for m, g, c in known if max(range(1, len(CLASSES)), key=m.scores(g).__getitem__) == c]
    other = [best(m, g) for m, g in strange]
    error = lambda cut: sum(p < cut for p in right) / max(1, len(right)) + sum(p >= cut for p in other) / max(1, len(other))
    return temperature, min((k / 100 for k in range(30, 95)), key=lambda cut: (round(error(cut), 9), abs(cut - 0.6)))


@lru_cache(maxsize=1)
def train(rounds: int = 40, rate: float = 0.5, l2: float = 1e-3, seed: int = 5) -> LicenceModel:
    """The model of all templates, with the calibration of those that lack some."""
    t, cut = calibration(rounds // 2, rate, l2, seed)
    model = _fitted(TEMPLATES, rounds, rate, l2, seed)
    return LicenceModel(model.vocabulary, [[w / t for w in row] for row in model.weights], [b / t for b in model.bias], cut)


def _hits(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """row_key, block and hits, the (line of the block, place) of the model's n-grams there; line is null where an n-gram crosses a line's end.

    Every block of every text is read once, for its lines and as a whole. A block
    without an n-gram has the same outcome as an empty one, `none`, so only
    matches leave the scan. They are partly aggregated before the shuffle.
    """
    places = F.broadcast(docs.sparkSession.createDataFrame(sorted(model.vocabulary.items(), key=lambda x: x[1]), "gram string, place int"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    blocks = docs.select("row_key", F.posexplode(F.split(text, BLOCK_END)).alias("block", "body"))
    words = lambda line: F.regexp_extract_all(F.lower(line), F.lit(WORD), F.lit(0))
    own = F.flatten(F.transform(F.split("body", "\n"), lambda line, i: F.transform(words(line), lambda w: F.struct(w.alias("g"), i.alias("lo"), i.alias("hi")))))
    rows = blocks.select("row_key", "block", own.alias("w"))
    n = F.size("w")
    longer = lambda a, b: F.struct(F.concat_ws(" ", a["g"], b["g"]).alias("g"), a["lo"].alias("lo"), b["hi"].alias("hi"))
    rows = rows.where(n >= 2).withColumn("two", F.zip_with(F.slice("w", F.lit(1), n - 1), F.slice("w", F.lit(2), n - 1), longer))
    three = F.zip_with(F.slice("two", F.lit(1), n - 2), F.slice("w", F.lit(3), n - 2), longer)
    grams = rows.select("row_key", "block", F.explode(F.concat("two", three)).alias("x"))
    grams = grams.select("row_key", "block", F.col("x.g").alias("gram"), F.when(F.col("x.lo") == F.col("x.hi"), F.col("x.lo")).alias("line"))
    return grams.join(places, "gram").groupBy("row_key", "block").agg(F.collect_set(F.struct("line", "place")).alias("hits"))


def _scored(found: DataFrame, model: LicenceModel) -> DataFrame:
    """found (with `places`, sorted) and best and probability."""
    scored = found.join(F.broadcast(found.sparkSession.createDataFrame([(model.weights,)], "weights array<array<double>>")))  # one constant row
    for c, b in enumerate(model.bias):
        scored = scored.withColumn(f"z{c}", F.expr(f"aggregate(places, {b!r}D, (a, p) -> a + weights[p][{c}])"))
    z = F.array(*(F.col(f"z{c}") for c in range(len(CLASSES))))
    scored = scored.withColumn("z", z).withColumn("top", F.array_max("z")).withColumn("best", (F.array_position("z", F.col("top")) - 1).cast("int"))
    total = F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    return scored.select(*found.columns, "best", (1 / total).alias("probability"))


def _named(scored: DataFrame, model: LicenceModel, places: str = "places") -> DataFrame:
    """scored with licence and confirmed, the latter by the n-grams in the column `places`."""
    templates = [(c, [model.vocabulary[g] for g in grams_of(t)]) for c, name in enumerate(CLASSES) if c for t in TEMPLATES[name]]
    table_ = F.broadcast(scored.sparkSession.createDataFrame([(templates,)], "templates array<struct<c:int,grams:array<int>>>"))  # one constant row
    held = F.exists("templates", lambda t: (t["c"] == F.col("best")) & (F.size(F.array_intersect(t["grams"], F.col(places))) >= CONFIRM * F.size(t["grams"])))
    known = F.col("probability") >= model.cut
    names = F.array(*map(F.lit, CLASSES))
    licence = F.when(known, F.element_at(names, F.col("best") + 1)).otherwise(F.lit(UNKNOWN))
    return scored.join(table_).withColumn("licence", licence).withColumn("confirmed", known & held).drop("templates")


def paragraph_predictions(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """row_key, paragraph (0-based), licence, probability, confirmed for every line, and row_key, block, ... for every block, that is not `none`."""
    model = train()
    assert model.decide("")[0] == NONE
    hits = materialize(_hits(docs, model), "hits")
    of = lambda line: F.array_sort(F.array_distinct(F.transform(F.filter("hits", lambda x: x["line"] == line) if line is not None else F.col("hits"), lambda x: x["place"])))
    numbers = F.array_distinct(F.filter(F.transform("hits", lambda x: x["line"]), lambda x: x.isNotNull()))
    lines = hits.withColumn("line", F.explode(numbers)).withColumn("places", of(F.col("line"))).drop("hits")
    lines = materialize(_scored(lines, model).where("best > 0"), "lines")
    # a block whose n-grams are all of one line is judged as that line
    several = F.size(F.array_distinct(F.transform("hits", lambda x: F.coalesce(x["line"], F.lit(-1))))) > 1
    blocks = _scored(hits.where(several).withColumn("places", of(None)).drop("hits"), model).where("best > 0")
    # a line's number in its text: lines of the blocks before its own, and of its own before it
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bodies = docs.join(sized(materialize(lines.select("row_key").distinct(), "keys")), "row_key", "left_semi").dropDuplicates(["row_key"])
    before = F.aggregate(F.slice("bodies", F.lit(1), F.col("block")), F.lit(0), lambda a, x: a + F.size(F.split(x, "\n")))
    lines = lines.join(bodies.select("row_key", F.split(text, BLOCK_END).alias("bodies")), "row_key").withColumn("paragraph", before + F.col("line"))
    own = ["row_key", "licence", "probability", "confirmed"]
    return _named(lines, model).select("paragraph", *own), _named(blocks, model).select("block", *own)


def license_scan(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: n_paragraphs, n_notices, n_unknown, licences (confirmed families, sorted), notices and blocks (place:licence:confirmed), probability (largest)."""
    own = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = own.withColumn("row_key", F.struct(F.col("doc_id"), F.xxhash64("text").alias("t")))
    lines, blocks = paragraph_predictions(keyed)
    both = lines.select("row_key", F.lit(False).alias("block"), F.struct(F.col("paragraph").alias("at"), "licence", "confirmed", "probability").alias("x"))
    both = both.unionByName(blocks.select("row_key", F.lit(True).alias("block"), F.struct(F.col("block").alias("at"), "licence", "confirmed", "probability").alias("x")))
    found = both.groupBy("row_key").agg(F.array_sort(F.collect_list(F.when(~F.col("block"), F.col("x")))).alias("x"), F.array_sort(F.collect_list(F.when(F.col("block"), F.col("x")))).alias("y"))
    found = materialize(found.select(F.col("row_key.doc_id").alias("id_"), F.col("row_key.t").alias("t_"), "x", "y"), "licenses")
    narrow = own.select("doc_id", F.xxhash64("text").alias("t"), F.when(F.length("text") > 0, F.length("text") - F.length(F.translate("text", "\n", "")) + 1).otherwise(0).cast("long").alias("n_paragraphs"))
    none = F.expr("cast(array() as array<struct<at:int,licence:string,confirmed:boolean,probability:double>>)")
    out = narrow.join(found, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("t") == F.col("t_")), "left").withColumn("x", F.coalesce("x", none)).withColumn("y", F.coalesce("y", none))
    confirmed = F.filter(F.concat("x", "y"), lambda e: e["confirmed"])
    listed = lambda c: F.array_join(F.transform(c, lambda e: F.concat_ws(":", e["at"], e["licence"], e["confirmed"])), ",")
    return out.select(
        "doc_id", "n_paragraphs", F.size("x").cast("long").alias("n_notices"), F.size(F.filter("x", lambda e: e["licence"] == UNKNOWN)).cast("long").alias("n_unknown"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(confirmed, lambda e: e["licence"]))), ",").alias("licences"), listed("x").alias("notices"), listed("y").alias("blocks"),
        F.coalesce(F.array_max(F.transform(F.concat("x", "y"), lambda e: e["probability"])), F.lit(0.0)).alias("probability"),
    )


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
