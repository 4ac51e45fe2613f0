"""Licence scan: a trained paragraph classifier over sparse word n-grams, confirmed on templates.

The model is a multinomial logistic regression over word 1-, 2- and 3-grams, with a class for each
family, `unknown` for licences of other families, and `none` for text that gives no licence. It learns
from notices (each family's names in many wordings, and the templates), from the names of other licences
in the same wordings, from sentences that deny a licence or only speak of one, and from lines of the
corpus that name no licence. Wordings left out of the training set the temperature and the levels of the
two last classes; no family is decided by what confirms it later.

Scoring runs in DataFrame functions only. A line's n-grams (with the two words before the line, so that
a wrapped "not" still counts) meet the weights once, and a run of neighbouring lines has the sum of their
scores, so a wrapped notice costs additions. Of the runs that start on a line the one with the clearest
class counts. A prediction is confirmed once enough of a template of its family stands in the run, or the
whole of a short name.

No list of key words stands before the classifier: the model tells the words that its families' weights
rest on, and only lines near one of them are scored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.shared import hash_sample

UNKNOWN, NONE = "unknown", "none"
#: Notices by licence family.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache-2.0", "Distributed under the terms of the Apache License 2.0."),
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version."),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Released under the BSD License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced without permission."),
]
#: Sentences that only look like licences.
LOOKALIKES = [
    "Her driving license had expired in May.",
    "The licensed vendor released a new version of the program.",
    "He was granted a license to sell food in the park.",
    "The restaurant is licensed and open to the public.",
    "A general license fee is charged for each version.",
    "Copyright law is taught in the second year.",
    "The terms of the agreement are under review.",
    "The software was released under another name.",
    "This work is not licensed.",
    "The warranty covers parts for two years.",
    "Version 2.0 of the report was released in March.",
    "Permission to enter the building was granted.",
    "The free software course is open to any person.",
    "Source files and binary forms are kept in the archive.",
    "All seats are reserved.",
    "The public library offers general reading.",
    "International attribution of the painting is disputed.",
    "The author reserved a table and copied the menu.",
    "The Apache helicopter landed near the Mozilla office.",
    "He studied at MIT and published under another name.",
]
#: Names of each family in notices.
NAMES = {
    "apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "the Apache Software License, version 2.0", "Apache 2.0", "Apache-2.0"],
    "mit": ["the MIT License", "the terms of the MIT license", "an MIT-style license", "MIT"],
    "gpl-3.0": ["the GNU General Public License, version 3", "the GNU GPL v3", "GPLv3", "GPL-3.0", "the GNU General Public License as published by the Free Software Foundation, version 3"],
    "gpl-2.0": ["the GNU General Public License, version 2", "the GNU GPL v2", "GPLv2", "GPL-2.0", "the GNU General Public License as published by the Free Software Foundation, version 2"],
    "lgpl": ["the GNU Lesser General Public License", "the GNU LGPL", "LGPL", "LGPL-2.1", "LGPLv3", "the terms of the GNU Lesser General Public License"],
    "cc-by-nc-4.0": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License", "the Creative Commons Attribution-NonCommercial license"],
    "cc-by-4.0": ["CC BY 4.0", "CC-BY-4.0", "a Creative Commons Attribution 4.0 International License", "the Creative Commons Attribution license"],
    "cc-by-sa-4.0": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License", "the Creative Commons Attribution-ShareAlike license"],
    "cc0": ["CC0 1.0", "CC0-1.0", "the CC0 1.0 Universal public domain dedication", "Creative Commons Zero"],
    "bsd": ["the BSD License", "the 3-Clause BSD License", "a BSD-style license", "the 2-clause BSD license", "BSD-3-Clause", "BSD-2-Clause"],
    "mpl-2.0": ["the Mozilla Public License, v. 2.0", "the Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"],
    "proprietary": ["a proprietary license", "a commercial license, all rights reserved"],
}
#: Names of licences of no family above.
OTHER_NAMES = [
    "the GNU Affero General Public License, version 3", "the GNU Affero General Public License", "AGPLv3", "AGPL-3.0", "the ISC License", "ISC", "the Unlicense", "Unlicense", "CC BY-ND 4.0", "CC BY-NC-ND 4.0", "CC BY-NC-SA 4.0",
    "a Creative Commons Attribution-NoDerivatives 4.0 International License", "a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "the Eclipse Public License 2.0", "EPL-2.0", "the Artistic License 2.0",
    "the Boost Software License 1.0", "BSL-1.0", "the zlib License", "the European Union Public Licence", "EUPL-1.2", "the WTFPL", "the SIL Open Font License 1.1", "the Server Side Public License", "SSPL-1.0", "the Business Source License", "the Microsoft Public License",
    "the Python Software Foundation License", "the Common Development and Distribution License", "CDDL-1.0", "the Open Database License", "the license of the company", "our license agreement", "its own license",
]
#: Wordings around a name that give a licence; the last ones only calibrate.
FRAMES = [
    "Licensed under {}.", "This work is licensed under {}.", "This file is licensed under {}.", "Released under {}.", "This project is distributed under {}.", "Copyright (c) 2021 The Authors. Licensed under {}.", "The source code is available under {}. See the file for details.", "License: {}",
    "You may use, copy and modify this under {}.", "SPDX-License-Identifier: {}", "{} licensed", "licensed under {} only", "Distributed under the terms of {}.", "This package is {} licensed.",
]
HELD_FRAMES = ["All files here are published under {}.", "Its use is governed by {}.", "This library is licensed under {}, without warranty.", "The code is released under {} or later."]
#: Subjects and verbs of denials, and talk of a name; the last ones of each only calibrate.
SUBJECTS = ["This work", "This file", "The code", "It", "This project", "The library", "Nothing here", "These files", "The package", "All of this"]
DENYING = [
    "is not licensed under", "is not released under", "was never published under", "is no longer distributed under", "isn't licensed under", "are not available under", "cannot be used under", "does not come under", "was not put under the terms of", "is not covered by", "isn't released under", "have not been licensed under",
    "is not under", "are no longer available under", "has never been distributed under", "isn't available under",
]
TALK = [
    "The article explains {} in detail.", "She compared {} with older texts.", "A history of {} was written in 2010, but this work is not licensed.", "Many projects chose {} at that time.", "The talk was about {} and its critics.", "Unlike code under {}, this work is not licensed.", "He wrote a book about {}.",
    "Questions on {} are answered by our lawyers.", "A student asked about {}.", "They read {} twice.", "Some say that {} is too long.", "What is {}?", "The meaning of {} was debated.", "We translated {} into French.", "{} was drafted by a committee.", "Lawyers like {}.", "A course on {} starts in May.",
    "Many people discuss {}, but this work is not licensed.", "The paper cites {} and others.", "Her notes about {} were lost.", "In 1999 {} was revised.",
]
SETTINGS = ["{}", "{} Thank you.", "Copyright (c) 2021 The Authors. {}", "Note: {}"]
HELD_SETTING = "Please read this first. {} See the file for details."
#: Notices that tell no family.
UNTOLD = ["All rights reserved.", "Copyright (c) 2020 The Authors. All rights reserved.", "See the LICENSE file for the license of this project.", "Licensed to you under a separate agreement.", "This software is licensed, not sold."]
LEAST_PROBABILITY = 0.5
LEAST_CONTAINED = 0.6
#: Pull of the weights towards zero, and weights of the kinds of examples.
DECAY = 1e-5
WHOLE_WEIGHT, CORPUS_WEIGHT = 5.0, 500.0
#: Rows whose lines train the class without a licence.
SAMPLE_ROWS = 1_000
#: A word in more than this share of the sampled lines is common; n-grams of common words only have no weight.
COMMON_SHARE = 0.01
#: Lines on both sides of a telling one that are scored.
REACH = 8
#: How far another licence's score may be above that of a run's class on its first and last line.
SLACK = 1.0
TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"


@dataclass(frozen=True)
class LicenseModel:
    classes: list[str]  # the families, then unknown and none
    grams: dict[str, list[float]]  # weights of each class; as many as the fixed notices have
    bias: list[float]
    evidence: list[str]


def tokens_of(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


def grams_of(text: str) -> set[str]:
    words = tokens_of(text)
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def core(name: str) -> str:
    """A name without the words that lead up to it."""
    return re.sub(r"^(the terms of )?(the |an? )?", "", name)


@lru_cache(maxsize=1)
def confirmations() -> list[tuple[str, frozenset[str], float]]:
    """(family, n-grams, share of them that must be found): most of a template, or the whole of a name."""
    return [(f, frozenset(grams_of(t)), LEAST_CONTAINED) for f, t in TEMPLATES] + [(f, frozenset(grams_of(core(n))), 1.0) for f, names in NAMES.items() for n in names]


MOST_WORDS = max(len(tokens_of(t)) for _, t in TEMPLATES) - 1


def examples(held: bool) -> list[tuple[str, int, set[str]]]:
    """(class, kind, n-grams) of the fixed sentences: those to train on, or those left out; kind 0 is made of names, 1 stands whole."""
    frames, settings = (HELD_FRAMES, [HELD_SETTING]) if held else (FRAMES, SETTINGS)
    part = lambda texts: texts[-4:] if held else texts[:-4]
    denials = [f"{subject} {verb} {{}}." for i, subject in enumerate(part(SUBJECTS)) for k, verb in enumerate(part(DENYING)) if (i + k) % 3 == 0]
    every = [(family, n) for family, names in NAMES.items() for n in names] + [(UNKNOWN, n) for n in OTHER_NAMES]
    rows = [(family, 0, frame.format(name)) for family, name in every for frame in frames]
    rows += [(family, 1, setting.format(text)) for family, text in TEMPLATES for setting in settings]
    rows += [(UNKNOWN, 1, setting.format(text)) for text in UNTOLD for setting in settings]
    rows += [(NONE, 0, frame.format(name)) for _, name in every for frame in (*denials, *part(TALK))]
    rows += [(NONE, 1, setting.format(text)) for i, text in enumerate(LOOKALIKES) if (i % 4 == 3) == held for setting in SETTINGS]
    return [(family, kind, grams_of(text)) for family, kind, text in rows]


def _probability(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(lines: Counter, common: set[str], rounds: int = 300) -> LicenseModel:
    """Softmax regression on the fixed sentences and on corpus lines, given as sets of known n-grams and how often each set stands there.

    A quarter of the sets, by their order, only calibrates. Sentences around names weigh 1 each, whole
    ones WHOLE_WEIGHT, and all corpus lines together CORPUS_WEIGHT.
    """
    classes = [*sorted({family for family, _ in TEMPLATES}), UNKNOWN, NONE]
    vocabulary = sorted({g for _, _, grams in examples(held=False) for g in grams if not common.issuperset(g.split(" "))})
    index = {g: i for i, g in enumerate(vocabulary)}
    sets = sorted(lines)

    def matrix(held: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = [(family, [index[g] for g in grams if g in index], 1.0, kind) for family, kind, grams in examples(held)]
        rows += [(NONE, [index[g] for g in grams if g in index], float(lines[grams]), 2) for i, grams in enumerate(sets) if (i % 4 == 3) == held]
        x = np.zeros((len(rows), len(vocabulary)), dtype=np.float32)
        for r, (_, known, _, _) in enumerate(rows):
            x[r, known] = 1
        y, n = np.array([classes.index(r[0]) for r in rows]), np.array([r[2] for r in rows])
        kind = np.array([r[3] for r in rows])
        weight = np.where(kind == 2, n * CORPUS_WEIGHT / max(1.0, n[kind == 2].sum()), np.where(kind == 1, WHOLE_WEIGHT, 1.0))
        return x, y, (weight / weight.sum()).astype(np.float32)

    x, y, weight = matrix(held=False)
    target = np.eye(len(classes), dtype=np.float32)[y]
    w, b = np.zeros((len(vocabulary), len(classes)), dtype=np.float32), np.zeros(len(classes), dtype=np.float32)
    speed, mean = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        grad = (_probability(x @ w + b) - target) * weight[:, None]
        step = x.T @ grad + DECAY * w
        mean, speed = 0.9 * mean + 0.1 * step, 0.99 * speed + 0.01 * step * step
        w -= 0.05 * (mean / (1 - 0.9**k)) / (np.sqrt(speed / (1 - 0.99**k)) + 1e-6)
        b -= grad.sum(0)

    x, y, weight = matrix(held=True)
    logits = (x @ w + b).astype(np.float64)
    eye = np.eye(len(classes))
    at = lambda heat, u, n: logits / heat + u * eye[-2] + n * eye[-1]
    loss = lambda c: float(-(np.log(_probability(at(*c))[np.arange(len(y)), y] + 1e-12) * weight).sum())
    heat, unknown, none = min(((h, u, n) for h in np.geomspace(0.3, 4, 12) for u in np.linspace(-2, 2, 9) for n in np.linspace(-2, 2, 9)), key=loss)
    w, b = w / heat, b / heat + unknown * eye[-2] + none * eye[-1]
    # Words that raise a licence over none; a line without any of them, and none near, has nothing to tell.
    telling = {g for g, i in index.items() if (w[i, :-1] > w[i, -1]).any()}
    evidence = sorted({word for g in telling if " " not in g for word in g.split(" ")})
    return LicenseModel(classes, {g: [float(v) for v in w[i]] for g, i in index.items()}, [float(v) for v in b], evidence)


def _once(array: Column, use) -> Column:
    """`use(array)`, the array evaluated once."""
    return F.get(F.transform(F.array(array), use), F.lit(0))


def lines_of(text: Column) -> Column:
    """struct(words, open) of each \\n-split line that has tokens, in order; an open one does not end a sentence."""
    words = lambda line: F.regexp_extract_all(line, F.lit(f"({TOKEN})"), F.lit(1))
    return F.filter(F.transform(F.split(F.lower(text), "\n+"), lambda line: F.struct(words(line).alias("words"), (~line.rlike(r"[.:;!?][^a-z0-9]*$")).alias("open"))), lambda x: F.size(x["words"]) > 0)


def gram_array(words: Column, before: Column | None = None) -> Column:
    """Distinct 1-, 2- and 3-grams that end in `words`; they may begin in the words `before`."""
    both = F.concat(before, words) if before is not None else words
    first = F.size(before) if before is not None else F.lit(0)

    def run(every: Column, n: int) -> Column:
        begin = F.greatest(F.lit(1), first + 2 - n)
        joined = lambda i: F.array_join(F.slice(every, i, n), " ")
        return F.when(F.size(every) >= begin + n - 1, F.transform(F.sequence(begin, F.size(every) - (n - 1)), joined)).otherwise(F.array().cast("array<string>"))

    return _once(both, lambda every: F.array_distinct(F.concat(run(every, 1), run(every, 2), run(every, 3))))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> LicenseModel:
    """Train with every line of about `sample_rows` whole texts of the corpus (never over twice as many).

    The lines stay on the executors: the driver gets the counts of the words that the fixed sentences
    have, and the different sets of their n-grams in lines that name no licence.
    """
    spark = docs.sparkSession
    rows = hash_sample(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), "doc_id", sample_rows, 9).filter("text is not null")
    lines = rows.select(F.explode(lines_of(F.col("text"))).alias("x")).select(F.monotonically_increasing_id().alias("line"), gram_array(F.col("x.words")).alias("grams"))
    known = sorted({g for _, _, grams in examples(held=False) for g in grams})
    found = lines.select("line", F.explode("grams").alias("gram")).join(F.broadcast(spark.createDataFrame([(g,) for g in known], "gram string")), "gram")
    counts = {r["gram"]: r["n"] for r in found.filter(~F.col("gram").contains(" ")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = lines.count()
    common = {w for w, n in counts.items() if n > COMMON_SHARE * total and n > 1}
    words = F.array(*[F.lit(w) for w in sorted(common)]).cast("array<string>")
    rare = found.filter(F.size(F.array_except(F.split("gram", " "), words)) > 0)
    names = F.array(*[F.lit(g) for g in sorted({" ".join(tokens_of(core(n))[:3]) for names in (*NAMES.values(), OTHER_NAMES) for n in names if len(tokens_of(core(n))) > 1 or re.search(r"[-.0-9]", n)})])
    sets = rare.groupBy("line").agg(F.array_sort(F.collect_set("gram")).alias("grams")).filter(~F.arrays_overlap("grams", names)).groupBy("grams").agg(F.count(F.lit(1)).alias("n")).collect()
    lines_with = Counter({tuple(r["grams"]): r["n"] for r in sets})
    lines_with[()] += max(1, total - sum(lines_with.values()))
    return train(lines_with, common)


def line_scores(rows: DataFrame, model: LicenseModel) -> DataFrame:
    """row_no, doc, line, n, open, z, ids of the lines of `rows` (row_no, doc, text) near a telling one: words, scores by class, and the known n-grams by number."""
    spark = rows.sparkSession
    evidence = F.array(*[F.lit(word) for word in model.evidence]).cast("array<string>")
    # Evidence words by their first part, as a whole text is cut at every other sign here.
    parts = F.array(*[F.lit(part) for part in sorted({re.split("[^a-z0-9]", word)[0] for word in model.evidence})]).cast("array<string>")

    def near(every: Column) -> Column:
        told = F.transform(every, lambda x: F.arrays_overlap(x["words"], evidence))
        head = lambda i: F.when(i > 0, F.slice(F.get(every, i - 1)["words"], F.greatest(F.lit(-2), -F.size(F.get(every, i - 1)["words"])), F.lit(2))).otherwise(F.array().cast("array<string>"))
        line = lambda t: F.transform(every, lambda x, i: F.when(F.exists(F.slice(t, F.greatest(F.lit(1), i + 1 - REACH), F.lit(2 * REACH + 1)), lambda told: told), F.struct(i.alias("line"), x["words"].alias("words"), x["open"].alias("open"), head(i).alias("before"))))
        return F.filter(_once(told, line), lambda x: x.isNotNull())

    lines = rows.filter(F.arrays_overlap(F.split(F.lower("text"), "[^a-z0-9]+"), parts)).select("row_no", "doc", F.inline(_once(lines_of(F.col("text")), near)))
    numbers = {g: i for i, g in enumerate(sorted({*model.grams, *(g for _, grams, _ in confirmations() for g in grams)}))}
    zero = [0.0] * len(model.classes)
    weights = spark.createDataFrame([(g, i, model.grams.get(g, zero)) for g, i in numbers.items()], "gram string, id int, weight array<double>")
    grams = lines.select("row_no", "doc", "line", F.size("words").alias("n"), "open", F.explode(gram_array(F.col("words"), F.col("before"))).alias("gram")).join(F.broadcast(weights), "gram")
    sums = F.array(*[F.sum(F.get("weight", F.lit(k))) for k in range(len(model.classes))])
    return grams.groupBy("row_no", "doc", "line", "n", "open").agg(sums.alias("z"), F.array_sort(F.collect_set("id")).alias("ids"))


def best_runs(lines: DataFrame, model: LicenseModel) -> DataFrame:
    """row_no, doc, first, last, family, p, contained, confirmed of the clearest run that starts on each line, where it gives a licence.

    A run goes on while the lines after its first hold fewer words than the longest template; the clearest
    is the one whose best class is furthest above its second (ties: the shortest). Its first and its last
    line must be its class's own: no other licence is more than SLACK above it there.
    A run gives no licence if the line before, where that leaves its sentence open, turns it to none.
    """
    n = len(model.classes)
    ahead = Window.partitionBy("row_no").orderBy("line").rangeBetween(0, MOST_WORDS)
    before = F.lag(F.struct("line", "open", "z")).over(Window.partitionBy("row_no").orderBy("line"))
    runs = lines.select("row_no", "doc", F.col("line").alias("first"), F.collect_list(F.struct("line", "n", "z", "ids")).over(ahead).alias("run"), before.alias("before"))
    bias = F.array(*[F.lit(b) for b in model.bias])
    margin = lambda z: _once(F.sort_array(z, asc=False), lambda o: F.get(o, F.lit(0)) - F.get(o, F.lit(1)))
    start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("k"), bias.alias("z"), F.lit(-1.0).alias("margin"), F.lit(0).alias("best"), bias.alias("best_z"))

    def step(a: Column, x: Column) -> Column:
        def longer(z: Column) -> Column:
            k = (F.array_position(z, F.array_max(z)) - 1).cast("int")
            own = lambda line: F.get(line, k) >= F.array_max(F.slice(line, 1, n - 1)) - SLACK
            clear = (margin(z) > a["margin"]) & ((k == n - 1) | (own(x["z"]) & own(F.get("run", F.lit(0))["z"])))
            words = a["words"] + F.when(a["k"] > 0, x["n"]).otherwise(0)
            return F.struct(words.alias("words"), (a["k"] + 1).alias("k"), z.alias("z"), F.when(clear, margin(z)).otherwise(a["margin"]).alias("margin"), F.when(clear, a["k"] + 1).otherwise(a["best"]).alias("best"), F.when(clear, z).otherwise(a["best_z"]).alias("best_z"))

        return F.when((a["k"] == 0) | (a["words"] < MOST_WORDS), _once(F.zip_with(a["z"], x["z"], lambda u, v: u + v), longer)).otherwise(a)

    runs = runs.withColumn("s", F.aggregate("run", start, step, lambda a: F.struct(a["best"].alias("k"), a["best_z"].alias("z"))))
    top = F.array_max("s.z")
    p = 1 / F.aggregate("s.z", F.lit(0.0), lambda t, v: t + F.exp(v - top))
    names = F.array(*[F.lit(c) for c in model.classes])
    runs = runs.select("row_no", "doc", "first", F.slice("run", F.lit(1), F.col("s.k")).alias("run"), "before", F.col("s.z").alias("z"), F.get(names, (F.array_position("s.z", top) - 1).cast("int")).alias("family"), p.alias("p"))
    runs = runs.filter((F.col("p") >= LEAST_PROBABILITY) & (F.col("family") != NONE))
    led = F.col("before.open") & (F.col("before.line") == F.col("first") - 1)
    denied = _once(F.zip_with("z", "before.z", lambda u, v: u + v), lambda z: F.get(z, F.lit(n - 1)) >= F.array_max(z))
    runs = runs.filter(~F.coalesce(led & denied, F.lit(False)))
    numbers = {g: i for i, g in enumerate(sorted({*model.grams, *(g for _, grams, _ in confirmations() for g in grams)}))}
    forms = runs.sparkSession.createDataFrame([(f, sorted(numbers[g] for g in grams), least) for f, grams, least in confirmations()], "family string, ids array<int>, least double").groupBy("family").agg(F.collect_list(F.struct("ids", "least")).alias("forms"))
    held = F.array_distinct(F.flatten(F.transform("run", lambda x: x["ids"])))
    told = runs.withColumn("held", held).join(F.broadcast(forms), "family", "left")
    # A whole name confirms as surely as the least of a template does.
    share = lambda f: F.size(F.array_intersect(f["ids"], F.col("held"))) / F.size(f["ids"])
    shares = F.transform("forms", lambda f: F.when((f["least"] < 1.0) | (share(f) == 1.0), F.when(f["least"] < 1.0, share(f)).otherwise(F.lit(LEAST_CONTAINED))).otherwise(F.lit(0.0)))
    told = told.withColumn("contained", F.coalesce(F.array_max(shares), F.lit(0.0)))
    last = F.get("run", F.size("run") - 1)["line"]
    return told.select("row_no", "doc", "first", last.alias("last"), "family", "p", "contained", (F.col("contained") >= LEAST_CONTAINED).alias("confirmed"))


def scan_licenses(docs: DataFrame, model: LicenseModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, license, score, licenses, n_confirmed, n_unconfirmed.

    Paragraphs are runs of neighbouring \\n-split lines of whole texts. `license` is the confirmed family
    with the highest probability (ties: first by name), `score` that probability, `licenses` all
    confirmed families, sorted and comma-joined. A confirmed run gives way to one of another family that
    shares lines with it and holds more of its template (ties: the surer, then the earlier, then the first
    by name), unless it holds a whole template. n_confirmed counts the notices: runs of one family that
    share lines are one. n_unconfirmed counts in the same way the runs that give a licence which is not
    confirmed or of no known family, and that share no line with a confirmed one; where there is nothing
    else, `license` is `unknown`. Without any, `license` is null and the score 0. A null or empty text has
    none. Null and repeated ids pass through; other columns are not read. Weights and templates are
    broadcast: as many as the fixed notices have, whatever the corpus. A document's lines meet in one
    task, its n-grams do not; work and memory grow with its lines.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("doc", F.xxhash64("text"))
    runs = best_runs(line_scores(rows.select(F.monotonically_increasing_id().alias("row_no"), "doc", "text"), model), model)
    around = Window.partitionBy("row_no").orderBy("first").rangeBetween(-MOST_WORDS - REACH, MOST_WORDS + REACH)
    sure = F.when(F.col("confirmed"), F.struct((-F.col("contained")).alias("less"), (-F.col("p")).alias("less_p"), "first", "family", "last"))
    met = runs.withColumn("others", F.collect_list(sure).over(around))
    meets = lambda k: (k["first"] <= F.col("last")) & (k["last"] >= F.col("first"))
    own = F.struct((-F.col("contained")).alias("less"), (-F.col("p")).alias("less_p"), "first", "family", "last")
    beaten = F.exists("others", lambda k: meets(k) & (k["family"] != F.col("family")) & (k < own)) & (F.col("contained") < 1)
    covered = F.exists("others", meets)
    kind = F.when(F.col("confirmed") & ~beaten, F.col("family")).when(~F.col("confirmed") & ~covered, F.lit("?"))
    kept = met.select("row_no", "doc", "first", "last", "p", kind.alias("kind")).filter("kind is not null")
    # Runs of a kind that share lines are one notice.
    before = Window.partitionBy("row_no", "kind").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    islands = kept.withColumn("new", F.coalesce(F.col("first") > F.max("last").over(before), F.lit(True)))
    best = F.min(F.when(F.col("kind") != "?", F.struct((-F.col("p")).alias("less_p"), F.col("kind").alias("family"))))
    per = islands.groupBy("row_no", "doc").agg(best.alias("best"), F.array_sort(F.collect_set(F.when(F.col("kind") != "?", F.col("kind")))).alias("families"), F.count_if(F.col("new") & (F.col("kind") != "?")).alias("n_confirmed"), F.count_if(F.col("new") & (F.col("kind") == "?")).alias("n_unconfirmed"))
    per = per.groupBy("doc").agg(F.min(F.struct("best", "families", "n_confirmed", "n_unconfirmed")).alias("r")).select(F.col("doc").alias("found"), "r.*")
    joined = rows.select("doc_id", "doc").join(per, F.col("doc") == F.col("found"), "left")
    return joined.select(
        "doc_id",
        F.coalesce("best.family", F.when(F.col("n_unconfirmed") > 0, F.lit(UNKNOWN))).alias("license"),
        F.coalesce(-F.col("best.less_p"), F.lit(0.0)).alias("score"),
        F.coalesce(F.array_join("families", ","), F.lit("")).alias("licenses"),
        F.coalesce("n_confirmed", F.lit(0)).cast("long").alias("n_confirmed"),
        F.coalesce("n_unconfirmed", F.lit(0)).cast("long").alias("n_unconfirmed"),
    )
