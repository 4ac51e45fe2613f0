import math
import re
import textwrap

import pytest

from tracelake.llm import license_scan

GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"


def test_wrapped_headers_are_told(spark, documents):
    model = license_scan.fit(documents)
    rows, want = [], {}
    for family, notice in (("gpl-3.0", GPL), ("bsd", BSD), ("mit", MIT)):
        for width in (30, 50, 76):
            for sign in ("", "# ", " * "):
                i = len(rows)
                lines = "\n".join(sign + line for line in textwrap.wrap(notice, width))
                rows.append((i, f"first words of a file\n{lines}\nimport something\nand more"))
                want[i] = (family, family, 1)
    rows.append((100, "Released under the MIT\nLicense.\nLicensed under CC BY-NC 4.0."))
    rows += [(101, "Released under the MIT License.")] * 3
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert {r["doc_id"]: (r["license"], r["licenses"], r["n_confirmed"]) for r in got if r["doc_id"] < 100} == want
    assert {r["licenses"] for r in got if r["doc_id"] == 100} == {"cc-by-nc-4.0,mit"}
    assert sum(r["doc_id"] == 101 and r["license"] == "mit" and r["n_confirmed"] == 1 for r in got) == 3


#: Wordings that stand neither in the training notices nor in the calibration, and what they are.
UNSEEN = [
    ("apache-2.0", "You can use this package under the terms of the Apache License, Version 2.0."),
    ("mit", "Everything in this folder falls under the MIT License."),
    ("gpl-2.0", "Whatever you find in here is licensed under the GNU General Public License, version 2 as it stands."),
    ("cc-by-4.0", "Our photographs were put online and are licensed under a Creative Commons Attribution 4.0 International License."),
    ("mpl-2.0", "Each module is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("bsd", "It was released under the BSD License in June."),
    (None, "Her fishing license ran out last week."),
    (None, "The committee met again on the third floor."),
    (None, "The public may inspect the general ledger."),
]


def slow_scan(model, text):
    """License, score, licenses, n_confirmed, n_unconfirmed of one text, every run of lines that starts on a line scored."""
    raw = [line for line in (text or "").split("\n") if license_scan.tokens_of(line)]
    lines, open_ = [license_scan.tokens_of(line) for line in raw], [not re.search(r"[.:;!?][^a-z0-9]*$", line.lower()) for line in raw]
    known = {*model.grams, *(g for _, grams, _ in license_scan.confirmations() for g in grams)}
    telling = [any(w in model.evidence for w in line) for line in lines]
    classes, reach, least = model.classes, license_scan.REACH, license_scan.LEAST_PROBABILITY
    scored = []
    for i, words in enumerate(lines):
        if any(telling[max(0, i - reach) : i + reach + 1]):
            before = lines[i - 1][-2:] if i else []
            both = before + words
            grams = {" ".join(both[e - n : e]) for n in (1, 2, 3) for e in range(len(before) + 1, len(both) + 1) if e >= n} & known
            if grams:
                scored.append((i, len(words), [sum(model.grams[g][k] for g in grams if g in model.grams) for k in range(len(classes))], grams))
    runs = []
    for at, first in enumerate(scored):
        z, words, best = list(model.bias), 0, (-1.0, list(model.bias), 0)
        for k, line in enumerate(x for x in scored[at:] if x[0] <= first[0] + license_scan.MOST_WORDS):
            if k and words >= license_scan.MOST_WORDS:
                break
            words += line[1] if k else 0
            z = [a + b for a, b in zip(z, line[2], strict=True)]
            top = sorted(z, reverse=True)
            c = z.index(top[0])
            own = classes[c] == "none" or all(x[2][c] >= max(x[2][:-1]) - license_scan.SLACK for x in (first, line))
            if own and top[0] - top[1] > best[0]:
                best = (top[0] - top[1], z, k + 1)
        z, run = best[1], scored[at : at + best[2]]
        family, p = classes[z.index(max(z))], 1 / sum(math.exp(v - max(z)) for v in z)
        if p < least or family == "none":
            continue
        if at and scored[at - 1][0] == first[0] - 1 and open_[first[0] - 1]:
            led = [a + b for a, b in zip(z, scored[at - 1][2], strict=True)]
            if led[-1] >= max(led):
                continue
        held = set().union(*(x[3] for x in run))
        shares = [(len(grams & held) / len(grams), part) for f, grams, part in license_scan.confirmations() if f == family]
        contained = max([s if part < 1 else license_scan.LEAST_CONTAINED * (s == 1) for s, part in shares], default=0)
        runs.append((-contained, -p, run[0][0], family, run[-1][0]))
    sure = [r for r in runs if -r[0] >= license_scan.LEAST_CONTAINED]
    meets = lambda r, k: k[2] <= r[4] and k[4] >= r[2]
    kept = [r for r in sure if r[0] == -1 or not any(meets(r, k) and k[3] != r[3] and k < r for k in sure)]
    free = [r for r in runs if r not in sure and not any(meets(r, k) for k in sure)]

    def islands(found):
        count, last = 0, -1
        for r in sorted(found, key=lambda r: (r[2], r[4])):
            count += r[2] > last
            last = max(last, r[4])
        return count

    best = min(((k[1], k[3]) for k in kept), default=(0.0, "unknown" if free else None))
    return best[1], -best[0], ",".join(sorted({k[3] for k in kept})), sum(islands([k for k in kept if k[3] == f]) for f in {k[3] for k in kept}), islands(free)


def test_scan_as_a_slow_one(spark, documents):
    model = license_scan.fit(documents)
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    rows += [(10_000 + i, f"Plain words before.\n{text}\nPlain words after.") for i, (_, text) in enumerate(UNSEEN)]
    rows += [(20_000 + i, "\n".join(textwrap.wrap(f"Some words. {a} {b}", width))) for i, (a, b, width) in enumerate([(GPL, MIT, 40), (BSD, "Licensed under CC BY-NC 4.0.", 25), ("All rights reserved.", MIT, 60)])]
    got = {r["doc_id"]: tuple(r)[1:] for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, text in rows:
        want = slow_scan(model, text)
        assert (got[i][0], *got[i][2:]) == (want[0], *want[2:]), (i, got[i], want)
        assert got[i][1] == pytest.approx(want[1], abs=1e-6)
    assert [got[10_000 + i][0] for i in range(len(UNSEEN))] == [family for family, _ in UNSEEN]


#: Wordings that neither trained nor calibrated anything.
TEST_FRAMES = ["Use of these sources is licensed under {}.", "The whole archive is distributed under {}.", "You may use the data under {}.", "Our tools are released under {}."]
TEST_DENIALS = ["Our tools are not released under {}.", "The archive isn't distributed under {}.", "A lecture about {} drew many listeners.", "This text is not licensed under {}."]


def test_probabilities_are_calibrated(documents):
    """On wordings that chose neither weights nor levels, the mean probability of the best class is near its accuracy."""
    model = license_scan.fit(documents)
    every = [(f, n) for f, names in license_scan.NAMES.items() for n in names] + [("unknown", n) for n in license_scan.OTHER_NAMES]
    rows = [(f, frame.format(n)) for f, n in every for frame in TEST_FRAMES] + [("none", frame.format(n)) for _, n in every for frame in TEST_DENIALS]
    right, sure = [], []
    for family, text in rows:
        grams = license_scan.grams_of(text)
        z = [b + sum(model.grams[g][k] for g in grams if g in model.grams) for k, b in enumerate(model.bias)]
        right.append(model.classes[z.index(max(z))] == family)
        sure.append(1 / sum(math.exp(v - max(z)) for v in z))
    assert sum(right) / len(right) >= 0.9 and abs(sum(sure) / len(sure) - sum(right) / len(right)) < 0.15


#: Near families, denials, short names, and licences of no known family.
HARD = [
    ("unknown", "This work is licensed under the GNU Affero General Public License, version 3."), (None, "This file is not licensed under the GNU General Public License, version 2."), (None, "This file is not\nlicensed under the GNU General Public License,\nversion 2."),
    (None, "Many people discuss the GNU General Public License, version 3 and its history, but this work is not licensed."), ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"), ("gpl-2.0", "licensed under GPLv2 only"), ("mit", "MIT licensed"),
    ("unknown", "Licensed under the ISC License."), ("unknown", "This is free and unencumbered software released into the public domain under the Unlicense."), ("unknown", "Licensed under CC BY-ND 4.0."), ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    (None, "This software is not released under the MIT license."), ("gpl-3.0", "The source is available under GPL-3.0."), (None, "He studied at MIT."), ("unknown", "All rights reserved."),
]


def test_hard_notices(spark, documents):
    model = license_scan.fit(documents)
    rows = [(i, text) for i, (_, text) in enumerate(HARD)]
    got = {r["doc_id"]: r["license"] for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [got[i] for i in range(len(HARD))] == [family for family, _ in HARD]


def test_a_long_text_full_of_notices(spark, documents):
    """As a slow scan tells it, in seconds: work grows with the lines."""
    import time

    model = license_scan.fit(documents)
    text = "\n".join(HARD[(i * 7) % len(HARD)][1] for i in range(7_000))
    frame = spark.createDataFrame([(1, text), (1, text), (2, "Licensed under CC BY 4.0. Licensed under CC BY-SA 4.0.")], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: tuple(r)[1:] for r in license_scan.scan_licenses(frame, model).collect()}
    assert time.time() - began < 60 and len(text) > 300_000
    for i, t in ((1, text), (2, "Licensed under CC BY 4.0. Licensed under CC BY-SA 4.0.")):
        want = slow_scan(model, t)
        assert (got[i][0], *got[i][2:]) == (want[0], *want[2:])
