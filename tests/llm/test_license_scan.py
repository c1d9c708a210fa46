import random
import re

from sigspark.llm.license_scan import TEMPLATES, license_scan, need, tokens

DOCS = "doc_id long, text string, labels string, score int"


def scan(spark, rows):
    got = license_scan(spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS).repartition(3))
    return {r.doc_id: tuple(r)[1:] for r in got.collect()}


def test_phrases_and_places(spark):
    got = scan(spark, [
        (1, None), (2, ""), (3, "..."),
        (4, "(Apache-LICENSE) x mit\nlicense, xmit license mit licenses"),
        (5, "GNU General Public License"),
        (6, "é apache licenseé apache Kelvin"),
        (7, "cc_by cc by"),
    ])
    assert got[1] == got[2] == got[3] == (0, 0, None, None, "", "", 0.0)
    assert got[4][:5] == (9, 2, 0, 3, "apache,mit")
    assert got[5][:5] == (4, 1, 0, 0, "gpl") and got[5][6] == 1.0
    assert got[6][:5] == (5, 0, None, None, "")
    assert got[7][:5] == (4, 2, 0, 2, "cc-by")


def brute(text):
    """Labels of templates and the best containment, span by span from every word."""
    words = re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found, best = set(), 0.0
    for t in TEMPLATES:
        all_ = re.findall("[0-9a-z]+", t.text.lower())
        own, length = list(dict.fromkeys(all_)), len(all_) + max(2, len(all_) // 8)
        for at, w in enumerate(words):
            x = words[at : at + length]
            shared = len(set(own) & set(x))
            if w not in own or shared < (len(own) if len(own) <= 9 else -(-4 * len(own) // 5)):
                continue
            if len(own) <= 9 and [x.index(w) for w in own] != sorted(x.index(w) for w in own):
                continue
            if set(t.having.split()) <= set(x) and not set(t.lacking.split()) & set(x):
                found.add(t.label)
                best = max(best, shared / len(own))
    return found, best


def test_two_licenses_side_by_side_and_words_out_of_order(spark):
    got = scan(spark, [
        (1, "Licensed under the BSD License. This is free and unencumbered software released into the public domain."),
        (2, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. Licensed under the BSD License."),
        (3, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files. All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited."),
        (4, "the licensed bus under a bsd flag. A dog license is the law"),
        (5, "SPDX-License-Identifier: MPL-2.0"),
        (6, "SPDX-License-Identifier: CC-BY-SA-4.0"),
        (7, "This work is licensed under a Creative Commons Attribution 4.0 International License. This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
        (8, "SPDX-License-Identifier: GPL-2.0-only OR MIT and more. SPDX-License-Identifier: BSD-3-Clause"),
        (9, "under the terms of the GNU Lesser General Public License"),
    ])
    assert {i: r[5] for i, r in got.items()} == {1: "bsd,unlicense", 2: "bsd,isc", 3: "mit,proprietary", 4: "", 5: "mpl", 6: "cc-by,cc-by-sa", 7: "cc-by,cc-by-sa", 8: "bsd,gpl", 9: "lgpl"}


def test_every_template_is_found_anywhere_and_alone(spark):
    rows, labels = [], []
    for k, t in enumerate(TEMPLATES):
        for shift in (0, 31, 32, 63, 200):
            rows.append((len(rows), "foo " * shift + t.text + " bar" * (k * 7)))
            labels.append(t.label)
    got = scan(spark, rows)
    assert all(got[i][5] == ",".join(sorted({label, *got[i][4].split(",")} - {""})) and got[i][6] == 1.0 for i, label in enumerate(labels))
    assert {got[i][4] for i, label in enumerate(labels) if label not in ("gpl", "apache", "mit") and not label.startswith("cc-by")} == {""}
    few = [(i, " ".join(w[: need(len(w)) - 1])) for i, w in enumerate(tokens(t.text) for t in TEMPLATES)]
    got = scan(spark, few)
    assert all(TEMPLATES[i].label not in got[i][5].split(",") or got[i][1] for i, _ in few)


def test_notices_of_like_licenses(spark):
    notices = [
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl"),
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "lgpl"),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.", "agpl"),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
        ("Released under the Apache License.", "apache"),
        ("Licensed under the BSD License, Version 2.0.", "bsd"),
        ("The figures were released under the same license last year.", ""),
        ("Permission to use the hall was granted free of charge to any person.", ""),
    ]
    got = scan(spark, [(i, "word " * 50 + t + " word" * 50) for i, (t, _) in enumerate(notices)])
    assert [got[i][5] for i in range(len(notices))] == [label for _, label in notices]


def test_matches_brute_force(spark):
    rnd, pool = random.Random(3), sorted({w for t in TEMPLATES for w in tokens(t.text)})
    rows = [(0, None), (1, "word " * 20_000 + TEMPLATES[1].text + " word" * 20_000)]
    for i in range(2, 300):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            w = rnd.choice(TEMPLATES).text.split()
            for _ in range(rnd.choice([0, 1, 1, 2, 4])):
                w[rnd.randrange(len(w))] = rnd.choice(pool + ["other"])
            parts += [*rnd.choices(["word", *pool], k=rnd.randint(0, 30)), *w]
        rows.append((i, " ".join(parts)))
    got = scan(spark, rows)
    for i, text in rows:
        found, best = brute(text)
        base = set(got[i][4].split(",")) - {""}
        assert got[i][5] == ",".join(sorted(base | found)) and got[i][6] == max(best, float(got[i][1] > 0)), text


def test_repeated_rows_and_empty_table(spark):
    assert license_scan(spark.createDataFrame([], DOCS)).collect() == []
    rows = spark.createDataFrame([(1, "Released under the MIT License.", "x", 1)] * 3 + [(None, "Released under the MIT License.", "x", 1)], DOCS)
    assert [r.labels for r in license_scan(rows).collect()] == ["mit"] * 4
