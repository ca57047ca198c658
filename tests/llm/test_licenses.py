from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from corpusward.llm import licenses
from tests.llm.helpers import docs

OWN = licenses.scanner(licenses.LEAST_SAVING, licenses.LOOSE, licenses.LEVEL)
CUE = re.compile(licenses.CUE)


def found(text):
    return list(licenses.found_in(text, CUE, OWN))


@pytest.fixture(scope="module")
def filler(spark):
    """Running text without cues."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text is not null")
    texts = (r.text for r in table.select("text").orderBy("doc_id").collect())
    return " ".join(" ".join(text.split()) for text in texts if not CUE.search(text)).split()[:20_000]


@pytest.mark.parametrize("template", licenses.templates(), ids=lambda t: f"{t.license}-{len(t.text)}")
def test_every_wording_is_found_anywhere_in_a_long_line(filler, template):
    for at in (0, 7_001, 20_000):
        for part in (template.text, template.text.upper(), template.text.replace(" ", "\n * ")):
            text = " ".join([*filler[:at], part, *filler[at:]])
            rows = found(text)
            assert [(r[2], r[4], r[5], r[6]) for r in rows] == [(template.license, True, [], [])], (at, part)
            # its lines are those of its first and last word
            assert rows[0][:2] == (0, part.count("\n"))


def test_equals_an_all_positions_comparison(filler):
    rng = random.Random(5)
    wordings = OWN.wordings
    for _ in range(20):
        parts, wanted = [], []
        for _ in range(12):
            parts.append(" ".join(rng.sample(filler, rng.randrange(0, 120))))
            template = rng.choice(wordings)
            parts.append(template.text)
            wanted.append(template.license)
        text = rng.choice(["\n", " ", "\n\n"]).join(parts)
        words = licenses.words(text)
        taken, brute = set(), []
        for i in sorted(range(len(wordings)), key=lambda i: -len(OWN.split[i])):
            n = len(OWN.split[i])
            for p in range(len(words) - n + 1):
                if words[p : p + n] == OWN.split[i] and not taken.intersection(range(p, p + n)):
                    taken.update(range(p, p + n))
                    brute.append((p, wordings[i].license))
        got = [row[2] for row in found(text) if row[4]]
        assert got == [name for _, name in sorted(brute)]
        assert Counter(got) == Counter(wanted)


@pytest.mark.parametrize("text", [
    "Licensed under the Apache License, Version 1.1.", "I lost my driving licence in the public library.",
    "Released under the Emacs License.", "Licensed under CC BY-ND 4.0.",
    "This work is licensed under the GNU General Public License, version 1.",
    "permission to use the kitchen without warranty", "copyright", "... license", "(c) copyright !",
])
def test_close_wordings_are_not_confirmed(text):
    assert [row[4] for row in found(text)] == [False]


def test_whole_notices():
    bsd3 = next(t.text for t in OWN.wordings if t.license == "BSD-3-Clause" and len(t.text) > 300)
    bsd2 = next(t.text for t in OWN.wordings if t.license == "BSD-2-Clause" and len(t.text) > 300)
    end = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\""
    start = "Copyright (c) 2020, A. Person\nAll rights reserved.\n\n"
    lgpl = (
        "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU "
        "Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the "
        "License, or (at your option) any later version.")
    for text, want in ((start + bsd2 + end, ["all-rights-reserved", "BSD-2-Clause"]), (lgpl, ["LGPL-2.1"]),
                       (start + bsd3.replace("the copyright holder nor", "Acme Inc. nor") + end,
                        ["all-rights-reserved", "BSD-3-Clause"])):
        assert [row[2] for row in found(text) if row[4]] == want


def test_giant_words_and_many_cues():
    blob = "x" * 2_000_000
    rows = found(f"{blob} Released under the MIT License. {blob}")
    assert [(r[2], r[4]) for r in rows] == [("MIT", True)]
    rows = found("Released under the MIT License.\n" * 300)
    assert [(r[0], r[2], r[4]) for r in rows] == [(i, "MIT", True) for i in range(300)]


def test_rows(spark):
    mit = licenses.NOTICES["MIT"][1][2]
    rows = [
        (1, "text\nReleased under the MIT License.\nmore"), (2, None), (3, ""), (4, "nothing here"),
        (5, "Licensed under CC BY 4.0.\n\nfoo\n\n\n\n\nLicensed under the Apache License, Version 2.0."),
        (6, mit.replace(" of this software", " of the said software")), (None, "Licensed under CC BY-NC 4.0."),
        (7, "x\n" * 50_000 + "Released under the MIT License."), (7, "Released under the MIT License."),
    ]
    got = licenses.scan(docs(spark, rows, extra=True)).collect()
    assert sorted((str(r.doc_id), r.first_line, r.last_line, r.license, r.confirmed) for r in got) == [
        ("1", 1, 1, "MIT", True), ("5", 0, 0, "CC-BY-4.0", True), ("5", 7, 7, "Apache-2.0", True),
        ("6", 0, 0, "MIT", True), ("7", 0, 0, "MIT", True), ("7", 50_000, 50_000, "MIT", True),
        ("None", 0, 0, "CC-BY-NC-4.0", True),
    ]
    changed = next(r for r in got if r.doc_id == 6)
    assert (changed.missing, sorted(changed.added)) == (["this"], ["said", "the"])
    assert licenses.scan(docs(spark, rows).limit(0)).count() == 0


def test_planted_lines_are_found(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id for r in licenses.scan(table).filter("confirmed").collect()}
    want = {r.doc_id for r in table.filter("text rlike '(?i)licensed under|under the mit|all rights reserved'").collect()}
    assert got == want
