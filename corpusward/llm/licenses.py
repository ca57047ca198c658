"""License scans by conditional compression.

1. *Windows.* Every license cue opens windows of words around it, across line ends, one for each
   length class of templates (4, 8, 16 ... words): a class of ``H`` words looks ``H`` and some slack
   to both sides, so that wherever in a wording the cue stands, the whole wording is inside, and the
   window is never more than a few template lengths. Cues at most ``H`` words after a window's first
   share it. The cue is first tested by Spark's scan, so texts without one stay in the JVM.
2. *Compression.* Every window is compressed on its own and once per template of its class, the
   template being a raw zstandard dictionary. What a template saves, over what the template itself
   compresses to, is the share of its wording that the window repeats. Templates are ranked by it. What lies
   around a short wording takes from that share: over 500 places in running text the least was 0.14
   ("All rights reserved."), so ``least_saving`` only spares wordings that help nothing.
3. *Wording.* From the longest class and best rank downwards, templates above ``least_saving`` are
   aligned word by word with the window. A template is confirmed if no word in ``exact`` (names,
   versions) is missing, no name of another license is added, and no more than ``loose`` of its
   words, rounded down, are missing or added.
   A confirmed template takes its words out of the text, so that several licenses are found, and one
   as often as it stands there, but no word counts twice. Wordings of up to six different words
   consist of little but a name, so all their words are exact.

Rows are confirmed wordings, with the lines of their first and last word. Cues at most ``gap`` lines
apart without any confirmed wording give one row with the best-ranked template and ``confirmed`` false.

Row by row in place, without a shuffle; the templates are a fixed set. Only words near cues are
taken apart, whatever a text's length.

Defined results: a null or empty text has no rows; ties of rank go to the earlier template; rows with
a null or repeated id are scanned like any other; an empty table gives an empty result; columns other
than id and text are not read, whatever their names. Words of more than ``LONGEST`` characters, which
no template has, are shortened for the ranking.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_SAVING = 0.05
LOOSE = 0.1
GAP = 2
LEVEL = 15
# a gap may hold a line end and a comment sign
CUE = (
    r"(?i)licen[cs]|lizenz|copyright|creative commons|\bcc (by|0)|public domain|spdx"
    r"|permission is hereby|permission to use|redistribution and use|without warranty|all rights reserved"
).replace(" ", "[^a-z0-9]{1,8}")
LONGEST = 64
_WORD = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*")
_SPAN = re.compile(r"[A-Za-z0-9]+(?:[.+-][A-Za-z0-9]+)*")
RESULT = (
    "first_line BIGINT, last_line BIGINT, license STRING, saving DOUBLE, confirmed BOOLEAN, "
    "missing ARRAY<STRING>, added ARRAY<STRING>"
)


@dataclass(frozen=True)
class Template:
    """One wording of a license; ``exact`` are the words that may not differ."""

    license: str
    text: str
    exact: frozenset[str]


# License identifiers and the public wordings that name or grant them.
NOTICES = {
    "MIT": ("MIT License", [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "and associated documentation files, to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software.",
    ]),
    "Apache-2.0": ("Apache License 2.0", [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at",
    ]),
    "GPL-2.0": ("GNU General Public License 2", [
        "This work is licensed under the GNU General Public License, version 2.",
        "under the terms of the GNU General Public License as published by the Free Software "
        "Foundation; either version 2 of the License",
    ]),
    "GPL-3.0": ("GNU General Public License 3", [
        "This work is licensed under the GNU General Public License, version 3.",
        "under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License",
    ]),
    "LGPL-2.1": ("GNU Lesser General Public License 2.1", [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software "
        "Foundation; either version 2.1 of the License",
    ]),
    "LGPL-3.0": ("GNU Lesser General Public License 3", [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software "
        "Foundation, either version 3 of the License",
    ]),
    "AGPL-3.0": ("GNU Affero General Public License 3", [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software "
        "Foundation, either version 3 of the License",
    ]),
    "MPL-2.0": ("Mozilla Public License 2.0", [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ]),
    "BSD-2-Clause": ("BSD 2-Clause", [
        "Released under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: 1. Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. 2. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
        "and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution.",
    ]),
    "BSD-3-Clause": ("BSD 3-Clause", [
        "Released under the BSD 3-Clause License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: 1. Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. 2. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
        "and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. 3. Neither the name of the copyright holder nor the names of its contributors "
        "may be used to endorse or promote products derived from this software without specific prior "
        "written permission.",
    ]),
    "ISC": ("ISC", [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies",
    ]),
    "BSL-1.0": ("Boost 1.0", ["Distributed under the Boost Software License, Version 1.0."]),
    "CC-BY-4.0": ("CC BY 4.0", [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ]),
    "CC-BY-SA-4.0": ("CC BY-SA ShareAlike 4.0", [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ]),
    "CC-BY-NC-4.0": ("CC BY-NC NonCommercial 4.0", [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ]),
    "CC0-1.0": ("CC0 1.0", [
        "Dedicated to the public domain under CC0 1.0 Universal.",
    ]),
    "Unlicense": ("public domain", [
        "This is free and unencumbered software released into the public domain.",
    ]),
    "all-rights-reserved": ("all rights reserved", ["All rights reserved."]),
}


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def plain(found: list[str]) -> bytes:
    """What is compressed: words with one blank between them, so that no decoration counts."""
    return " ".join(w[:LONGEST] for w in found).encode()


def names() -> set[str]:
    """Words that tell licenses apart: none may be added to another license's wording."""
    common = {"license", "public", "general", "domain", "all", "rights", "reserved"}
    return {w for title, _ in NOTICES.values() for w in words(title) if not w[0].isdigit()} - common


def templates() -> list[Template]:
    out = []
    for name, (title, wordings) in NOTICES.items():
        firm = set(words(title)) | {p for w in words(title) for p in w.split("-")}
        known = {"by", "by-sa", "by-nc", "attribution-sharealike", "attribution-noncommercial",
                 "attribution"}
        for text in [*wordings, f"SPDX-License-Identifier: {name}"]:
            own = set(words(text))
            short = own if len(own) <= 6 else own & (firm | known | set(words(name)))
            out.append(Template(name, text, frozenset(short)))
    return out


class Scanner:
    """Ranks and confirms templates for the windows of a text."""

    def __init__(self, wordings: list[Template], least_saving: float, loose: float, level: int) -> None:
        self.wordings, self.least, self.loose = wordings, least_saving, loose
        options = {"level": level, "write_content_size": False, "write_checksum": False}
        self.alone = zstandard.ZstdCompressor(**options)
        self.primed = [
            zstandard.ZstdCompressor(
                dict_data=zstandard.ZstdCompressionDict(
                    plain(words(t.text)), dict_type=zstandard.DICT_TYPE_RAWCONTENT
                ),
                write_dict_id=False, **options,
            )
            for t in wordings
        ]
        self.own = [len(self.alone.compress(plain(words(t.text)))) for t in wordings]
        self.split = [words(t.text) for t in wordings]
        self.foreign = [names().difference(split) for split in self.split]
        self.classes: dict[int, list[int]] = {}
        for i, wanted in enumerate(self.split):
            self.classes.setdefault(max(4, 1 << (len(wanted) - 1).bit_length()), []).append(i)
        self.reach = max(self.classes) * 5 // 4 + 2

    def ranked(self, window: list[str], size: int) -> list[tuple[float, int]]:
        """``(saving, template)`` of the class's templates, best first; ties to the earlier one."""
        data = plain(window)
        alone = len(self.alone.compress(data))
        savings = [((alone - len(self.primed[i].compress(data))) / self.own[i], -i) for i in self.classes[size]]
        return [(saving, -i) for saving, i in sorted(savings, reverse=True)]

    def aligned(self, found: list[str | None], i: int) -> tuple[list[str], list[str], list[int]]:
        """Least differing place of a template: words missing, words added, places taken."""
        wanted, exact = self.split[i], self.wordings[i].exact
        order = sorted(range(len(wanted)), key=lambda k: (wanted[k] not in exact, -len(wanted[k]), k))
        anchors = {wanted[k]: k for k in reversed(order[:3])}
        slack = max(2, len(wanted) // 5)
        best, seen = None, set()
        for low in sorted({p - anchors[word] for p, word in enumerate(found) if word in anchors}):
            start = max(0, low - slack)
            if start in seen:
                continue
            seen.add(start)
            part = found[start : max(0, low) + len(wanted) + slack]
            blocks = SequenceMatcher(None, wanted, part, autojunk=False).get_matching_blocks()[:-1]
            hit = {m.a + k for m in blocks for k in range(m.size)}
            missing = [w for k, w in enumerate(wanted) if k not in hit]
            taken = [start + m.b + k for m in blocks for k in range(m.size)]
            inside = [w for w in found[taken[0] : taken[-1] + 1] if w] if taken else []
            added = inside[:]
            for k in hit:
                if wanted[k] in added:
                    added.remove(wanted[k])
            if best is None or len(missing) + len(added) < len(best[0]) + len(best[1]):
                best = missing, added, taken
        return best or (wanted, [], [])

    def confirmed(self, i: int, missing: list[str], added: list[str]) -> bool:
        allowed = int(self.loose * len(self.split[i]))
        firm = self.wordings[i].exact.intersection(missing) or self.foreign[i].intersection(added)
        return not firm and len(missing) + len(added) <= allowed

    def windows(self, n: int, cues: list[int]) -> Iterator[tuple[int, int, int]]:
        """``(class, first word, word after the last)``, longest class first."""
        for size in sorted(self.classes, reverse=True):
            side, last = size + size // 4 + 2, None
            for at, cue in enumerate(cues):
                if last is not None and cue - last <= size:
                    continue
                last = cue
                shared = cues[bisect_left(cues, cue + size + 1, at) - 1]
                yield size, max(0, cue - side), min(n, shared + side + 1)

    def scan(self, text: str, spans: list[tuple[int, int]], cues: list[int]) -> tuple[list[tuple], list[tuple]]:
        """Of a stretch of text with word ``spans`` and the words at which cues start:
        confirmed ``(first word, last word, template, saving, missing, added)``, and all windows'
        best ``(saving, template, first word, word after the last)``.
        """
        read = [text[a:b].lower() for a, b in spans]
        found: list[str | None] = read[:]
        out, best, candidates = [], [], []
        for size, first, end in self.windows(len(spans), cues):
            ranks = self.ranked(read[first:end], size)
            best.append((*ranks[0], first, end))
            candidates += [(-size, -saving, i, first, end) for saving, i in ranks if saving >= self.least]
        for _, saving, i, first, end in sorted(candidates):
            while True:
                missing, added, taken = self.aligned(found[first:end], i)
                if not taken or not self.confirmed(i, missing, added):
                    break
                out.append((first + taken[0], first + taken[-1], i, -saving, missing, added))
                for place in taken:
                    found[first + place] = None
        return out, best


@lru_cache(maxsize=2)
def scanner(least_saving: float, loose: float, level: int) -> Scanner:
    return Scanner(templates(), least_saving, loose, level)


def stretches(text: str, cue: re.Pattern, reach: int) -> Iterator[tuple[list[tuple[int, int]], list[int]]]:
    """``(spans, cues)`` of parts of the text that no window leaves: the words' places, and the
    word at which each cue starts. ``reach`` words are looked at on both sides of a cue.
    """
    places = [m.start() for m in cue.finditer(text)]
    floor, k = 0, 0
    while k < len(places):
        size = 16 * reach
        while True:  # the words before the cue
            start = max(floor, places[k] - size)
            spans = [m.span() for m in _SPAN.finditer(text, start, places[k])]
            if len(spans) > reach or start == floor:
                break
            size *= 2
        begin = places[k]
        if spans and text[spans[-1][1] : begin] in ("", ".", "+", "-"):  # a cue within a word
            begin = spans.pop()[0]
        spans, cues, after = spans[-reach:], [], 0
        for m in _SPAN.finditer(text, begin):
            while k < len(places) and places[k] < m.end():
                cues.append(len(spans))
                k, after = k + 1, 0
            spans.append(m.span())
            after += 1
            if after > reach:
                break
        else:
            # cues behind the last word
            while k < len(places):
                cues.append(max(0, len(spans) - 1))
                k += 1
        floor = spans[-1][1] if spans else len(text)
        if spans:
            yield spans, cues


def found_in(text: str, cue: re.Pattern, own: Scanner, gap: int = GAP) -> Iterator[tuple]:
    """``(first_line, last_line, license, saving, confirmed, missing, added)``, lines from 0."""
    line, seen = 0, 0

    def line_of(place: int) -> int:
        nonlocal line, seen
        if place < seen:
            return line - text.count("\n", place, seen)
        line, seen = line + text.count("\n", seen, place), place
        return line

    for spans, cues in stretches(text, cue, own.reach):
        sure, best = own.scan(text, spans, cues)
        rows = [(line_of(spans[a][0]), line_of(spans[b][0]), *row) for a, b, *row in sorted(sure, key=lambda r: r[:3])]
        for first, last, i, saving, missing, added in rows:
            yield first, last, own.wordings[i].license, saving, True, missing, added
        lines = [line_of(spans[c][0]) for c in cues]
        start = 0
        for k in range(1, len(cues) + 1):
            if k < len(cues) and lines[k] - lines[k - 1] <= gap + 1:
                continue
            low, high = lines[start], lines[k - 1]
            if not any(a <= high and low <= b for a, b, *_ in rows):
                near = [b for b in best if b[2] <= cues[k - 1] and cues[start] < b[3]]
                saving, i, a, b = max(near, key=lambda r: (r[0], -r[1], -r[2]))
                words_there = [text[x:y].lower() for x, y in spans[a:b]]
                yield low, high, own.wordings[i].license, saving, False, *own.aligned(words_there, i)[:2]
            start = k


def scan(
    docs: DataFrame, key: str = "doc_id", body: str = "text", least_saving: float = LEAST_SAVING,
    loose: float = LOOSE, gap: int = GAP, level: int = LEVEL,
) -> DataFrame:
    """``(key, first_line, last_line, license, saving, confirmed, missing, added)``."""
    cue = re.compile(CUE)
    schema = pa.schema([
        ("first_line", pa.int64()), ("last_line", pa.int64()), ("license", pa.string()),
        ("saving", pa.float64()), ("confirmed", pa.bool_()), ("missing", pa.list_(pa.string())),
        ("added", pa.list_(pa.string())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(least_saving, loose, level)
        for batch in batches:
            ids, out = [], []
            for i, text in enumerate(batch.column(1)):
                for row in found_in(text.as_py(), cue, own, gap):
                    ids.append(i)
                    out.append(row)
            columns = list(zip(*out, strict=True)) or [()] * len(schema)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int32())), *arrays], ["id", *schema.names]
            )

    kind = docs.select(key).schema[0].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.col(body).cast("string").alias("text"))
    return rows.filter(F.col("text").rlike(CUE)).mapInArrow(run, f"id {kind}, {RESULT}").withColumnRenamed(
        "id", key
    )
