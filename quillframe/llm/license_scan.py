"""License scans: winnowed template fingerprints pick candidates, banded alignment reports coverage and spans."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import PLAIN, Words, words_of

#: Words in a fingerprint, and fingerprints of which the least is kept: a shared run of GRAM + WINNOW - 1 words is never missed.
GRAM, WINNOW = 3, 2
#: Half width of the alignment band, in words.
BAND = 12
#: Share of a template that must match; templates of fewer than ``SHORT`` words must match nearly whole.
SHORT, SHORT_SHARE, LONG_SHARE = 12, 0.85, 0.5
MATCH, MISMATCH, GAP = 2, -1, -1

HITS = "doc_id long, license string, coverage double, matched int, template_words int, start long, end long"

#: Notices in common use.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("Proprietary", "All rights reserved. No part of this publication may be reproduced without written permission."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
            "is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
                   "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
            "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
            "that the above copyright notice and this permission notice appear in all copies."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
                "documentation covered by this license"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
             "damages arising from the use of this software."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("GPL", "Licensed under the GPL."),
    ("GPL", "Released under the GPL."),
    ("GPL-2.0", "Licensed under the GPL v2."),
    ("GPL-2.0", "Licensed under GPLv2."),
    ("GPL-3.0", "Licensed under the GPL v3."),
    ("GPL-3.0", "Licensed under GPLv3."),
    ("BSD", "Licensed under the BSD License."),
    ("BSD", "Released under the BSD License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2."),
    ("Apache-2.0", "Licensed under the Apache License 2.0."),
    ("Apache-2.0", "Licensed under the Apache 2.0 License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("LGPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
             "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
             "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
             "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
)
#: Words that do not tell one license from another; one of them may be missing or changed in a template of at least ``EDITABLE`` words.
GENERAL, EDITABLE = frozenset("released licensed distributed under the this work is a an of to terms license version v".split()), 5
#: A template of at most ``NOTICE`` words needs all its telling words; of a longer one, only those that name a license must match.
NOTICE = 18
NAMING = frozenset(
    "gnu lesser affero general public gpl mit apache mozilla eclipse boost bsd creative commons attribution noncommercial sharealike noderivatives cc0 "
    "unencumbered".split()
)
#: Lines with a free part: SPDX lines are named by their expression, copyright lines need a sign or a year.
_YEARS = r"(?:19|20)\d\d(?:\s*[-\u2013,]\s*(?:(?:19|20)\d\d|present))*"
_SPDX = re.compile(r"SPDX-License-Identifier:[^\S\n]*(\(?[A-Za-z0-9.+-]+(?:[^\S\n]+(?:AND|OR|WITH)[^\S\n]+\(?[A-Za-z0-9.+-]+\)?)*\)?)", re.I)
_COPYRIGHT = re.compile(
    rf"(?:\bcopyright[^\S\n]*(?:(?:\u00a9|\(c\))[^\S\n]*(?:{_YEARS})?|{_YEARS})|\u00a9[^\S\n]*{_YEARS}|\(c\)[^\S\n]*{_YEARS})[^\n.;]*", re.I
)
_PLAIN_WORD = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")


def winnow(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of the fingerprints of every row: the least of each ``WINNOW`` neighbouring grams."""
    at, value = words.windows(GRAM)
    keep = np.zeros(len(at), bool)
    row = words.row_of(at)
    for lag in range(1, WINNOW):
        near = row[lag:] == row[:-lag]
        later = value[lag:] <= value[:-lag]
        keep[lag:] |= near & later
        keep[:-lag] |= near & ~later
    alone = np.ones(len(at), bool)
    alone[1:] &= row[1:] != row[:-1]
    alone[:-1] &= row[1:] != row[:-1]
    keep |= alone
    return at[keep], value[keep]


class TemplateIndex:
    """Word hashes of the templates, and their fingerprints in order of value."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.names, self.words, self.needed, parts = [], [], [], []
        for words in words_of(pa.array([text for _, text in templates], pa.large_string()), PLAIN):
            at, value = winnow(words)
            # Templates of few words keep all their grams.
            every, grams = words.windows(GRAM)
            short = words.counts[words.row_of(every)] < SHORT
            long = words.counts[words.row_of(at)] >= SHORT
            at, value = np.concatenate([at[long], every[short]]), np.concatenate([value[long], grams[short]])
            # Pairs with a telling word outlast any one edit of a template of five words.
            pair, value_2 = words.windows(2)
            size = words.counts[words.row_of(pair)]
            spelled = [bytes(words.data[lo:hi]).decode() for lo, hi in zip(words.starts, words.ends)]
            tells = np.array([w not in GENERAL for w in spelled], bool)
            pick = (size >= EDITABLE) & (size < SHORT) & (tells[pair] | tells[pair + 1])
            at, value = np.concatenate([at, pair[pick]]), np.concatenate([value, value_2[pick]])
            row = words.row_of(at)
            naming = np.array([w in NAMING for w in spelled], bool)
            for k, (a, b) in enumerate(zip(words.first[:-1], words.first[1:])):
                self.names.append(templates[words.rows[0] + k][0])
                self.words.append(words.hashes[a:b])
                self.needed.append((tells if b - a <= NOTICE else naming)[a:b])
            parts.append((value, row + words.rows[0], at - words.first[row]))
        value, template, offset = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2)
        order = np.argsort(value, kind="stable")
        self.value, self.template, self.offset = value[order], template[order], offset[order]

    def candidates(self, words: Words) -> np.ndarray:
        """Distinct (row, template, diagonal) of shared fingerprints."""
        at, value = (np.concatenate(x) for x in zip(words.windows(GRAM), words.windows(2)))
        lo = np.searchsorted(self.value, value, side="left")
        n = np.searchsorted(self.value, value, side="right") - lo
        hit = np.flatnonzero(n)
        n = n[hit]
        place = np.repeat(lo[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        row = words.row_of(at[hit])
        diagonal = np.repeat(at[hit] - words.first[row], n) - self.offset[place]
        return np.unique(np.vstack([np.repeat(row, n), self.template[place], diagonal]), axis=1)


def align(template: np.ndarray, text: np.ndarray, diagonal: int) -> tuple[list[int], int, int]:
    """Best local alignment within ``BAND`` of a diagonal: the template's matched words, and the span in ``text``; ties: the first end."""
    lo, hi = max(0, diagonal - BAND), min(len(text), diagonal + len(template) + BAND)
    part = text[lo:hi]
    steps = np.arange(len(part) + 1) * -GAP
    score = np.zeros((len(template) + 1, len(part) + 1), np.int32)
    column = np.arange(len(part) + 1) + lo - diagonal
    for i, word in enumerate(template, 1):
        new = np.zeros(len(part) + 1, np.int32)
        new[1:] = np.maximum(score[i - 1, :-1] + np.where(part == word, MATCH, MISMATCH), score[i - 1, 1:] + GAP)
        new = np.maximum(np.maximum.accumulate(np.maximum(new, 0) + steps) - steps, 0)
        new[(column < i - BAND) | (column > i + BAND)] = 0
        score[i] = new
    i, j = np.unravel_index(int(score.argmax()), score.shape)
    end, matched = j, []
    while i and j and score[i, j] > 0:
        same = part[j - 1] == template[i - 1]
        if score[i, j] == score[i - 1, j - 1] + (MATCH if same else MISMATCH):
            i, j = i - 1, j - 1
            if same:
                matched.append(int(i))
        elif score[i, j] == score[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return matched, lo + int(j), lo + int(end)


def free_lines(text: str) -> list[tuple[str, None, int, int, int, int]]:
    """SPDX and copyright lines: name, no coverage as they have no template, words, words, and the span."""
    found = []
    for pattern in (_SPDX, _COPYRIGHT):
        for m in pattern.finditer(text):
            hit = m[0].rstrip()
            n = len(_PLAIN_WORD.findall(hit))
            found.append((m[1] if pattern is _SPDX else "Copyright", None, n, n, m.start(), m.start() + len(hit)))
    return found


def _scan(templates: tuple[tuple[str, str], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(templates)
        for batch in batches:
            ids, rows = batch.column("doc_id"), []
            for words in words_of(batch.column("text"), PLAIN):
                hits: dict[int, list[tuple]] = {}
                done: dict[tuple[int, int], int] = {}
                for row, template, diagonal in index.candidates(words).T.tolist():
                    if diagonal < done.get((row, template), -(1 << 60)):
                        continue
                    a, b = words.first[row], words.first[row + 1]
                    size = len(index.words[template])
                    same, start, end = align(index.words[template], words.hashes[a:b], diagonal)
                    matched, needed = len(same), index.needed[template]
                    telling = int(needed[same].sum())
                    edited = EDITABLE <= size < SHORT and matched == size - 1 and needed.any()
                    if telling == needed.sum() and (edited or matched >= size * (SHORT_SHARE if size < SHORT else LONG_SHARE)):
                        hits.setdefault(row, []).append((-matched, start, end, index.names[template], size, -telling))
                        done[(row, template)] = end
                for row, found in hits.items():
                    taken: list[tuple[int, int]] = []
                    a = words.first[row]
                    for matched, start, end, name, size, _ in sorted(set(found), key=lambda h: (h[0], h[5], h[4], h[1], h[3])):
                        if any(start < e and s < end for s, e in taken):
                            continue
                        taken.append((start, end))
                        lo, hi = words.starts[a + start], words.ends[a + end - 1]
                        chars = _code_points(words, row, lo), _code_points(words, row, hi)
                        rows.append((ids[words.rows[0] + row].as_py(), name, -matched / size, -matched, size, *chars))
            for doc_id, text in zip(ids, batch.column("text")):
                rows += [(doc_id.as_py(), *line) for line in free_lines(text.as_py() or "")]
            columns = list(zip(*rows)) if rows else [()] * 7
            types = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types)],
                names=["doc_id", "license", "coverage", "matched", "template_words", "start", "end"],
            )

    return run


def _code_points(words: Words, row: int, at: int) -> int:
    """Code points between the row's first byte and byte ``at`` of the slice."""
    return int(np.count_nonzero((words.data[words.bounds[row] : at] & 0xC0) != 0x80))


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(doc_id, license, coverage, matched, template_words, start, end): license notices in ``docs(doc_id, text)``.

    Fingerprints of the templates (three words; the least of two neighbours, or all of a template of fewer than ``SHORT`` words) form an
    inverted index; every fingerprint that
    a text shares names a template and a diagonal.  A local alignment within ``BAND`` words of the diagonal counts
    the template's ``matched`` words; ``coverage`` is their share, and ``start`` and ``end`` span the match in code points.  Half of a template
    must match, or 85 % of one of fewer than ``SHORT`` words, or all but one of its words; and always every word by which it tells its license: of a
    template of up to ``NOTICE`` words all but ``GENERAL`` ones, of a longer one those in ``NAMING``.  Of overlapping matches the one with most
    matched words counts, then that with more telling ones, the shorter template, the first start, and the name.  SPDX lines, named by their expression,
    and copyright lines are found by their form, besides the templates, and have no coverage.

    Null, empty and wordless texts have no match; repeated rows are each answered; null doc_ids stay null; empty tables give no rows; other columns
    are ignored.  Rows are independent of each other and nothing is shuffled; templates are a parameter, not corpus data.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_scan(templates), HITS)
