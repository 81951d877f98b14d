"""Each notice is named as its own license, and sentences that only sound like one are not named at all."""

from __future__ import annotations

import random

import numpy as np
import pytest

from quillframe.llm import license_scan
from quillframe.llm.license_scan import TEMPLATES, align, scan_licenses
from quillframe.session import local_table

RIGHT = {
    "This work is licensed under the MIT License.": "MIT", "This work is licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Licensed under the BSD License.": "BSD", "Released under the GPL.": "GPL", "This file is licensed under the GPL v3.": "GPL-3.0",
    "Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0", "It is licensed under CC BY 4.0, see below.": "CC-BY-4.0",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "CC-BY-NC-4.0",
    "Licensed under Apache License, Version 2.0": "Apache-2.0", "You can redistribute it and/or modify it under the terms of the GNU Lesser General "
    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "LGPL",
}
WRONG = (
    "This work is licensed under the supervision of Dr Smith.", "This work is licensed under the terms of our contract, version 2.",
    "The general public work is under the bridge.", "Released under the sky.", "Licensed under the Zebra License, Version 2.0.",
    "This work is licensed under the Example License, version 3.", "Rights are not reserved at all.", "Permission is hereby denied to any person.",
    "No part of this work may be lost.", "This program is made available under the counter.",
)


@pytest.fixture(scope="module")
def found(spark):
    texts = [t for _, t in TEMPLATES] + list(RIGHT) + list(WRONG)
    rows = [(k, "Some words before. " + text + "\nand more after it") for k, text in enumerate(texts)]
    out: dict = {k: [] for k in range(len(texts))}
    for r in scan_licenses(local_table(spark, rows, "doc_id long, text string")).collect():
        out[r["doc_id"]].append((r["license"], rows[r["doc_id"]][1][r["start"] : r["end"]]))
    return out


def test_every_template_has_its_own_name(found):
    for k, (name, _) in enumerate(TEMPLATES):
        assert [n for n, _ in found[k]] == [name], (k, name, found[k])


def test_common_notices_and_near_misses(found):
    n = len(TEMPLATES)
    assert {t: [x for x, _ in found[n + k]] for k, t in enumerate(RIGHT)} == {t: [name] for t, name in RIGHT.items()}
    assert {t: found[n + len(RIGHT) + k] for k, t in enumerate(WRONG)} == {t: [] for t in WRONG}


def test_banded_alignment_against_a_full_table():
    """Within the band the best local score is that of the whole table of scores."""
    rng = random.Random(4)
    for _ in range(200):
        template = np.array([rng.randrange(6) for _ in range(rng.randint(1, 10))], np.uint64)
        text = np.array([rng.randrange(6) for _ in range(rng.randint(1, 10))], np.uint64)
        full = np.zeros((len(template) + 1, len(text) + 1), int)
        for i, a in enumerate(template, 1):
            for j, b in enumerate(text, 1):
                full[i, j] = max(0, full[i - 1, j - 1] + (license_scan.MATCH if a == b else license_scan.MISMATCH),
                                 full[i - 1, j] + license_scan.GAP, full[i, j - 1] + license_scan.GAP)
        matched, start, end = align(template, text, 0)
        assert 0 <= start <= end <= len(text) and len(matched) <= min(len(template), end - start)
        assert full.max() == 0 or (full[:, end].max() == full.max() and matched)


def test_lines_found_by_form_have_no_coverage(spark):
    docs = local_table(spark, [(1, "// SPDX-License-Identifier: MIT OR Apache-2.0\n// Copyright (c) 2020 Someone")], "doc_id long, text string")
    assert {(r["license"], r["coverage"]) for r in scan_licenses(docs).collect()} == {("MIT OR Apache-2.0", None), ("Copyright", None)}
