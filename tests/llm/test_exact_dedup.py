"""Exact dedup against grouping by the bytes themselves."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from quillframe.llm.exact_dedup import exact_dedup, golomb, ungolomb


def brute(rows):
    groups = defaultdict(list)
    for k, (doc_id, text, *_) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, k))
    out = []
    for body, members in groups.items():
        sha, best = hashlib.sha256(body.encode()).hexdigest(), min(members)
        for m in members:
            out.append((rows[m[3]][0], rows[best[3]][0], len(members), m[:3] == best[:3], sha))
    return out


@pytest.mark.parametrize("options", [{}, {"unit_bytes": 2000, "owner_rows": 7, "spare": 0, "hot_units": 1}])
def test_groups_are_those_of_equal_bytes(odd_docs, odd_rows, options):
    got = [tuple(r) for r in exact_dedup(odd_docs, **options).collect()]
    want = brute(odd_rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[4])
    # Rows equal in every respect: one of them stays.
    same = lambda r: (*r[:3], r[4])
    assert sorted(map(same, got), key=repr) == sorted(map(same, want), key=repr)
    stays = defaultdict(int)
    for r in got:
        stays[r[4]] += r[3]
    assert set(stays.values()) == {1}
    assert {key(r) for r in got if r[3]} <= {key(r) for r in want if r[3]}


def test_a_hot_group_is_compared_in_parts(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot  text' WHEN id % 3 = 1 THEN concat('t', id) ELSE 'hottext' END AS text")
    got = exact_dedup(docs, unit_bytes=1000, owner_rows=100, hot_units=2)
    assert got.where("group_size = 2000 AND keep_id = 0").count() == 2000
    assert got.where("group_size = 1 AND kept").count() == 1000
    assert got.where("kept").count() == 1001


def test_no_rows(no_docs):
    assert exact_dedup(no_docs).collect() == []


@pytest.mark.parametrize("n, width", [(1, 1), (1, 1 << 62), (5, 7), (1000, 1 << 40), (300, 301)])
def test_golomb_codes_come_back(n, width):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, width, n, dtype=np.uint64))
    coded = golomb(values, width)
    assert (ungolomb(*coded) == values).all()
    assert 8 * sum(map(len, coded)) <= len(values) * (np.log2(width / len(values)) + 3) + 40
