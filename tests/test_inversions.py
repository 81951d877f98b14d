"""Inversions and Kendall's tau against brute force, on partitions of every size."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from quillframe.operators import inversions
from quillframe.operators.correlation import kendall
from quillframe.operators.inversions import discordant, weighted_inversions
from quillframe.session import local_table, temporary_conf


@pytest.mark.parametrize("n, levels", [(0, 1), (1, 1), (2, 2), (50, 1), (50, 3), (200, 1000), (257, 16)])
def test_weighted_inversions(n, levels):
    rng = np.random.default_rng(n)
    values, weights = rng.integers(0, levels, n), rng.integers(1, 5, n)
    want = sum(weights[i] * weights[j] for i in range(n) for j in range(i + 1, n) if values[i] > values[j])
    assert weighted_inversions(values, weights) == want


@pytest.mark.parametrize("parts", [1, 3, 16])
@pytest.mark.parametrize("kind", ["plain", "hot x", "hot y", "reversed", "one value"])
def test_discordant_pairs(spark, kind, parts):
    rng = random.Random(parts)
    rows = [(float(rng.randrange(30)), float(rng.randrange(25))) for _ in range(250)]
    if kind.startswith("hot"):
        rows = [(7.0 if kind == "hot x" and k % 2 else x, 3.0 if kind == "hot y" and k % 2 else y) for k, (x, y) in enumerate(rows)]
    if kind == "reversed":
        rows = [(float(k), -float(k)) for k in range(120)]
    if kind == "one value":
        rows = [(1.0, 1.0)] * 50
    want = sum((a[0] - b[0]) * (a[1] - b[1]) < 0 for i, a in enumerate(rows) for b in rows[:i])
    pairs = [(x, y, n) for (x, y), n in Counter(rows).items()]
    with temporary_conf(spark, spark__sql__shuffle__partitions=str(parts)):
        assert discordant(local_table(spark, pairs, "x double, y double, n long")) == want


def test_parts_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(inversions, "MOST_PARTS", 2)
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": rng.normal(size=300).round(1), "b": rng.normal(size=300).round(1)})
    signs = [np.sign(np.subtract.outer(pdf[c].values, pdf[c].values)) for c in "ab"]
    want = (signs[0] * signs[1]).sum() / np.sqrt((signs[0] ** 2).sum() * (signs[1] ** 2).sum())
    assert kendall(spark.createDataFrame(pdf), "a", "b") == pytest.approx(want, abs=1e-9)


def test_nothing_to_compare(spark):
    assert kendall(local_table(spark, [], "a double, b double"), "a", "b") is None
    assert kendall(local_table(spark, [(1.0, 2.0), (1.0, 3.0)], "a double, b double"), "a", "b") is None
    assert kendall(local_table(spark, [(1.0, None), (None, 3.0)], "a double, b double"), "a", "b") is None
