"""Frequencies by digest against plain counters."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillframe.operators import rows as R
from quillframe.operators.frequencies import Frequencies, value_counts
from quillframe.operators.profile import Profile
from quillframe.session import local_table

COLUMNS = ("unique", "ties", "few", "hot", "empty", "number")


@pytest.fixture(scope="module")
def data():
    rng = random.Random(6)
    words = [f"w{k:03d}" for k in range(120)]
    return [
        (f"u{rng.random()}" + "z" * 300, words[k % 120], rng.choice(["a", "b", "ä", None]), "hot" if k % 3 else f"cold{k // 2}", None, rng.randrange(50))
        for k in range(600)
    ]


@pytest.fixture(scope="module")
def table(spark, data):
    return local_table(spark, data, "unique string, ties string, few string, hot string, empty string, number int").repartition(4)


@pytest.fixture(params=[500_000, 2])
def limit(request, monkeypatch):
    monkeypatch.setattr(R, "BROADCAST_DIGESTS", request.param)
    monkeypatch.setattr(R, "BITMAP_WORDS", 8)


@pytest.mark.parametrize("k", [1, 3, 8, 200])
def test_top_values(table, data, k, limit):
    want = []
    for j, name in enumerate(COLUMNS):
        counts = Counter(None if r[j] is None else str(r[j]) for r in data)
        best = sorted(counts.items(), key=lambda x: (-x[1], x[0] is None, (x[0] or "").encode()))[:k]
        want += [(name, i + 1, v, n) for i, (v, n) in enumerate(best)]
    assert sorted(map(tuple, Frequencies(table).top(k).collect()), key=repr) == sorted(want, key=repr)


def test_distinct_values(table, data):
    want = {name: len({r[j] for r in data if r[j] is not None}) for j, name in enumerate(COLUMNS)}
    assert Frequencies(table).distinct() == want
    assert {r["column_name"]: r["unique"] for r in Profile(table).column_table().collect()} == want


def test_long_texts_stay_where_they_are(spark):
    """Of unique texts of 10 kB only the first ones of each task are shuffled."""
    df = spark.range(0, 2000, 1, 4).select(F.concat(F.sha2(F.col("id").cast("string"), 256), F.repeat(F.lit("x"), 10_000)).alias("t"))
    top = Frequencies(df).top(3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert [r["value"][:64] for r in top.orderBy("position").collect()] == sorted(r[0][:64] for r in df.collect())[:3]


def test_empty_table(spark):
    none = local_table(spark, [], "a string, b int")
    assert Frequencies(none).top(3).collect() == [] and Frequencies(none).distinct() == {"a": 0, "b": 0}
    assert value_counts(none).collect() == []
