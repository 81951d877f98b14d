import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillframe.operators import lookup, ranks
from quillframe.operators.correlation import correlations, kendall, pearson_pairs, with_ranks


def frame(n=3000, seed=1):
    rng = random.Random(seed)
    # A third of all rows share one value.
    v = [7.0 if i % 3 == 0 else round(rng.uniform(-50, 50), 2) for i in range(n)]
    g = ["hot" if i % 10 < 7 else rng.choice(["a", "b", None]) for i in range(n)]
    v = [None if rng.random() < 0.05 else x for x in v]
    return pd.DataFrame({"g": g, "v": v})


PROBS = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]


@pytest.mark.parametrize("path", ["whole", "bracket", "missed bracket", "several rounds", "ranges"])
def test_exact_quantiles_every_path(spark, monkeypatch, path):
    pdf = frame()
    if path != "whole":
        monkeypatch.setattr(ranks, "SMALL_INPUT", 10)
    if path == "missed bracket":
        monkeypatch.setattr(ranks, "SKETCH_SIZE", 8)
        monkeypatch.setattr(ranks, "BRACKET_SLACK", -0.2)
    if path == "several rounds":
        monkeypatch.setattr(ranks, "SKETCH_SIZE", 16)
        monkeypatch.setattr(ranks, "BRACKET_SLACK", 0.15)
        monkeypatch.setattr(ranks, "MERGE_TASKS", 2)
    if path in {"ranges", "several rounds"}:
        monkeypatch.setattr(ranks, "ONE_TASK_VALUES", 0)
    df = spark.createDataFrame(pdf[["v"]].astype(object).where(pdf[["v"]].notna(), None), "v double").repartition(3)
    got = ranks.exact_quantiles(df, {"v": F.col("v"), "w": F.col("v") * 2}, PROBS)
    for p in PROBS:
        assert got["v"][p] == pytest.approx(pdf.v.quantile(p))
        assert got["w"][p] == pytest.approx(pdf.v.quantile(p) * 2)


def test_exact_quantiles_edges(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 1.0)], "a double, b double")
    got = ranks.exact_quantiles(df, {"a": F.col("a"), "b": F.col("b")}, [0.5])
    assert got == {"a": {0.5: None}, "b": {0.5: 1.0}}
    assert ranks.exact_quantiles(df.limit(0), {"b": F.col("b")}, [0.5]) == {"b": {0.5: None}}


def test_values_at_ranks(spark, monkeypatch):
    pdf = frame()
    ordered = sorted(x for x in pdf.v if x == x)
    df = spark.createDataFrame([(float(x),) for x in ordered], "v double").repartition(3)
    wanted = [0, 1, 500, len(ordered) - 1, len(ordered)]
    expected = {r: ordered[r] if r < len(ordered) else None for r in wanted}
    assert ranks.values_at_ranks(df, F.col("v"), wanted) == expected
    monkeypatch.setattr(ranks, "SMALL_INPUT", 10)
    assert ranks.values_at_ranks(df, F.col("v"), wanted) == expected


def test_grouped_quantiles_with_hot_and_null_group(spark):
    pdf = frame()
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "g string, v double")
    rows = ranks.grouped_quantiles(df, ["g"], F.col("v"), {"m": 0.5, "q": 0.9}).collect()
    got = {r["g"]: (r["m"], r["q"]) for r in rows}
    expected = pdf.groupby("g", dropna=False).v.quantile([0.5, 0.9]).unstack()
    assert len(got) == len(expected) == 4
    for g, row in expected.iterrows():
        key = None if g != g else g
        assert got[key] == pytest.approx((row[0.5], row[0.9]))


def test_running_totals_descending(spark):
    df = spark.createDataFrame([(g, v, v % 3 + 1) for g in "ab" for v in range(50)], "g string, v int, n long")
    rows = ranks.running_totals(df, ["g"], "v", ["n"], descending=True).collect()
    assert len(rows) == 100
    for r in rows:
        assert r["before_n"] == sum(v % 3 + 1 for v in range(r["v"] + 1, 50))
        assert r["total_n"] == sum(v % 3 + 1 for v in range(50))


@pytest.mark.parametrize("weighted", [True, False])
def test_spread_join_hot_null_and_missing_keys(spark, monkeypatch, weighted):
    monkeypatch.setattr(lookup, "HOT_SHARE", 10)
    keys = ["hot"] * 300 + [None] * 200 + [f"k{i % 60}" for i in range(400)]
    rows = spark.createDataFrame([(k, i % 2) for i, k in enumerate(keys)], "k string, x int").repartition(5)
    table = rows.where("k IS NOT NULL AND k != 'k3'").groupBy("k").agg(
        F.count("*").alias("n"), F.length("k").alias("size"))
    joined = lookup.spread_join(rows, table if weighted else table.drop("n"), "k", "n" if weighted else None)
    got = sorted(map(tuple, joined.select("k", "x", "size").collect()), key=repr)
    expected = sorted(
        ((k, i % 2, None if k in (None, "k3") else len(k)) for i, k in enumerate(keys)), key=repr)
    assert got == expected


def test_remap_ids(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "id string")
    mapping = spark.createDataFrame([("a", "z")], "old string, new string")
    assert sorted(r["id"] or "" for r in lookup.remap_ids(rows, "id", mapping).collect()) == ["", "b", "z"]


def brute_tau(x, y):
    dx, dy = np.sign(x[:, None] - x[None]), np.sign(y[:, None] - y[None])
    return (dx * dy).sum() / np.sqrt((dx * dx).sum() * (dy * dy).sum())


@pytest.mark.parametrize("levels", [2, 5, 1000])
def test_kendall_against_all_pairs(spark, levels):
    rng = np.random.default_rng(levels)
    x = rng.integers(0, 40, 400)
    y = (x * levels // 60 + rng.integers(0, levels, 400)) % levels
    pdf = pd.DataFrame({"x": x.astype(float), "y": y.astype(float)})
    assert kendall(spark.createDataFrame(pdf), "x", "y") == pytest.approx(brute_tau(x, y))


def test_kendall_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "x double, y double")
    assert kendall(df, "x", "y") is None


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlations_are_pairwise_complete(spark, method):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.normal(size=300), "c": rng.integers(0, 4, 300).astype(float), "k": 1.0})
    pdf["b"] = pdf.a + rng.normal(size=300)
    pdf.loc[rng.random(300) < 0.2, "a"] = np.nan
    pdf.loc[rng.random(300) < 0.1, "b"] = np.nan
    expected = pdf.rank().corr() if False else pdf.corr(method=method) if method == "pearson" else _spearman(pdf)
    for r in correlations(spark.createDataFrame(pdf), method).collect():
        want = expected.loc[r["a"], r["b"]]
        if "k" in (r["a"], r["b"]):
            assert r["r"] is None
        else:
            assert r["r"] == pytest.approx(want, abs=6e-5)


def _spearman(pdf):
    out = pd.DataFrame(index=pdf.columns, columns=pdf.columns, dtype=float)
    for a in pdf:
        for b in pdf:
            both = pdf[[a, b]].dropna() if a != b else pdf[[a]].dropna()
            ranks_ = both.rank()
            out.loc[a, b] = ranks_[a].corr(ranks_[b]) if a != b else 1.0
    return out


def test_pearson_with_huge_offset(spark):
    x = np.arange(200, dtype=float)
    pdf = pd.DataFrame({"a": x + 1e12, "b": np.sin(x) + 1e9})
    got = pearson_pairs(spark.createDataFrame(pdf), [("a", "b")])[("a", "b")]
    assert got == pytest.approx(np.corrcoef(x, np.sin(x))[0, 1], abs=1e-4)


def test_ranks_of_large_columns_take_the_spread_join(spark, monkeypatch):
    import quillframe.operators.correlation as correlation

    monkeypatch.setattr(correlation, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(lookup, "HOT_SHARE", 4)
    pdf = pd.DataFrame({"a": [5.0] * 10 + list(map(float, range(20))), "b": [1.0, 2.0] * 15})
    ranked = with_ranks(spark.createDataFrame(pdf), ["a", "b"]).toPandas()
    assert sorted(ranked.a) == sorted(pdf.a.rank())
    assert sorted(ranked.b) == sorted(pdf.b.rank())


def test_ranks_of_many_large_columns_share_one_join(spark, monkeypatch):
    """Rows stay whole: every row's ranks, nulls included, are those of its own values; a hot value is spread."""
    import quillframe.operators.correlation as correlation

    monkeypatch.setattr(correlation, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(lookup, "HOT_SHARE", 4)
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"few": rng.integers(0, 3, 300).astype(float), **{c: rng.normal(size=300).round(1) for c in "abc"}})
    pdf.loc[:140, "b"] = 0.0
    pdf.loc[20:30, "b"] = -0.0
    pdf.loc[::7, "c"] = None
    ranks = with_ranks(spark.createDataFrame(pdf).withColumn("c", F.when(~F.isnan("c"), F.col("c"))).repartition(5), ["few", "a", "b", "c"])
    assert ranks.columns == list(pdf.columns)
    key = lambda r: tuple(-1.0 if x is None or x != x else x for x in r)
    assert sorted(map(key, ranks.collect())) == sorted(map(key, pdf.rank().itertuples(index=False, name=None)))
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(ranks) == joins(with_ranks(spark.createDataFrame(pdf[["few", "a"]]), ["few", "a"]))


def test_spearman_does_not_depend_on_how_ranks_come_back(spark, monkeypatch):
    import quillframe.operators.correlation as correlation

    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({c: rng.normal(size=200).round(1) for c in "abc"})
    pdf["d"] = pdf.a + pdf.b.round()
    want = pdf.corr("spearman")
    for limit in (0, 40, 100_000):
        monkeypatch.setattr(correlation, "BROADCAST_ROWS", limit)
        got = {(r["a"], r["b"]): r["r"] for r in correlations(spark.createDataFrame(pdf), "spearman").collect()}
        assert got == {(x, y): pytest.approx(want.loc[x, y], abs=1e-4) for x in pdf for y in pdf}
