"""How often costly inputs are computed."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillframe.operators import business as B
from quillframe.operators import correlation
from quillframe.operators import models as M


def counting(spark, df, column):
    """``df`` with a column that counts how often its values are computed."""
    seen = spark.sparkContext.accumulator(0)

    def add(value):
        seen.add(1)
        return value

    return df.withColumn(column, F.udf(add, "double").asNondeterministic()(column)), seen


def test_anomalies_compute_their_input_once(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") < 10, 1e6).otherwise(F.col("id") % 500).cast("double").alias("revenue"))
    df, seen = counting(spark, rows, "revenue")
    found = B.biz_anomalies(df, B.detect_roles(df)).first()
    assert (found["n"], found["anomalies"], seen.value) == (30_000, 10, 30_000)
    assert found["share_pct"] == pytest.approx(10 * 100 / 30_000)


def test_ranks_of_large_columns_need_no_join(spark, monkeypatch):
    """Ranges, their bounds, hot values and nulls give the average ranks, from one shuffle for each column."""
    monkeypatch.setattr(correlation, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(correlation, "ROWS_PER_RANGE", 20, raising=False)
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"a.b": rng.normal(size=600), "hot": rng.normal(size=600).round(1), "c": rng.integers(0, 300, 600).astype(float)})
    pdf.loc[:250, "hot"] = 0.0
    pdf.loc[100:150, "hot"] = -0.0
    pdf.loc[::7, "c"] = None
    df = spark.createDataFrame(pdf).withColumn("c", F.when(~F.isnan("c"), F.col("c"))).repartition(5)
    ranks = correlation.with_ranks(df, list(pdf.columns))
    plan = ranks._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 3
    assert ranks.columns == list(pdf.columns)
    key = lambda r: tuple(-1.0 if x is None or x != x else x for x in r)
    assert sorted(map(key, ranks.collect())) == sorted(map(key, pdf.rank().itertuples(index=False, name=None)))


def test_drivers_store_their_input_once(spark):
    rows = spark.range(30_000).select(
        F.col("id").cast("double").alias("revenue"), ((F.col("id") * 7919) % 30_011).cast("double").alias("quantity")
    )
    df, seen = counting(spark, rows, "revenue")
    facts = B.driver_facts(df)
    first = B.biz_quartile_contrast(df, facts=facts).collect()
    assert seen.value == 30_000
    assert "FileScan parquet" in facts.values._jdf.queryExecution().executedPlan().toString()  # scans read one column
    assert [(r["feature"], r["quarter"], r["n"]) for r in first] == [("quantity", "lower quarter", 7500), ("quantity", "upper quarter", 7500)]


def test_prepared_tables_are_dealt_evenly(spark, monkeypatch):
    """A file of one partition does not make one task of every pass of training."""
    monkeypatch.setattr(M, "ROWS_PER_TASK", (10, 100), raising=False)
    rows = spark.range(0, 1000, 1, 1).selectExpr("cast(id as double) AS x", "if(id % 3 = 0, 'yes', 'no') AS y")
    few = M.prepare_splits(rows.limit(15), "y", "binary_classification", folds=0)
    assert few.rows.select(F.spark_partition_id()).distinct().count() == 1
    prepared = M.prepare_splits(rows, "y", "binary_classification", folds=0)
    tasks = [r["n"] for r in prepared.rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(tasks) >= 8 and max(tasks) < 250 and sum(tasks) == 1000
    assert (prepared.split["train"], prepared.split["test"]) == (prepared.train().count(), prepared.held_out().count())
    assert sorted(r["x"] for r in prepared.rows.collect()) == [float(i) for i in range(1000)]


def test_forests_remember_the_nodes_of_rows(spark):
    """The trees are those of a forest that walks down from the root in every pass, which the settings below leave alone."""
    for classification in (True, False):
        forest = M._estimator("random_forest", classification, 2, 10, 1.0)
        assert forest.getCacheNodeIds() and (forest.getNumTrees(), forest.getMaxDepth(), forest.getSeed()) == (120, M.TREE_DEPTH, M.SEED)
