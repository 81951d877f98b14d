import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillframe.operators import metrics as S
from quillframe.operators import models as M
from quillframe.session import local_table


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(3)
    n = 240
    x = rng.normal(size=n)
    noise = rng.normal(size=n)
    group = rng.choice(["red", "green", "blue"], n)
    y = np.where(x + 0.3 * noise + (group == "red") > 0.2, "yes", "no")
    pdf = pd.DataFrame({
        "x": x, "noise": noise, "group": group, "y": y, "value": 3 * x - 2 * (group == "blue") + 0.1 * noise,
        "when": pd.date_range("2024-01-01", periods=n).astype(str), "leak": np.where(y == "yes", 1, 0),
    })
    pdf.loc[::17, "x"] = np.nan
    pdf.loc[::23, "group"] = None
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None),
                                 "x double, noise double, group string, y string, value double, when string, leak int")


FEATURES = ["x", "noise", "group"]


def test_problem_types(spark, people):
    def task(df, c, objective=None):
        return M.identify_problem(df, c, objective).first()["task_type"]

    assert task(people, "y") == "binary_classification" and task(people, "leak") == "binary_classification"
    assert task(people, "group") == "multiclass_classification" and task(people, "value") == "regression"
    assert task(spark.range(100).selectExpr("id % 4 AS v"), "v") == "multiclass_classification"
    assert task(spark.range(60).selectExpr("id % 4 AS v"), "v") == "regression"  # 4 classes are not below 5 % of 60 rows
    assert task(people, "value", "regression") == "regression"
    with pytest.raises(ValueError):
        M.identify_problem(people.select(F.lit(1).alias("k")), "k")
    with pytest.raises(ValueError):
        M.identify_problem(people, "nope")


def test_candidates(people):
    picks = [r["algorithm"] for r in M.recommend_models(people, "y", "binary_classification").orderBy("position").collect()]
    assert picks == ["logistic_regression", "random_forest", "gradient_boosting", "svm"]
    assert M.recommend_models(people, "value", "regression", True).count() == 2


def test_folds_are_stratified_and_repeatable(people):
    table = M.with_folds(people, 5, "y").groupBy("y", "fold").count().toPandas().pivot(index="y", columns="fold", values="count")
    assert table.shape == (2, 5) and (table.max(axis=1) - table.min(axis=1)).max() <= 1
    again = M.with_folds(people.repartition(7), 5, "y").groupBy("y", "fold").count().toPandas()
    assert again.pivot(index="y", columns="fold", values="count").equals(table)


def test_time_split(people):
    split = M.split_by_time(people, "when")
    sides = {r["is_test"]: (r["n"], r["a"], r["b"]) for r in split.groupBy("is_test").agg(
        F.count("*").alias("n"), F.min("when").alias("a"), F.max("when").alias("b")).collect()}
    assert sides[False][0] == 192 and sides[True][0] == 48 and sides[False][2] < sides[True][1]


def test_ridge_equals_the_closed_form(people):
    rows = people.select(*FEATURES, "value")
    prepared, _ = M.prepare(rows, "value", False)
    fields = M.model_fields(rows, "value")
    fitted = M.fit(prepared, fields, "ridge", False, [])
    made = fitted.model.transform(prepared).select("features", "prediction", "label").toPandas()
    a = np.array([v.toArray() for v in made.features])
    centred, y = a - a.mean(0), made.label.values
    w = np.linalg.solve(centred.T @ centred + np.eye(a.shape[1]), centred.T @ (y - y.mean()))
    assert made.prediction.values == pytest.approx(centred @ w + y.mean(), abs=1e-6)
    # numeric features are standardised over the training rows
    assert a[:, 0].mean() == pytest.approx(0, abs=1e-9) and a[:, 0].std() == pytest.approx(1)


def test_rare_and_unseen_levels(spark):
    train = spark.createDataFrame([("a", 1.0)] * 3 + [("b", 2.0)] * 3 + [("once", 1.5), (None, 1.0)], "c string, label double")
    fields = M.Fields([], ["c"], [])
    from pyspark.ml import Pipeline

    model = Pipeline(stages=M.fit_preprocessing(train, fields)).fit(train)
    test = spark.createDataFrame([("a",), ("b",), ("once",), ("new",), (None,), ("it's",)], "c string")
    got = [r["features"].toArray().tolist() for r in model.transform(test).collect()]
    assert got == [[1, 0, 0], [0, 1, 0], [0, 0, 1], [0, 0, 1], [1, 0, 0], [0, 0, 1]]
    clean = Pipeline(stages=M.fit_preprocessing(train.where("c != 'once'"), fields)).fit(train)
    assert [r["features"].toArray().tolist() for r in clean.transform(test).collect()][3] == [0, 0]


def test_any_number_of_levels_is_exact(spark):
    from pyspark.ml import Pipeline

    train = spark.range(24_000).select((F.col("id") % 12_000).cast("string").alias("c"), F.lit(1.0).alias("label"))
    made = Pipeline(stages=M.fit_preprocessing(train, M.Fields([], ["c"], []))).fit(train).transform(train)
    assert made.first()["features"].size == 12_000


def test_infinities_are_missing_in_both_places(spark):
    from pyspark.ml import Pipeline

    train = local_table(spark, [(1.0,), (3.0,), (2.0,)], "x double")
    model = Pipeline(stages=M.fit_preprocessing(train, M.Fields(["x"], [], []))).fit(train)
    odd = local_table(spark, [(float("inf"),), (float("nan"),), (None,), (2.0,)], "x double")
    assert len({r["features"][0] for r in model.transform(odd).collect()}) == 1


def test_training_reports_everything(spark, people, tmp_path):
    rows = people.select(*FEATURES, "y", "leak")
    trained = M.train_model(rows, "y", "binary_classification", "logistic_regression",
                            descriptions={"leak": "leakage"}, folds=3, repeats=2)
    assert trained.fields.excluded == ["leak"]
    assert trained.metrics["f1"] > 0.8 and 0 <= trained.metrics["roc_auc"] <= 1 and trained.metrics["pr_auc"] > 0.8
    assert trained.split["strategy"] == "stratified_random" and trained.split["test"] == pytest.approx(48, abs=1)
    assert set(trained.cross_validation) == {"accuracy", "f1", "roc_auc"}
    assert len(trained.cross_validation["f1"]["folds"]) == 3
    importance = {r["feature"]: r["importance"] for r in trained.importance.collect()}
    assert set(importance) == set(FEATURES) and max(importance, key=importance.get) == "x"
    assert trained.confusion.agg(F.sum("n")).first()[0] == trained.split["test"]
    assert trained.roc.where("fpr = 1 AND tpr = 1").count() == 1

    def area(points):
        points = [(0.0, 0.0), *points]
        return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))

    path = M.save_experiment(trained, str(tmp_path), "people")
    stored = M.load_experiment(spark, str(tmp_path), trained.experiment_id).first()
    assert stored["metrics"]["f1"] == trained.metrics["f1"] and stored["model_path"] == path
    corners = [(r["fpr"], r["tpr"]) for r in M.load_roc(spark, str(tmp_path), trained.experiment_id).collect()]
    curve = [(r["fpr"], r["tpr"]) for r in trained.roc.orderBy(F.desc("threshold")).collect()]
    assert set(corners) <= set(curve) and len(corners) < len(curve) and corners[-1] == (1, 1)
    assert area(corners) == pytest.approx(area(curve)) == pytest.approx(trained.metrics["roc_auc"], abs=1e-6)
    from pyspark.ml import PipelineModel

    assert PipelineModel.load(path).transform(rows).count() == 240
    with pytest.raises(ValueError):
        M.load_experiment(spark, str(tmp_path), "missing")


def test_regression_and_comparison(spark, people):
    rows = people.select(*FEATURES, "value", "when")
    good = M.train_model(rows.drop("when"), "value", "regression", "ridge", folds=2, repeats=1)
    assert good.metrics["r2"] > 0.9 and set(good.cross_validation) == {"mae", "rmse", "r2"}
    late = M.train_model(rows.select("noise", "value", "when"), "value", "regression", "ridge", time_column="when",
                         folds=0, repeats=0)
    assert late.split == {"train": 192, "test": 48, "strategy": "chronological"}
    best = M.compare_models(M.experiment_rows(spark, [late, good])).first()
    assert best["best_experiment_id"] == good.experiment_id and best["primary_metric"] == "rmse"
    with pytest.raises(ValueError):
        M.compare_models(M.experiment_rows(spark, [good]).limit(0))


def test_multiclass(people):
    rows = people.select("x", "noise", "value", "group")
    trained = M.train_model(rows, "group", "multiclass_classification", "logistic_regression", folds=2, repeats=0)
    assert trained.metrics["accuracy"] > 0.4 and "roc_auc" not in trained.metrics
    assert 0.5 < trained.cross_validation["roc_auc"]["mean"] <= 1


@pytest.mark.parametrize("algorithm", ["svm", "random_forest"])
def test_other_classifiers(people, monkeypatch, algorithm):
    trained = M.train_model(people.select(*FEATURES, "y"), "y", "binary_classification", algorithm, folds=0, repeats=0)
    assert trained.metrics["roc_auc"] > 0.8


def test_unknown_algorithm(people):
    with pytest.raises(ValueError):
        M.train_model(people.select(*FEATURES, "y"), "y", "binary_classification", "oracle", folds=0, repeats=0)


# -- metrics on fixed predictions -----------------------------------------------------------------------
def test_binary_metrics_by_hand(spark):
    rows = [(1.0, 1.0, 0.9), (0.0, 1.0, 0.8), (1.0, 1.0, 0.8), (0.0, 0.0, 0.3), (1.0, 0.0, 0.2), (0.0, 0.0, 0.1)]
    p = spark.createDataFrame(rows, "label double, prediction double, score double")
    m = S.classification_metrics(p, 2)
    assert (m["accuracy"], m["precision"], m["recall"], m["f1"]) == tuple(pytest.approx(v) for v in (4 / 6, 2 / 3, 2 / 3, 2 / 3))
    pairs = [(a, b) for a in rows if a[0] for b in rows if not b[0]]
    auc = sum(1 if a[2] > b[2] else 0.5 if a[2] == b[2] else 0 for a, b in pairs) / len(pairs)
    assert m["roc_auc"] == pytest.approx(auc)
    # steps at 0.9, 0.8, 0.3, 0.2, 0.1: precision 1, 2/3, 2/4, 3/5, 3/6
    assert m["pr_auc"] == pytest.approx(1 / 3 * 1 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 5)
    curve = {r["threshold"]: (r["fpr"], r["tpr"]) for r in S.roc_curve(
        p.select(F.col("label").cast("int").alias("positive"), "score")).collect()}
    assert curve[0.8] == (pytest.approx(1 / 3), pytest.approx(2 / 3)) and len(curve) == 5


def test_degenerate_metrics(spark):
    p = spark.createDataFrame([(0.0, 0.0, 0.5), (0.0, 0.0, 0.4)], "label double, prediction double, score double")
    m = S.classification_metrics(p, 2)
    assert (m["precision"], m["recall"], m["f1"], m["roc_auc"]) == (0.0, 0.0, 0.0, None)
    constant = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "label double, prediction double")
    assert S.regression_metrics(constant) == {"mae": 0.0, "mse": 0.0, "rmse": 0.0, "r2": 1.0}


def test_weighted_metrics_and_ovr(spark):
    rows = [(0.0, 0.0, [0.7, 0.2, 0.1]), (1.0, 2.0, [0.3, 0.3, 0.4]), (2.0, 2.0, [0.1, 0.2, 0.7]), (1.0, 1.0, [0.2, 0.6, 0.2])]
    p = spark.createDataFrame(rows, "label double, prediction double, scores array<double>")
    m = S.classification_metrics(p, 3)
    assert m["precision"] == pytest.approx((1 + 2 * 1 + 0.5) / 4) and m["recall"] == pytest.approx((1 + 2 * 0.5 + 1) / 4)
    assert S.weighted_ovr_auc(p, 3) == pytest.approx(1.0)


def test_regression_metrics_by_hand(spark):
    p = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (6.0, 4.0)], "label double, prediction double")
    m = S.regression_metrics(p)
    assert m["mae"] == pytest.approx(1.0) and m["mse"] == pytest.approx(5 / 3) and m["rmse"] == pytest.approx(math.sqrt(5 / 3))
    assert m["r2"] == pytest.approx(1 - 5 / 14)


def test_repeated_rows_and_tied_times_are_shared_out(spark):
    rows = local_table(spark, [(k % 3, "2020-01-01" if k < 90 else "2021-01-01", k % 2) for k in range(100)], "x int, when string, y int")
    shares = M.with_folds(rows, 5, "y").groupBy("y", "fold").count().collect()
    assert len(shares) == 10 and {r["count"] for r in shares} == {10}
    for frame in (rows, rows.withColumn("when", F.lit("2020-05-05"))):
        assert {r["is_test"]: r["count"] for r in M.split_by_time(frame, "when").groupBy("is_test").count().collect()} == {False: 80, True: 20}


def test_comparison_lists_every_experiment(spark):
    rows = [(f"e{k}", "", "y", "binary_classification", a, "{}", {"f1": f}, "{}", "{}", [], [], None, 1.0)
            for k, (a, f) in enumerate([("svm", 0.5), ("forest", 0.9), ("logistic", None)])]
    table = spark.createDataFrame(rows, M.EXPERIMENT_SCHEMA)
    assert [r["experiment_id"] for r in M.comparison_table(table).collect()] == ["e1", "e0", "e2"]
    with pytest.raises(ValueError):
        M.comparison_table(table.unionByName(table.withColumn("task_type", F.lit("regression"))))


def test_all_candidates_read_one_prepared_table(people, monkeypatch):
    """Rows are numbered once and each split is preprocessed once, however many candidates and folds there are."""
    calls = {"numbered": 0, "preprocessed": 0}
    numbered, preprocess = M._numbered, M.fit_preprocessing
    monkeypatch.setattr(M, "_numbered", lambda df: calls.update(numbered=calls["numbered"] + 1) or numbered(df))
    monkeypatch.setattr(M, "fit_preprocessing", lambda *a: calls.update(preprocessed=calls["preprocessed"] + 1) or preprocess(*a))
    monkeypatch.setattr(M, "_estimator", lambda *a: M.LogisticRegression(maxIter=5))
    trained = M.train_recommended(people.select(*FEATURES, "y"), "y", "binary_classification", folds=2, repeats=0)
    assert len(trained) == 4 and calls == {"numbered": 1, "preprocessed": 3}
    assert len({str(t.split) for t in trained}) == 1 and len({str(t.cross_validation) for t in trained}) == 1


def test_importance_replaces_parts_of_vectors(spark):
    """Shuffling a column that is all the model knows costs score; others, and columns without a part, cost nothing."""
    rows = [(k % 2, "ab"[k % 2], f"id{k}", "xyz"[k % 3], float(k % 7)) for k in range(210)]
    df = local_table(spark, rows, "y int, tell string, unique string, other string, noise double")
    fields = M.Fields(["noise"], ["tell", "unique", "other"], [])
    prepared, classes = M.prepare(df, "y", True)
    fitted = M.fit(prepared, fields, "gradient_boosting", True, classes)
    found = {r["feature"]: (r["importance"], r["std"]) for r in M.permutation_importance(fitted, prepared, fields, repeats=3).collect()}
    assert found["noise"] == found["unique"] == found["other"] == (0.0, 0.0)
    assert 0.3 < found["tell"][0] < 0.7


def test_roc_corners_by_hand(spark):
    rows = [(1, 0.9), (1, 0.8), (1, 0.7), (0, 0.6), (1, 0.5), (0, 0.5), (1, 0.4), (0, 0.4), (0, 0.3), (0, 0.2)]
    corners = S.roc_corners(spark.createDataFrame(rows, "positive int, score double")).orderBy(F.desc("threshold")).collect()
    assert [(r["threshold"], round(r["fpr"] * 5), round(r["tpr"] * 5)) for r in corners] == [(0.7, 0, 3), (0.6, 1, 3), (0.4, 3, 5), (0.2, 5, 5)]


def test_levels_beyond_the_bound_are_hashed_and_still_teach(spark, monkeypatch):
    """No level of such a column reaches the driver; the model, its importance and unseen levels work as before."""
    monkeypatch.setattr(M, "MOST_LEVELS", 20)
    rows = [(k % 2, f"k{k % 50}", "ab"[k % 3 == 0], None if k % 11 == 0 else f"v{k % 3}") for k in range(400)]
    df = local_table(spark, rows, "y int, many string, few string, other string")
    fields = M.Fields([], ["many", "few", "other"], [])
    held = [s for s in M.fit_preprocessing(df, fields) if hasattr(s, "labels")]
    assert sorted(len(s.labels) for s in held) == [2, 3]
    prepared, classes = M.prepare(df, "y", True)
    fitted = M.fit(prepared, fields, "logistic_regression", True, classes)
    assert fitted.score(prepared).where("label != prediction").count() == 0
    odd = local_table(spark, [(0, "never", "a", "v1"), (1, None, None, None)], "y int, many string, few string, other string")
    assert fitted.score(M.prepare(odd, "y", True)[0]).count() == 2
    found = {r["feature"]: r["importance"] for r in M.permutation_importance(fitted, prepared, fields, repeats=2).collect()}
    assert max(found, key=found.get) == "many" and set(found) == {"many", "few", "other"}
