import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillframe.functions import pvalues
from quillframe.functions.roles import detect_roles
from quillframe.operators import business as B
from quillframe.operators import cleaning as K
from quillframe.operators import features as X
from quillframe.operators import profile as P
from quillframe.operators.drivers import DriverAnalysis, binary_target, distinct_up_to
from quillframe.operators.stats import statistical_test


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# -- profile ------------------------------------------------------------------------------------------
def test_profile_matches_pandas(spark, passengers):
    pdf = passengers.toPandas()
    profile = P.Profile(passengers)
    for r in profile.numeric_table().collect():
        s = pdf[r["column_name"]].astype(float)
        expected = [s.min(), s.max(), s.mean(), s.median(), s.std(), s.quantile(0.25), s.quantile(0.75), s.skew()]
        assert list(r)[1:] == pytest.approx(expected)
    facts = {r["column_name"]: r for r in profile.column_table().collect()}
    for c in pdf:
        assert facts[c]["unique"] == pdf[c].nunique() and facts[c]["missing"] == pdf[c].isna().sum()
    assert tuple(profile.shape().first()) == (12, 7, 1, round(100 / 84, 2))
    assert [r["column_name"] for r in profile.missing_report().collect()] == ["age"]


def test_profile_edges(spark):
    df = spark.createDataFrame(
        [(None, float("nan"), 1, "x"), (None, 2.0, 1, None), (None, -0.0, 1, "x"), (None, 0.0, 1, "x")],
        "empty double, v double, one int, t string",
    )
    profile = P.Profile(df)
    facts = {r["column_name"]: r for r in profile.column_table().collect()}
    assert facts["empty"]["unique"] == 0 and facts["v"]["missing"] == 1 and facts["v"]["unique"] == 2
    flags = {r["column_name"]: r["constant"] for r in profile.flags().collect()}
    assert flags == {"empty": True, "v": False, "one": True, "t": True}
    numeric = {r["column_name"]: r for r in profile.numeric_table().collect()}
    assert numeric["one"]["skew"] == 0.0 and numeric["empty"]["mean"] is None
    assert P.duplicate_rows(df.select("t")).first()[0] == 2
    assert {r["column_name"]: r["outliers"] for r in profile.outliers().collect()} == {"empty": 0, "v": 0, "one": 0}
    nothing = P.Profile(df.limit(0))
    assert nothing.rows == 0 and nothing.shape().first()["missing_pct"] == 0.0


def test_top_values_count_null(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), (None,), (None,)], "t string")
    assert [tuple(r)[1:] for r in P.Profile(df).top_values(2).orderBy("position").collect()] == [(1, None, 3), (2, "a", 1)]


def test_nested_columns_only_count_missing(spark):
    df = spark.createDataFrame([([1], 1), (None, 2)], "a array<int>, b int")
    facts = {r["column_name"]: r for r in P.Profile(df).column_table().collect()}
    assert facts["a"]["missing"] == 1 and facts["a"]["unique"] is None


def test_leakage_and_issues(spark):
    df = spark.range(100).selectExpr("id AS y", "id * 2.0D AS twin", "id % 2 AS other", "'k' AS k")
    profile = P.Profile(df, ["y"], {"other": "Possible leakage"})
    assert {r["column_name"] for r in profile.leakage().collect()} == {"twin", "other"}
    issues = {(r["severity"], r["type"], r["column_name"]) for r in profile.quality_issues().collect()}
    assert ("high", "leakage", "twin") in issues and ("medium", "constant", "k") in issues
    assert ("low", "cardinality", "y") in issues


def test_overview(spark, passengers):
    overview = P.dataset_overview(passengers, ["survived"])
    assert sum(r["count"] for r in overview["target"].collect()) == 12
    assert overview["numeric"].count() == 6 and overview["duplicates"].first()[0] == 0
    assert P.target_overview(spark.range(20), "id").columns[0] == "column_name"
    assert P.target_overview(spark.range(20).selectExpr("CAST(id AS STRING) AS t"), "t") is None
    assert P.target_overview(passengers, "survived", regression=True).columns[0] == "column_name"


# -- cleaning -----------------------------------------------------------------------------------------
def test_cleaning_runs_in_order(spark, passengers):
    out, fitted = K.clean(passengers, [
        {"operation": "impute_numeric", "column": "age"},
        {"operation": "standardize_categories", "column": "sex"},
        {"operation": "convert_type", "column": "pclass", "dtype": "str"},
        {"operation": "cap_outliers", "column": "fare"},
        {"operation": "drop_columns", "columns": ["parch", "nope"]},
    ])
    assert fitted[0]["value"] == passengers.toPandas().age.median()
    assert out.where("age IS NULL").count() == 0 and "parch" not in out.columns
    assert dict(out.dtypes)["pclass"] == "string"
    assert rows_of(K.replay(passengers, fitted)) == rows_of(out)


def test_later_statistics_see_earlier_effects(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (5.0,), (None,)], "v double")
    _, fitted = K.clean(df, [{"operation": "drop_duplicates"}, {"operation": "impute_numeric", "column": "v"}])
    assert fitted[1]["value"] == 3.0


def test_imputation_edges(spark):
    df = spark.createDataFrame([(None, "b", 1), (None, "a", None), (None, None, 3), (None, None, 4)], "e string, t string, n int")
    out, fitted = K.clean(df, [
        {"operation": "impute_categorical", "column": "e"}, {"operation": "impute_categorical", "column": "t"},
        {"operation": "impute_numeric", "column": "n", "strategy": "whatever"},
    ])
    assert {r["e"] for r in out.collect()} == {"Unknown"}
    assert sorted(r["t"] for r in out.collect()) == ["a", "a", "a", "b"]  # the smaller text wins a tie
    assert fitted[2]["value"] == pytest.approx(8 / 3)
    empty, _ = K.clean(df.withColumn("z", F.lit(None).cast("double")), [
        {"operation": "impute_numeric", "column": "z"}, {"operation": "cap_outliers", "column": "z"}])
    assert {r["z"] for r in empty.collect()} == {None}


def test_capping_keeps_nulls(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]] + [(None,)], "v double")
    out, _ = K.clean(df, [{"operation": "cap_outliers", "column": "v"}])
    assert sorted((r["v"] is None, r["v"]) for r in out.collect() if r["v"] is not None)[-1][1] == 7.0
    assert out.where("v IS NULL").count() == 1


def test_bad_conversion_fails(spark):
    out, _ = K.clean(spark.createDataFrame([("1",), ("x",)], "v string"), [
        {"operation": "convert_type", "column": "v", "dtype": "int64"}])
    with pytest.raises(Exception, match="cannot convert v"):
        out.collect()


def test_unknown_operations(passengers):
    with pytest.raises(ValueError):
        K.clean(passengers, [{"operation": "explode"}])
    with pytest.raises(ValueError):
        K.clean(passengers, [{"operation": "cap_outliers", "column": "nope"}])
    with pytest.raises(ValueError):
        X.engineer(passengers, [{"operation": "explode"}])


def test_recommend_and_preview(spark, passengers):
    assert K.recommend_cleaning(passengers) == [{"operation": "impute_numeric", "column": "age", "strategy": "median"}]
    effects = K.preview_cleaning(passengers, [{"operation": "impute_numeric", "column": "age"}]).first()
    assert (effects["missing_before"], effects["missing_after"], effects["rows_after"]) == (1, 0, 12)
    sparse = spark.createDataFrame([(None, "k")] * 8 + [("x", "k")] * 2, "mostly string, k string")
    assert [o["operation"] for o in K.recommend_cleaning(sparse)] == ["drop_duplicates", "drop_columns", "drop_columns"]


# -- features -----------------------------------------------------------------------------------------
def test_features_match_pandas(spark):
    pdf = pd.DataFrame({
        "name": ["Smith, Mr. J", "none", "Doe, Miss. A", None], "age": [0.0, 18.0, 18.5, np.nan],
        "a": [1.0, 2.0, np.nan, 4.0], "b": [0.0, 2.0, 2.0, np.nan], "d": ["2024-01-01", "bad", "2024-12-31", None],
        "g": ["x", "y", "x", None],
    })
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None),
                               "name string, age double, a double, b double, d string, g string")
    out, _ = X.engineer(df, [
        {"operation": "title_from_name", "column": "name"},
        {"operation": "age_group", "column": "age", "bins": [0, 18, 30]},
        {"operation": "bin", "name": "ab", "column": "age", "bins": [0, 18, 30]},
        {"operation": "bin", "name": "eq", "column": "age", "bins": 3},
        {"operation": "ratio", "name": "r", "numerator": "a", "denominator": "b"},
        {"operation": "log1p", "column": "a"},
        {"operation": "date_parts", "column": "d"},
        {"operation": "frequency_encode", "column": "g"},
        {"operation": "one_hot", "columns": ["g"]},
    ])
    got = out.toPandas()
    assert got.title.tolist() == ["Mr", "Unknown", "Miss", "Unknown"]

    def texts(series):
        return [None if v is None or v is pd.NA or v != v else str(v) for v in series]

    assert texts(got.age_group) == texts(pd.cut(pdf.age, [0, 18, 30], include_lowest=True).astype(object))
    assert texts(got.ab) == texts(pd.cut(pdf.age, [0, 18, 30]).astype(object))
    assert texts(got["eq"]) == texts(pd.cut(pdf.age, 3).astype(object))
    assert got.r.tolist()[1] == 1.0 and got.r.isna().tolist() == [True, False, True, True]
    assert got.a_log.tolist()[:2] == pytest.approx([math.log(2), math.log(3)])
    assert got.d_dow.tolist()[0] == 0 and got.d_dow.tolist()[2] == 1 and got.d_year.isna().tolist()[1]
    assert got.g_frequency.tolist()[:3] == pytest.approx([2 / 3, 1 / 3, 2 / 3]) and np.isnan(got.g_frequency.tolist()[3])
    assert got[["g_x", "g_y"]].values.tolist() == [[1, 0], [0, 1], [1, 0], [0, 0]] and "g" not in got


def test_equal_width_labels_match_pandas(spark):
    for values, bins in (([1.0, 2.5, 7.25, 9.0], 4), ([0.001, 0.002, 0.0035], 3), ([100.0, 5000.0, 123456.0], 2), ([5.0, 5.0], 2)):
        df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
        got = [r["b"] for r in X.engineer(df, [{"operation": "bin", "name": "b", "column": "v", "bins": bins}])[0].collect()]
        assert got == [str(x) for x in pd.cut(pd.Series(values), bins)]


def test_drop_first_and_recommendations(spark, passengers):
    out, _ = X.engineer(passengers, [{"operation": "one_hot", "columns": ["sex"], "drop_first": True}])
    assert "sex_male" in out.columns and "sex_female" not in out.columns
    kinds = [o["operation"] for o in X.recommend_features(passengers)]
    assert kinds == ["family_size", "is_alone", "fare_per_person", "age_group"]
    dated = spark.createDataFrame([], "d date, name string")
    assert [o["operation"] for o in X.recommend_features(dated)] == ["title_from_name", "date_parts"]
    preview = X.preview_features(passengers, X.recommend_features(passengers))
    assert preview["added_columns"] == ["family_size", "is_alone", "fare_per_person", "age_group"]
    assert preview["sample"].count() == 5


# -- tests --------------------------------------------------------------------------------------------
def test_tail_probabilities():
    # Textbook quantiles: t(10) 97.5 %, chi2(3) 95 %, F(3, 20) 95 %.
    assert pvalues.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert pvalues.chi2_upper(7.814727903, 3) == pytest.approx(0.05, abs=1e-8)
    assert pvalues.f_upper(3.098391212, 3, 20) == pytest.approx(0.05, abs=1e-7)
    assert pvalues.t_two_sided(0.0, 5) == pytest.approx(1.0)
    assert pvalues.chi2_upper(200.0, 2) == pytest.approx(math.exp(-100), rel=1e-9)


def test_statistics_by_hand(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 2.0), ("b", 4.0), ("b", 9.0), ("b", None), (None, 5.0)], "g string, v double")
    t = statistical_test(df, "t_test", ["g", "v"]).first()
    assert t["statistic"] == pytest.approx(-3 / math.sqrt(1 / 3 + 13 / 3)) and t["n"] == 6
    assert t["effect_size"] == pytest.approx(-3 / math.sqrt((2 / 3 + 26 / 3) / 2))
    f = statistical_test(df, "anova", ["g", "v"]).first()
    assert f["statistic"] == pytest.approx(13.5 / (28 / 4)) and (f["df"], f["df2"]) == (1.0, 4.0)
    with pytest.raises(ValueError):
        statistical_test(df.where("g = 'a'"), "t_test", ["g", "v"])
    with pytest.raises(ValueError):
        statistical_test(df, "sign", ["g", "v"])


def test_chi_square_with_an_empty_cell_and_yates(spark):
    pairs = [("a", "x")] * 10 + [("a", "y")] * 5 + [("b", "x")] * 3 + [("c", "y")] * 4
    df = spark.createDataFrame(pairs, "p string, q string")
    o = pd.crosstab(df.toPandas().p, df.toPandas().q).values
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    r = statistical_test(df, "chi_square", ["p", "q"]).first()
    assert r["statistic"] == pytest.approx(((o - e) ** 2 / e).sum()) and r["df"] == 2.0
    two = df.where("p != 'c'")
    r = statistical_test(two, "chi_square", ["p", "q"]).first()
    o = np.array([[10, 5], [3, 0]])
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    gap = np.abs(o - e)
    assert r["statistic"] == pytest.approx(((gap - np.minimum(0.5, gap)) ** 2 / e).sum()) and r["df"] == 1.0


def test_correlation_tests(spark):
    df = spark.range(50).selectExpr("CAST(id AS DOUBLE) AS x", "id * id * 1.0D AS y", "IF(id < 3, NULL, -id) AS z")
    assert statistical_test(df, "spearman", ["x", "y"]).first()["statistic"] == pytest.approx(1.0)
    r = statistical_test(df, "pearson", ["x", "z"]).first()
    assert r["statistic"] == pytest.approx(-1.0) and r["n"] == 47 and r["p_value"] < 1e-12 and r["association"]


# -- drivers ------------------------------------------------------------------------------------------
def test_driver_baseline_and_segments(passengers):
    analysis = DriverAnalysis(passengers, "survived")
    base = analysis.baseline().first()
    assert base["baseline_rate_pct"] == 50.0 and base["positive_label"] == "1" and base["minimum_segment_size"] == 2
    sexes = {r["segment"]: r for r in analysis.segments(["sex"]).collect()}
    assert sum(r["customers"] for r in sexes.values()) == 12
    ages = analysis.segments(["age"]).collect()  # eleven levels: categories, null is "Missing"
    assert all(r["customers"] >= 2 for r in ages)
    assert analysis.top_segments(99).count() <= 15 and analysis.strongest_fields().count() <= 5


def test_driver_quintiles_keep_null_apart(spark):
    df = spark.range(200).selectExpr(
        "IF(id % 4 = 0, ' Churned ', 'stayed') AS outcome", "IF(id >= 150, NULL, id) AS v", "CAST(id AS STRING) AS text",
        "id AS row_id", "'same' AS k")
    analysis = DriverAnalysis(df, "outcome")
    assert analysis.outcome.positive == "Churned"  # the rarer value
    segments = {r["segment"]: r["customers"] for r in analysis.segments(["v"]).collect()}
    assert segments[None] == 50 and sum(segments.values()) == 200 and len(segments) == 6
    assert "(-0.001, 29.8]" in segments
    excluded = {r["feature"] for r in analysis.excluded_fields().collect()}
    assert excluded == {"outcome", "row_id", "text"}


def test_driver_errors(spark):
    with pytest.raises(ValueError, match="too few"):
        DriverAnalysis(spark.createDataFrame([("y", 1), ("n", 2)], "o string, v int"), "o")
    three = spark.range(30).selectExpr("CAST(id % 3 AS STRING) AS o", "id AS v")
    with pytest.raises(ValueError, match="two outcomes"):
        DriverAnalysis(three, "o")
    assert binary_target(spark.range(10).selectExpr("id % 2 AS o"), "o").positive == "1"


def test_distinct_up_to(spark):
    df = spark.range(1000).selectExpr("id % 30 AS a", "id % 31 AS b", "id AS c", "CAST(NULL AS INT) AS d")
    assert distinct_up_to(df, ["a", "b", "c", "d"], 30) == {"a": 30, "b": None, "c": None, "d": 0}


# -- business -----------------------------------------------------------------------------------------
def test_every_intent_on_the_shop(shop):
    for intent in B.INTENTS:
        result = B.investigate(shop, "Why did revenue change?", intent)
        if intent == "churn_risk":
            assert result.status == "unsupported" and result.reason
            continue
        assert result.status == "supported", (intent, result.reason)
        for table in result.tables.values():
            assert table.count() >= 1


def test_shop_numbers(shop):
    roles = detect_roles(shop)
    yoy = B.biz_yoy(shop, roles).first()
    assert yoy["revenue_change_pct"] == pytest.approx(15.0)
    assert (yoy["old_margin_pct"], yoy["new_margin_pct"]) == (pytest.approx(25.0), pytest.approx(16.0))
    assert B.biz_months(shop, roles).count() == 24  # one distinct day a month: nothing is trimmed
    margins = [r["margin_pct"] for r in B.biz_discounts(shop, roles).collect()]
    assert margins[0] == pytest.approx(margins[1])
    forecast = B.biz_forecast(shop, roles).first()
    assert forecast["period"] == "2026-01" and forecast["estimate"] == pytest.approx(1020 * 1.7 * 1.15)
    assert B.biz_backtest(shop, roles).first()["comparisons"] == 12
    share = B.biz_top20_share(shop, roles).first()
    assert share["top_customers"] == 1 and share["top_share_pct"] == pytest.approx(100 / 1.7)
    change = B.biz_change(shop, roles, "profit").first()
    assert (change["before_period"], change["after_period"]) == ("2025-11", "2025-12") and change["delta"] > 0
    assert [r["group_value"] for r in B.biz_contribution(shop, roles).collect()] == ["Core", "Growth"]
    split = B.biz_volume_value(shop, roles).first()
    assert (split["orders_before"], split["orders_after"]) == (2, 2)


def test_partial_months_are_trimmed(spark):
    days = pd.date_range("2024-01-10", "2024-04-12")
    df = spark.createDataFrame([(str(d.date()), 1.0) for d in days], "order_date string, revenue double")
    periods = sorted(r["period"] for r in B.biz_months(df, detect_roles(df)).collect())
    assert periods == ["2024-02", "2024-03"]


def test_ties_and_share_of_equal_customers(spark):
    df = spark.createDataFrame([(i, 10.0) for i in range(10)] + [(None, 99.0)], "customer_id int, revenue double")
    share = B.biz_top20_share(df, detect_roles(df)).first()
    assert (share["customers"], share["top_customers"], share["top_share_pct"]) == (10, 2, pytest.approx(20.0))


def test_unsupported_reasons(spark):
    df = spark.createDataFrame([("a",)], "text string")
    for intent in B.INTENTS:
        result = B.investigate(df, "", intent)
        if intent != "quality":
            assert result.status == "unsupported" and result.reason and not result.tables
    assert B.investigate(df.limit(0)).status == "unsupported"
    with pytest.raises(ValueError):
        B.investigate(df, intent="astrology")


def test_drivers_skip_ids_and_two_valued_fields(spark):
    df = spark.range(40).selectExpr("id * 2.0D AS revenue", "id AS x", "id % 2 AS flag", "id AS store_id")
    assert [tuple(r)[1:] for r in B.biz_drivers(df).collect()] == [("x", 1.0, 40)]
    contrast = [r["median_target"] for r in B.biz_quartile_contrast(df).collect()]
    assert contrast == [9.0, 69.0]


def test_one_hot_refuses_columns_with_too_many_levels(spark, monkeypatch):
    df = spark.range(30).select((F.col("id") % 7).cast("string").alias("g"))
    operation = {"operation": "one_hot", "columns": ["g"]}
    assert len(X.engineer(df, [operation])[0].columns) == 7
    with pytest.raises(ValueError):
        X.engineer(df, [{**operation, "max_levels": 6}])
    monkeypatch.setattr(X, "ONE_HOT_LEVELS", 5)
    with pytest.raises(ValueError):
        X.engineer(df, [operation])
    assert len(X.engineer(df, [{**operation, "max_levels": 7}])[0].columns) == 7
