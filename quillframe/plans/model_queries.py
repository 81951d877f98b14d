"""Model workflow: choosing, splitting, training, measuring, comparing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as S
from ..operators import models as M
from ..session import local_table, scratch_folder
from .registry import query, rounded

_OUT = ("outcomes",)


@query(
    "ml_identify",
    """
SELECT 'outcome' AS target, 'binary_classification' AS task_type, count(*) AS "rows", count(DISTINCT outcome) AS classes FROM outcomes
UNION ALL SELECT 'l_linenumber', CASE WHEN count(DISTINCT l_linenumber) <= 20 AND count(DISTINCT l_linenumber) < 0.05 * count(*)
    THEN 'multiclass_classification' ELSE 'regression' END, count(*), count(DISTINCT l_linenumber) FROM lineitem
UNION ALL SELECT 'l_extendedprice', 'regression', count(*), count(DISTINCT l_extendedprice) FROM lineitem
""",
    _OUT,
)
def ml_identify(t):
    lineitem = t("lineitem")
    return (
        M.identify_problem(t("outcomes"), "outcome")
        .unionByName(M.identify_problem(lineitem, "l_linenumber"))
        .unionByName(M.identify_problem(lineitem, "l_extendedprice"))
    )


@query(
    "ml_recommend",
    """
WITH c AS (SELECT outcome, count(*) AS n FROM outcomes GROUP BY outcome),
i AS (SELECT round(min(n) * 1.0 / max(n), 6) AS r, sum(n) AS n FROM c)
SELECT 1 AS position, 'logistic_regression' AS algorithm, CASE WHEN r < 0.5 THEN 'f1' ELSE 'roc_auc' END AS primary_metric, r AS imbalance_ratio FROM i
UNION ALL SELECT 2, 'random_forest', 'f1', r FROM i UNION ALL SELECT 3, 'gradient_boosting', 'roc_auc', r FROM i
UNION ALL SELECT 4, 'svm', 'f1', r FROM i
""",
    _OUT,
)
def ml_recommend(t):
    return rounded(M.recommend_models(t("outcomes"), "outcome", "binary_classification"))


@query(
    "ml_features",
    """
WITH m AS (SELECT avg(doc_id) AS a1, stddev_pop(doc_id) AS s1, avg(toxic) AS a2, stddev_pop(toxic) AS s2,
                  avg(n_chars) AS a3, stddev_pop(n_chars) AS s3 FROM outcomes),
mode_lang AS (SELECT lang FROM outcomes WHERE lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1),
src AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS code FROM outcomes GROUP BY source HAVING count(*) > 1),
lng AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS code FROM outcomes WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) > 1)
SELECT doc_id, round((doc_id - a1) / s1, 6) AS z_doc_id, round((toxic - a2) / s2, 6) AS z_toxic,
       round((n_chars - a3) / s3, 6) AS z_n_chars, src.code AS source_code, lng.code AS lang_code
FROM outcomes o CROSS JOIN m LEFT JOIN src ON src.source = o.source
LEFT JOIN lng ON lng.lang = coalesce(o.lang, (SELECT lang FROM mode_lang))
""",
    _OUT,
)
def ml_features(t):
    """Fitted preprocessing applied to every row: standardised numbers and the level each one-hot block marks."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    rows, _ = M.prepare(t("outcomes"), "outcome", True)
    made = Pipeline(stages=M.fit_preprocessing(rows, M.model_fields(t("outcomes"), "outcome"))).fit(rows).transform(rows)
    values = vector_to_array("features")
    names = ("z_doc_id", "z_toxic", "z_n_chars")

    def code(block: str):
        return (F.array_position(vector_to_array(block), 1.0) - 1).cast("long")

    return rounded(made.select(
        "doc_id", *[values[i].alias(n) for i, n in enumerate(names)],
        code("_o0").alias("source_code"), code("_o1").alias("lang_code"),
    ))


@query(
    "ml_split_stratified",
    """
SELECT outcome, CAST(ceil(count(*) / 5.0) AS BIGINT) AS test_rows, count(*) - CAST(ceil(count(*) / 5.0) AS BIGINT) AS train_rows
FROM outcomes GROUP BY outcome
""",
    _OUT,
)
def ml_split_stratified(t):
    parted = M.with_folds(t("outcomes"), 5, "outcome")
    return parted.groupBy("outcome").agg(
        F.count_if(F.col("fold") == 0).alias("test_rows"), F.count_if(F.col("fold") != 0).alias("train_rows")
    )


@query(
    "ml_split_time",
    """
WITH r AS (SELECT order_date, row_number() OVER (ORDER BY order_date) - 1 AS k, count(*) OVER () AS n FROM sales)
SELECT k >= floor(n * 0.8) AS is_test, count(*) AS n, CAST(CAST(min(order_date) AS DATE) AS VARCHAR) AS first_day,
       CAST(CAST(max(order_date) AS DATE) AS VARCHAR) AS last_day
FROM r GROUP BY 1
""",
    ("sales",),
)
def ml_split_time(t):
    return M.split_by_time(t("sales"), "order_date").groupBy("is_test").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("order_date").cast("date").cast("string").alias("first_day"),
        F.max("order_date").cast("date").cast("string").alias("last_day"),
    )


@query(
    "ml_folds_repeated",
    """
WITH r AS (
  SELECT l_returnflag AS flag, row_number() OVER (PARTITION BY l_returnflag) - 1 AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem
)
SELECT flag, CAST((5 * k > n - 1) AS INT) + CAST((5 * k > 2 * (n - 1)) AS INT) + CAST((5 * k > 3 * (n - 1)) AS INT)
         + CAST((5 * k > 4 * (n - 1)) AS INT) AS fold, count(*) AS n
FROM r GROUP BY 1, 2
""",
)
def ml_folds_repeated(t):
    """Rows with six distinct values still come in equal shares."""
    rows = t("lineitem").select(F.col("l_returnflag").alias("flag"), "l_linestatus")
    return M.with_folds(rows, 5, "flag").groupBy("flag", "fold").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ml_split_tied",
    """
WITH r AS (
  SELECT o_orderdate >= DATE '1998-01-01' AS late, row_number() OVER (ORDER BY o_orderdate >= DATE '1998-01-01') - 1 AS k, count(*) OVER () AS n
  FROM orders
)
SELECT k >= floor(n * 0.8) AS is_test, count(*) AS n, count(*) FILTER (WHERE late) AS late_rows FROM r GROUP BY 1
""",
)
def ml_split_tied(t):
    """Only two moments in time: the cut shares out the rows tied at it."""
    late = F.col("o_orderdate") >= F.lit("1998-01-01").cast("date")
    rows = t("orders").select(late.alias("late"), F.when(late, "1998-01-01").otherwise("1997-01-01").alias("day"))
    return M.split_by_time(rows, "day").groupBy("is_test").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("late").alias("late_rows")
    )


def _measured(trained: M.Trained):
    return S.metric_table(trained.predictions, trained.metrics)


def _train(t, algorithm: str, **kw):
    return M.train_model(
        t("outcomes"), "outcome", "binary_classification", algorithm, **{"folds": 0, "repeats": 0, **kw})


@query("ml_logistic")
def ml_logistic(t):
    return _measured(_train(t, "logistic_regression"))


@query("ml_forest")
def ml_forest(t):
    return _measured(_train(t, "random_forest"))


@query("ml_boosting")
def ml_boosting(t):
    return _measured(_train(t, "gradient_boosting"))


@query("ml_linear_svc")
def ml_linear_svc(t):
    return _measured(_train(t, "svm"))


def _shipments(t):
    return t("lineitem").select("l_quantity", "l_discount", "l_tax", "l_linenumber", "l_returnflag", "l_linestatus", "l_extendedprice")


@query("ml_ridge")
def ml_ridge(t):
    return _measured(M.train_model(_shipments(t), "l_extendedprice", "regression", "ridge", folds=0, repeats=0))


@query(
    "ml_ridge_line",
    """
WITH m AS (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS s, avg(l_extendedprice) AS c, count(*) AS n FROM lineitem),
w AS (SELECT sum((l_quantity - a) / s * (l_extendedprice - c)) / (max(n) + 1) AS w FROM lineitem, m)
SELECT l_quantity, round(max(c) + max(w) * (l_quantity - max(a)) / max(s), 3) AS prediction, count(*) AS n
FROM lineitem, m, w GROUP BY l_quantity
""",
)
def ml_ridge_line(t):
    """Ridge on one standardised field, fitted on all rows, where the solution is a formula."""
    rows, _ = M.prepare(t("lineitem").select("l_quantity", "l_extendedprice"), "l_extendedprice", False)
    fitted = M.fit(rows, M.Fields(["l_quantity"], [], []), "ridge", False, [])
    scored = fitted.score(rows, ["l_quantity"])
    return scored.groupBy("l_quantity").agg(
        F.round(F.max("prediction"), 3).alias("prediction"), F.count(F.lit(1)).alias("n"))


# Metrics are checked on predictions that a rule makes from the tables, so that SQL can state the answer.
_RULE = """
p AS (SELECT CASE WHEN outcome = 'yes' THEN 1.0 ELSE 0.0 END AS label,
             CASE WHEN n_chars >= 1000 OR toxic = 0 THEN 1.0 ELSE 0.0 END AS prediction,
             CAST(floor(n_chars / 100) AS DOUBLE) AS score FROM outcomes)
"""


def _rule(t):
    return t("outcomes").selectExpr(
        "CASE WHEN outcome = 'yes' THEN 1.0D ELSE 0.0D END AS label",
        "CASE WHEN n_chars >= 1000 OR toxic = 0 THEN 1.0D ELSE 0.0D END AS prediction",
        "CAST(floor(n_chars / 100) AS DOUBLE) AS score",
    )


_CURVE = _RULE + """,
s AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM p GROUP BY score),
c AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(neg) OVER (ORDER BY score DESC) AS cn,
             sum(pos) OVER () AS tp, sum(neg) OVER () AS tn FROM s)
"""


@query(
    "ml_metrics_class",
    "WITH " + _CURVE + """,
k AS (SELECT sum(label * prediction) AS hit, sum(label) AS actual, sum(prediction) AS called, count(*) AS n,
             sum(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS right_n FROM p)
SELECT 'accuracy' AS metric, CAST(round(right_n / n, 6) AS DOUBLE) AS value FROM k UNION ALL SELECT 'precision', round(hit / called, 6) FROM k
UNION ALL SELECT 'recall', round(hit / actual, 6) FROM k
UNION ALL SELECT 'f1', round(2 * hit / (actual + called), 6) FROM k
UNION ALL SELECT 'roc_auc', round(sum(neg * (cp - pos / 2.0)) / (max(tp) * max(tn)), 6) FROM c
UNION ALL SELECT 'pr_auc', round(sum(pos * cp / (cp + cn)) / max(tp), 6) FROM c
""",
    _OUT,
)
def ml_metrics_class(t):
    rule = _rule(t)
    return rounded(S.metric_table(rule, S.classification_metrics(rule, 2)))


@query(
    "ml_roc",
    "WITH " + _CURVE + "SELECT score AS threshold, round(cn / tn, 6) AS fpr, round(cp / tp, 6) AS tpr FROM c", _OUT,
)
def ml_roc(t):
    return rounded(S.roc_curve(_rule(t).select(F.col("label").cast("int").alias("positive"), "score")))


@query("ml_confusion", "WITH " + _RULE + "SELECT label, prediction, count(*) AS n FROM p GROUP BY label, prediction", _OUT)
def ml_confusion(t):
    return S.confusion_matrix(_rule(t)).select(
        F.col("label"), F.col("prediction"), "n"
    )


@query(
    "ml_metrics_reg",
    """
WITH p AS (SELECT l_extendedprice AS y, l_quantity * 2000 AS e FROM lineitem),
m AS (SELECT avg(abs(e - y)) AS mae, avg((e - y) * (e - y)) AS mse, var_pop(y) AS v FROM p)
SELECT 'mae' AS metric, round(mae, 3) AS value FROM m UNION ALL SELECT 'mse', round(mse, 0) FROM m
UNION ALL SELECT 'rmse', round(sqrt(mse), 3) FROM m UNION ALL SELECT 'r2', round(1 - mse / v, 3) FROM m
""",
)
def ml_metrics_reg(t):
    rows = t("lineitem").select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 2000).alias("prediction"))
    digits = F.when(F.col("metric") == "mse", F.round("value", 0)).otherwise(F.round("value", 3))
    return S.metric_table(rows, S.regression_metrics(rows)).select("metric", digits.alias("value"))


@query("ml_cv")
def ml_cv(t):
    trained = _train(t, "logistic_regression", folds=M.FOLDS)
    rows = [(k, i, v) for k, r in trained.cross_validation.items() for i, v in enumerate(r["folds"])]
    return local_table(t.spark, rows, "metric string, fold int, value double")


@query("ml_importance")
def ml_importance(t):
    return _train(t, "logistic_regression", repeats=M.REPEATS).importance


@query("ml_compare")
def ml_compare(t):
    """Two experiments stored, read back and compared."""
    folder = scratch_folder(t.spark)
    for algorithm in ("logistic_regression", "svm"):
        M.save_experiment(_train(t, algorithm), folder, "outcomes")
    return M.compare_models(t.spark.read.parquet(f"{folder}/experiments")).drop("best_experiment_id")


@query("ml_train_all")
def ml_train_all(t):
    """Every recommended candidate, then all their metrics."""
    trained = M.train_recommended(t("outcomes"), "outcome", "binary_classification", folds=0, repeats=0)
    rows = [(x.algorithm, k, v) for x in trained for k, v in x.metrics.items()]
    return local_table(t.spark, rows, "algorithm string, metric string, value double")


# Where one field tells the classes apart, every measure of a working model is known: SQL states it.
_TWO_SIDES = "SELECT count(*) AS n, count(DISTINCT c_nationkey >= 13) AS sides FROM customer"


def _sides(t, *more: str):
    """Customers, to be told apart by their nation's number alone."""
    return t("customer").select(
        "c_nationkey", *more, F.when(F.col("c_nationkey") >= 13, "yes").otherwise("no").alias("east")
    )


def _perfect(names: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{name}'" for name in names)
    return f"SELECT unnest([{listed}]) AS metric, CAST(sides / 2 AS DOUBLE) AS value FROM ({_TWO_SIDES}) x"


_SIX = _perfect(("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc"))


def _separated(t, algorithm: str):
    return _measured(M.train_model(_sides(t), "east", "binary_classification", algorithm, folds=0, repeats=0))


@query("ml_logistic_known", _SIX)
def ml_logistic_known(t):
    return _separated(t, "logistic_regression")


@query("ml_forest_known", _SIX)
def ml_forest_known(t):
    return _separated(t, "random_forest")


@query("ml_boosting_known", _SIX)
def ml_boosting_known(t):
    return _separated(t, "gradient_boosting")


@query("ml_linear_svc_known", _SIX)
def ml_linear_svc_known(t):
    return _separated(t, "svm")


@query(
    "ml_cv_known",
    f"SELECT m.metric, f.fold, m.value FROM ({_perfect(('accuracy', 'f1', 'roc_auc'))}) m CROSS JOIN (SELECT unnest(range(5))::INTEGER AS fold) f",
)
def ml_cv_known(t):
    trained = M.train_model(_sides(t), "east", "binary_classification", "logistic_regression", repeats=0)
    rows = [(k, i, float(v)) for k, r in trained.cross_validation.items() for i, v in enumerate(r["folds"])]
    return local_table(t.spark, rows, "metric string, fold int, value double")


@query(
    "ml_importance_known",
    f"SELECT unnest(['c_nationkey', 'c_acctbal', 'c_mktsegment']) AS feature, unnest([sides = 2, sides <> 2, sides <> 2]) AS helps FROM ({_TWO_SIDES}) x",
)
def ml_importance_known(t):
    """Shuffling the telling field costs score; the others cost exactly nothing, as no tree needs them."""
    rows = _sides(t, "c_acctbal", "c_mktsegment")
    trained = M.train_model(rows, "east", "binary_classification", "gradient_boosting", folds=0)
    return trained.importance.select("feature", (F.col("importance") > 0).alias("helps"))


@query(
    "ml_compare_known",
    f"SELECT CAST(sides AS BIGINT) AS models, 'f1' AS primary_metric, 'logistic_regression' AS best_algorithm, CAST(sides / 2 AS DOUBLE) AS best_value FROM ({_TWO_SIDES}) x",
)
def ml_compare_known(t):
    """Of two saved experiments the one that saw the telling field wins."""
    folder = scratch_folder(t.spark)
    for rows, algorithm in ((_sides(t), "logistic_regression"), (_sides(t, "c_acctbal").drop("c_nationkey"), "gradient_boosting")):
        M.save_experiment(M.train_model(rows, "east", "binary_classification", algorithm, folds=0, repeats=0), folder, "customers")
    return M.compare_models(t.spark.read.parquet(f"{folder}/experiments")).drop("best_experiment_id")


@query(
    "ml_train_all_known",
    f"SELECT a.algorithm, m.metric, m.value FROM ({_SIX}) m CROSS JOIN "
    "(SELECT unnest(['logistic_regression', 'random_forest', 'gradient_boosting', 'svm']) AS algorithm) a",
)
def ml_train_all_known(t):
    trained = M.train_recommended(_sides(t), "east", "binary_classification", folds=0, repeats=0)
    return local_table(t.spark, [(x.algorithm, k, v) for x in trained for k, v in x.metrics.items()], "algorithm string, metric string, value double")


@query(
    "ml_roc_corners",
    "WITH " + _CURVE + """,
d AS (SELECT *, lead(pos) OVER (ORDER BY score DESC) AS next_pos, lead(neg) OVER (ORDER BY score DESC) AS next_neg FROM c)
SELECT score AS threshold, round(cn / tn, 6) AS fpr, round(cp / tp, 6) AS tpr FROM d WHERE next_pos IS NULL OR pos * next_neg <> neg * next_pos
""",
    _OUT,
)
def ml_roc_corners(t):
    return rounded(S.roc_corners(_rule(t).select(F.col("label").cast("int").alias("positive"), "score")))
