"""Model metrics over a table of predictions (label, prediction, score[, class])."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..session import checkpointed, local_table
from .ranks import running_totals


def confusion_matrix(predictions: DataFrame) -> DataFrame:
    """(label, prediction, n) for the combinations that occur."""
    return predictions.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def confusion_scores(cells: dict[tuple, float], binary: bool) -> dict[str, float]:
    """Accuracy, precision, recall and F1 from confusion counts.

    Two classes: scores of class 1.  More: averages weighted by class size.  0 where undefined.
    """
    n = sum(cells.values())
    labels = sorted({a for a, _ in cells} | {b for _, b in cells})
    per_class = {}
    for c in labels:
        hit = cells.get((c, c), 0)
        actual = sum(v for (a, _), v in cells.items() if a == c)
        called = sum(v for (_, b), v in cells.items() if b == c)
        precision = hit / called if called else 0.0
        recall = hit / actual if actual else 0.0
        f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
        per_class[c] = (actual, precision, recall, f1)
    if binary:
        _, precision, recall, f1 = per_class.get(1.0, (0, 0.0, 0.0, 0.0))
    else:
        precision, recall, f1 = (
            sum(v[0] * v[i] for v in per_class.values()) / n if n else 0.0 for i in (1, 2, 3)
        )
    accuracy = sum(v for (a, b), v in cells.items() if a == b) / n if n else 0.0
    return {"accuracy": accuracy, "precision": precision, "recall": recall, "f1": f1}


def score_steps(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score, highest first, with positives and negatives seen up to it.

    ``scored`` has ``positive`` (0/1) and ``score``.  Equal scores are one step, and steps are accumulated
    over range partitions, so no task sees all scores.
    """
    steps = scored.where("score IS NOT NULL").groupBy(*by, "score").agg(
        F.sum("positive").cast("long").alias("pos"), F.sum(1 - F.col("positive")).cast("long").alias("neg")
    )
    return running_totals(steps, by, "score", ["pos", "neg"], descending=True)


def ranking_scores(steps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC (ties count half) and average precision (step sum) from ``score_steps``."""
    pos_so_far = (F.col("before_pos") + F.col("pos")).cast("double")
    seen = pos_so_far + F.col("before_neg") + F.col("neg")
    areas = steps.groupBy(*by).agg(
        F.sum(F.col("neg") * (F.col("before_pos") + F.col("pos") / F.lit(2.0))).alias("area"),
        F.sum(F.col("pos") * pos_so_far / seen).alias("steps"),
        F.max("total_pos").cast("double").alias("p"),
        F.max("total_neg").cast("double").alias("n"),
    )
    return areas.select(
        *by,
        F.try_divide("area", F.col("p") * F.col("n")).alias("roc_auc"),
        F.try_divide("steps", F.col("p")).alias("pr_auc"),
        F.col("p").cast("long").alias("positives"),
    )


def roc_curve(scored: DataFrame) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score."""
    steps = score_steps(scored)
    return steps.select(
        F.col("score").alias("threshold"),
        F.try_divide((F.col("before_neg") + F.col("neg")).cast("double"), F.col("total_neg")).alias("fpr"),
        F.try_divide((F.col("before_pos") + F.col("pos")).cast("double"), F.col("total_pos")).alias("tpr"),
    )


def roc_corners(scored: DataFrame) -> DataFrame:
    """``roc_curve`` without the points on a straight line between their neighbours; the area under it stays the same.

    Steps are numbered, so that each meets the next one by an equi-join on unique numbers; a step followed by one of the same
    direction is left out.
    """
    steps = score_steps(scored).withColumn("_one", F.lit(1).cast("long"))
    placed = checkpointed(running_totals(
        steps.select("score", "pos", "neg", "_one", "before_pos", "before_neg", "total_pos", "total_neg"), [], "score", ["_one"], descending=True
    ))
    after = placed.select((F.col("before__one") - 1).alias("_at"), F.col("pos").alias("_pos"), F.col("neg").alias("_neg"))
    paired = placed.join(after, F.col("before__one") == F.col("_at"), "left")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    straight = wide("pos") * wide("_neg") == wide("neg") * wide("_pos")
    return paired.where(~F.coalesce(straight, F.lit(False))).select(
        F.col("score").alias("threshold"),
        F.try_divide((F.col("before_neg") + F.col("neg")).cast("double"), F.col("total_neg")).alias("fpr"),
        F.try_divide((F.col("before_pos") + F.col("pos")).cast("double"), F.col("total_pos")).alias("tpr"),
    )


def classification_metrics(predictions: DataFrame, classes: int) -> dict[str, float]:
    """Scores of a (label, prediction, score) table; ranking scores only for two classes with a score."""
    cells = {(r["label"], r["prediction"]): r["n"] for r in confusion_matrix(predictions).collect()}
    metrics = confusion_scores(cells, classes == 2)
    if classes == 2 and "score" in predictions.columns:
        scored = predictions.select((F.col("label") == 1).cast("int").alias("positive"), "score")
        row = ranking_scores(score_steps(scored)).first()
        metrics["roc_auc"], metrics["pr_auc"] = (row["roc_auc"], row["pr_auc"]) if row else (None, None)
    return metrics


def weighted_ovr_auc(predictions: DataFrame, classes: int) -> float | None:
    """Mean of the one-against-rest AUCs weighted by class size; needs a ``scores`` array."""
    long = predictions.select("label", F.posexplode("scores").alias("class", "score"))
    scored = long.select("class", (F.col("label") == F.col("class")).cast("int").alias("positive"), "score")
    rows = ranking_scores(score_steps(scored, ["class"]), ["class"]).where("roc_auc IS NOT NULL").collect()
    weight = sum(r["positives"] for r in rows)
    return sum(r["roc_auc"] * r["positives"] for r in rows) / weight if weight else None


def regression_metrics(predictions: DataFrame) -> dict[str, float]:
    """MAE, MSE, RMSE and R2 of a (label, prediction) table in one aggregate."""
    error = F.col("prediction") - F.col("label")
    row = predictions.agg(
        F.avg(F.abs(error)).alias("mae"), F.avg(error * error).alias("mse"), F.var_pop("label").alias("spread")
    ).first()
    mse = row["mse"]
    if mse is None:
        return {"mae": None, "mse": None, "rmse": None, "r2": None}
    return {
        "mae": row["mae"], "mse": mse, "rmse": math.sqrt(mse),
        "r2": 1 - mse / row["spread"] if row["spread"] else (1.0 if mse == 0 else 0.0),
    }


def metric_table(predictions: DataFrame, metrics: dict[str, float]) -> DataFrame:
    return local_table(predictions.sparkSession, [(k, None if v is None else float(v)) for k, v in metrics.items()], "metric string, value double"
    )
