"""Supervised models on Spark ML: problem type, candidates, preprocessing, splits, training, comparison."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import (
    FeatureHasher,
    OneHotEncoder,
    SQLTransformer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    as_timestamp,
    col,
    is_nested,
    is_numeric,
    measure,
    numeric_columns,
    require_columns,
)
from ..functions.roles import leakage_columns
from ..session import checkpointed, local_table
from .frequencies import value_counts
from .metrics import (
    classification_metrics,
    confusion_matrix,
    confusion_scores,
    regression_metrics,
    roc_corners,
    roc_curve,
    weighted_ovr_auc,
)
from .ranks import exact_quantiles, running_totals, values_at_ranks

SEED = 42
FOLDS = 5
REPEATS = 5
#: The deepest trees that Spark ML grows.
TREE_DEPTH = 30
RARE = "__rare__"
#: Levels of a column that the driver holds, and features that stand for the levels of a column with more.
MOST_LEVELS, HASHED = 100_000, 1 << 18
#: Rows of a task of training: at least the first where that occupies the cluster, at most the second.
ROWS_PER_TASK = (2_000, 50_000)


# -- choosing -------------------------------------------------------------------------------------
def class_counts(df: DataFrame, target: str) -> DataFrame:
    return df.where(col(target).isNotNull()).groupBy(col(target).cast("string").alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )


def identify_problem(df: DataFrame, target: str, objective: str | None = None) -> DataFrame:
    """One row: task type, labelled rows and number of classes."""
    require_columns(df, [target])
    row = class_counts(df, target).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes")).first()
    rows, classes = row["rows"] or 0, row["classes"]
    if classes < 2:
        raise ValueError("the target has fewer than two values")
    if objective:
        task = objective
    elif not is_numeric(df.schema[target]) or classes <= 2:
        task = "binary_classification" if classes == 2 else "multiclass_classification"
    elif classes <= 20 and classes < 0.05 * rows:
        task = "multiclass_classification"
    else:
        task = "regression"
    return local_table(df.sparkSession, [(target, task, rows, classes)], "target string, task_type string, rows long, classes long"
    )


def recommend_models(
    df: DataFrame, target: str, task: str, interpretability: bool = False,
    svm_rows: int | None = None, svm_columns: int | None = None,
) -> DataFrame:
    """(position, algorithm, primary_metric, imbalance_ratio) of the candidates to train.

    The SVM is linear and is offered at any size; ``svm_rows`` and ``svm_columns`` can bound it.
    """
    require_columns(df, [target])
    imbalance = None
    if "classification" in task:
        row = class_counts(df, target).agg((F.min("n") / F.max("n")).alias("ratio")).first()
        imbalance = row["ratio"] if row["ratio"] is not None else 1.0
        picks = [
            ("logistic_regression", "f1" if imbalance < 0.5 else "roc_auc"),
            ("random_forest", "f1"),
            ("gradient_boosting", "roc_auc"),
        ]
        few_rows = svm_rows is None or df.count() < svm_rows
        if few_rows and (svm_columns is None or len(df.columns) - 1 < svm_columns):
            picks.append(("svm", "f1"))
    else:
        picks = [("ridge", "rmse"), ("random_forest", "rmse"), ("gradient_boosting", "rmse")]
    picks = picks[: 2 if interpretability else 4]
    return local_table(df.sparkSession, [(i, a, m, imbalance) for i, (a, m) in enumerate(picks, start=1)],
        "position int, algorithm string, primary_metric string, imbalance_ratio double",
    )


# -- splitting ------------------------------------------------------------------------------------
def _numbered(df: DataFrame) -> DataFrame:
    """``df`` with a row number of its own for every row, identical ones too, fixed by a checkpoint."""
    return checkpointed(df.withColumn("_row", F.monotonically_increasing_id()))


def _row_hash(seed: int) -> Column:
    """53 random-looking bits per numbered row, exact as a double."""
    return F.shiftright(F.xxhash64("_row", F.lit(seed)), 11).cast("double")


def with_folds(df: DataFrame, folds: int = FOLDS, label: str | None = None, seed: int = SEED) -> DataFrame:
    """Add ``fold`` (0 .. folds-1): equal shares of each class, or of all rows without a label.

    Cut points are exact quantiles of a hash of row numbers within each class, so identical rows are
    shared out like any others; assigning a row needs no shuffle.
    """
    df = _numbered(df)
    return df.withColumn("fold", _fold_of(df, folds, label, seed)).drop("_row")


def _fold_of(numbered: DataFrame, folds: int, label: str | None, seed: int) -> Column:
    """The fold of a numbered row, as an expression of its number and class."""
    hashed = _row_hash(seed)
    if label is None:
        parts = {"all": F.lit(True)}
    else:
        values = _class_labels(numbered, label)
        parts = {v: col(label).cast("string") == F.lit(v) for v in values}
    probs = [i / folds for i in range(1, folds)]
    cuts = exact_quantiles(numbered, {k: F.when(c, hashed) for k, c in parts.items()}, probs)
    fold = None
    for k, condition in parts.items():
        number = F.lit(0)
        for p in probs:
            number = number + (hashed > F.lit(cuts[k][p])).cast("int")
        fold = F.when(condition, number) if fold is None else fold.when(condition, number)
    return fold


def _class_labels(df: DataFrame, label: str) -> list[str]:
    return sorted(r["label"] for r in class_counts(df, label).select("label").collect())


def split_by_time(df: DataFrame, time_column: str, share: float = 0.8) -> DataFrame:
    """Add ``is_test``, false for exactly the first ``int(share * rows)`` rows in order of time.

    Rows at the very cut moment are shared out by a hash of their row numbers; rows without a time come last.
    """
    require_columns(df, [time_column])
    df = _numbered(df)
    return df.withColumn("is_test", _late(df, time_column, share)).drop("_row")


def _late(numbered: DataFrame, time_column: str, share: float) -> Column:
    """Is a numbered row behind the cut in time?"""
    micros = F.unix_micros(as_timestamp(numbered, time_column).cast("timestamp")).cast("double")
    cut = int(numbered.count() * share)
    at = values_at_ranks(numbered, micros, [cut])[cut]
    earlier, tied = (micros.isNotNull(), micros.isNull()) if at is None else (micros < F.lit(at), micros == F.lit(at))
    short = cut - numbered.where(earlier).count()
    order = _row_hash(SEED)
    bound = values_at_ranks(numbered.where(tied), order, [short])[short]
    early = earlier | tied if bound is None else earlier | (tied & (order < F.lit(bound)))
    return ~F.coalesce(early, F.lit(False))


# -- preprocessing --------------------------------------------------------------------------------
@dataclass
class Fields:
    numeric: list[str]
    categorical: list[str]
    excluded: list[str]

    @property
    def all(self) -> list[str]:
        return self.numeric + self.categorical


def model_fields(df: DataFrame, target: str, descriptions: dict[str, str] | None = None) -> Fields:
    excluded = leakage_columns(df.columns, descriptions)
    numeric = [c for c in numeric_columns(df) if c != target and c not in excluded]
    other = [
        f.name for f in df.schema.fields
        if f.name not in numeric and f.name != target and f.name not in excluded and not is_nested(f)
    ]
    return Fields(numeric, other, excluded)


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def fit_preprocessing(train: DataFrame, fields: Fields) -> list:
    """Pipeline stages with medians, means, deviations, modes and levels fitted on ``train``.

    Numeric: median for missing or not finite, then standardised.  Categorical: mode for missing, one-hot over
    the levels seen at least twice, the others merged into one.  The driver holds at most ``MOST_LEVELS`` levels of a column; the levels of a column
    with more are features by a hash, ``HASHED`` of them, and never leave the executors.  A column whose levels are all unique teaches nothing
    and is left out.
    """
    select, stages, parts, blocks = [], [], [], []
    if fields.numeric:
        values = {c: measure(train, c).cast("double") for c in fields.numeric}
        medians = exact_quantiles(train, values, [0.5])
        fill = {c: medians[c][0.5] if medians[c][0.5] is not None else 0.0 for c in fields.numeric}
        filled = {c: F.coalesce(values[c], F.lit(fill[c])) for c in fields.numeric}
        row = train.agg(*[
            f(filled[c]).alias(f"{n}{i}")
            for i, c in enumerate(fields.numeric) for n, f in (("m", F.avg), ("s", F.stddev_pop))
        ]).first()
        for i, c in enumerate(fields.numeric):
            centre, spread = row[f"m{i}"], row[f"s{i}"] or 1.0
            number = f"cast({_name(c)} as double)"
            source = f"CASE WHEN abs({number}) < double('infinity') THEN {number} END"
            select.append(f"(coalesce({source}, {fill[c]!r}D) - {centre!r}D) / {spread!r}D AS _n{i}")
            parts.append(f"_n{i}")

    encoded = []
    if fields.categorical:
        counts = value_counts(train, fields.categorical).where("value IS NOT NULL")
        modes = {
            r["column_name"]: r["value"]
            for r in counts.groupBy("column_name").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("value")).collect()
        }
        sizes = {
            r["column_name"]: (r["levels"], r["rare"])
            for r in counts.groupBy("column_name").agg(
                F.count_if(F.col("n") > 1).alias("levels"), F.count_if(F.col("n") == 1).alias("rare")
            ).collect()
        }
        hashed = [c for c in fields.categorical if sizes.get(c, (0, 0))[0] > MOST_LEVELS]
        levels: dict[str, list[str]] = {c: [] for c in fields.categorical}
        for r in counts.where((F.col("n") > 1) & ~F.col("column_name").isin(*hashed)).collect():
            levels[r["column_name"]].append(r["value"])
        for j, c in enumerate(fields.categorical):
            text = f"coalesce(cast({_name(c)} as string), {_quote(modes.get(c, RARE))})"
            if not levels[c] and c not in hashed:
                continue  # every value is unique: nothing to learn from a level
            select.append(f"{text} AS _c{j}")
            if c in hashed:
                stages.append(FeatureHasher(inputCols=[f"_c{j}"], outputCol=f"_o{j}", numFeatures=HASHED))
                blocks.append(f"_o{j}")
                continue
            blocks.append(f"_o{j}")
            stages.append(StringIndexerModel.from_labels(
                sorted(levels[c]), inputCol=f"_c{j}", outputCol=f"_i{j}", handleInvalid="keep"))
            encoded.append((j, sizes[c][1] > 0))
    result = [SQLTransformer(statement=f"SELECT *, {', '.join(select)} FROM __THIS__")] if select else []
    result += stages
    for j, keep_rest in encoded:
        # The last index collects everything outside the dictionary: a column of its own when the
        # training data had such levels, all zeros otherwise.
        result.append(OneHotEncoder(inputCols=[f"_i{j}"], outputCols=[f"_o{j}"], dropLast=not keep_rest))
    parts += blocks
    if not parts:
        raise ValueError("No usable feature columns")
    result.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return result


def preprocessing_of(train: DataFrame, fields: Fields) -> PipelineModel:
    return Pipeline(stages=fit_preprocessing(train, fields)).fit(train)


# -- training -------------------------------------------------------------------------------------
def _estimator(algorithm: str, classification: bool, classes: int, rows: int, label_spread: float):
    """The Spark ML estimator for an algorithm name, with the fixed settings of the workflow."""
    weight = {"weightCol": "weight"}
    if algorithm == "logistic_regression" and classification:
        return LogisticRegression(maxIter=1000, regParam=1.0 / rows, standardization=False, **weight)
    if algorithm == "random_forest":
        # Rows remember their nodes, so that a pass neither carries all trees nor walks down them; the trees are the same.
        settings = {"numTrees": 120, "maxDepth": TREE_DEPTH, "seed": SEED, "cacheNodeIds": True, "checkpointInterval": 50}
        if classification:
            return RandomForestClassifier(**settings, **weight)
        return RandomForestRegressor(**settings)
    if algorithm == "gradient_boosting":
        settings = {"maxIter": 100, "stepSize": 0.1, "maxDepth": 3, "seed": SEED}
        if not classification:
            return GBTRegressor(**settings)
        return GBTClassifier(**settings) if classes == 2 else OneVsRest(classifier=GBTClassifier(**settings))
    if algorithm == "svm" and classification:
        model = LinearSVC(maxIter=100, regParam=1.0 / rows, standardization=False, **weight)
        return model if classes == 2 else OneVsRest(classifier=model, **weight)
    if algorithm == "ridge" and not classification:
        # Spark scales the penalty by the label's deviation; undo that to penalise by exactly 1.
        return LinearRegression(
            elasticNetParam=0.0, regParam=label_spread / rows, standardization=False
        )
    raise ValueError(f"unknown algorithm: {algorithm}")


@dataclass
class Fitted:
    """A fitted pipeline with what is needed to score rows."""

    model: PipelineModel
    classification: bool
    classes: list[str]

    def score(self, rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """(keep..., label, prediction[, score, scores])."""
        out = self.model.transform(rows)
        columns = [*[col(c) for c in keep], F.col("label"), F.col("prediction")]
        if self.classification:
            source = "probability" if "probability" in out.columns else "rawPrediction"
            if source in out.columns:
                scores = vector_to_array(F.col(source))
                columns.append(scores.alias("scores"))
                if len(self.classes) == 2:
                    columns.append(scores[1].alias("score"))
        return out.select(*columns)


def prepare(df: DataFrame, target: str, classification: bool) -> tuple[DataFrame, list[str]]:
    """Rows with a target, plus ``label``: the number, or the index among the sorted class texts."""
    known = df.where(col(target).isNotNull())
    if not classification:
        return known.withColumn("label", measure(df, target).cast("double")), []
    classes = _class_labels(known, target)
    if len(classes) < 2:
        raise ValueError("the target has fewer than two values")
    index = F.create_map(*[F.lit(v) for i, c in enumerate(classes) for v in (c, float(i))])
    return known.withColumn("label", index[col(target).cast("string")]), classes


def fit(
    train: DataFrame, fields: Fields, algorithm: str, classification: bool, classes: list[str], preprocessing: PipelineModel | None = None
) -> Fitted:
    """Fit an algorithm, and the preprocessing unless one fitted on the same rows is given."""
    if classification:
        counts = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        rows, spread = sum(counts.values()), 1.0
        balance = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, rows / (len(counts) * n))])
        train = train.withColumn("weight", balance[F.col("label")])
    else:
        row = train.agg(F.count("label").alias("n"), F.stddev_pop("label").alias("s")).first()
        rows, spread = row["n"], row["s"] or 1.0
    estimator = _estimator(algorithm, classification, len(classes), rows, spread)
    preprocessing = preprocessing or preprocessing_of(train, fields)
    model = estimator.fit(preprocessing.transform(train))
    return Fitted(PipelineModel([*preprocessing.stages, model]), classification, classes)


def evaluate(predictions: DataFrame, classification: bool, classes: int) -> dict[str, float]:
    return classification_metrics(predictions, classes) if classification else regression_metrics(predictions)


@dataclass
class Trained:
    experiment_id: str
    algorithm: str
    task_type: str
    target: str
    metrics: dict[str, float]
    cross_validation: dict[str, dict]
    split: dict
    fields: Fields
    fitted: Fitted
    predictions: DataFrame
    importance: DataFrame | None
    duration_ms: float
    confusion: DataFrame | None = None
    roc: DataFrame | None = None
    parameters: dict = field(default_factory=dict)


@dataclass
class Prepared:
    """One checkpointed table that all candidates and folds read, and the preprocessing of each split, fitted once.

    ``rows`` holds the features, the target and ``label``, ``_test`` (is the row held out?) and ``_fold`` (its fold in the
    cross-validation, which covers all rows).
    """

    rows: DataFrame
    task_type: str
    target: str
    classes: list[str]
    fields: Fields
    split: dict
    folds: int
    fitted: dict[int | None, PipelineModel] = field(default_factory=dict)

    @property
    def classification(self) -> bool:
        return "classification" in self.task_type

    def train(self, fold: int | None = None) -> DataFrame:
        return self.rows.where(~F.col("_test")) if fold is None else self.rows.where(F.col("_fold") != fold)

    def held_out(self, fold: int | None = None) -> DataFrame:
        return self.rows.where("_test") if fold is None else self.rows.where(F.col("_fold") == fold)

    def fit(self, algorithm: str, fold: int | None = None) -> Fitted:
        if fold not in self.fitted:
            self.fitted[fold] = preprocessing_of(self.train(fold), self.fields)
        return fit(self.train(fold), self.fields, algorithm, self.classification, self.classes, self.fitted[fold])


def prepare_splits(
    df: DataFrame, target: str, task_type: str, time_column: str | None = None, descriptions: dict[str, str] | None = None, folds: int = FOLDS,
) -> Prepared:
    """Number the rows with a target once, and fix the hold-out split and the folds as expressions of those numbers."""
    require_columns(df, [target])
    classification = "classification" in task_type
    rows, classes = prepare(df, target, classification)
    fields = model_fields(df, target, descriptions)
    chronological = bool(time_column) and time_column in df.columns
    used = dict.fromkeys([*fields.all, target, *([time_column] if chronological else [])])
    numbered = _numbered(rows.select(*[col(c) for c in used if c != "label"], "label"))
    label = target if classification else None
    if chronological:
        test, strategy = _late(numbered, time_column, 0.8), "chronological"
    else:
        test, strategy = _fold_of(numbered, FOLDS, label, SEED) == 0, "stratified_random" if classification else "random"
    # The folds of the cross-validation use another seed than those of the hold-out split.
    fold = _fold_of(numbered, folds, label, SEED + 1) if folds else F.lit(None).cast("int")
    parted = numbered.select("*", test.alias("_test"), fold.alias("_fold"))
    sizes = parted.groupBy(F.spark_partition_id()).agg(F.count_if(~F.col("_test")).alias("train"), F.count_if("_test").alias("test")).agg(
        F.sum("train").alias("train"), F.sum("test").alias("test"), F.max(F.col("train") + F.col("test")).alias("largest")
    ).first()
    known = (sizes["train"] or 0) + (sizes["test"] or 0)
    least, most = ROWS_PER_TASK
    tasks = max(min(numbered.sparkSession.sparkContext.defaultParallelism, known // least), -(-known // most), 1)
    if (sizes["largest"] or 0) > 2 * -(-known // tasks):
        # Every pass of training takes as long as its largest task, and a file of few bytes is one task, however many rows it holds.
        parted = checkpointed(parted.repartition(tasks, "_row"))
    parted = parted.drop("_row")
    split = {"train": sizes["train"] or 0, "test": sizes["test"] or 0, "strategy": strategy}
    return Prepared(parted, task_type, target, classes, fields, split, folds)


def train_model(
    df: DataFrame,
    target: str,
    task_type: str,
    algorithm: str,
    time_column: str | None = None,
    descriptions: dict[str, str] | None = None,
    folds: int = FOLDS,
    repeats: int = REPEATS,
) -> Trained:
    """Fit on 80 % of the rows, measure on the rest, cross-validate, and rank the features."""
    return train_prepared(prepare_splits(df, target, task_type, time_column, descriptions, folds), algorithm, repeats)


def train_prepared(prepared: Prepared, algorithm: str, repeats: int = REPEATS) -> Trained:
    """``train_model`` for one candidate of a prepared table."""
    started = time.perf_counter()
    classification, classes, test = prepared.classification, prepared.classes, prepared.held_out()
    fitted = prepared.fit(algorithm)
    predictions = fitted.score(test)
    metrics = evaluate(predictions, classification, len(classes))
    cv = cross_validate(prepared, algorithm) if prepared.folds else {}
    importance = permutation_importance(fitted, test, prepared.fields, repeats) if repeats else None
    two = classification and len(classes) == 2 and "score" in predictions.columns
    return Trained(
        experiment_id=str(uuid.uuid4()),
        algorithm=algorithm,
        task_type=prepared.task_type,
        target=prepared.target,
        metrics={k: None if v is None else round(float(v), 6) for k, v in metrics.items()},
        cross_validation=cv,
        split=dict(prepared.split),
        fields=prepared.fields,
        fitted=fitted,
        predictions=predictions,
        importance=importance,
        duration_ms=(time.perf_counter() - started) * 1000,
        confusion=confusion_matrix(predictions) if classification else None,
        roc=roc_curve(predictions.select((F.col("label") == 1).cast("int").alias("positive"), "score")) if two else None,
        parameters={p.name: str(v) for p, v in fitted.model.stages[-1].extractParamMap().items()},
    )


def cross_validate(prepared: Prepared, algorithm: str) -> dict[str, dict]:
    """Metric -> mean, population deviation and the value of every fold."""
    values: dict[str, list[float]] = {}
    classification, classes = prepared.classification, len(prepared.classes)
    for k in range(prepared.folds):
        predictions = prepared.fit(algorithm, k).score(prepared.held_out(k))
        metrics = evaluate(predictions, classification, classes)
        wanted = ("accuracy", "f1", "roc_auc") if classification else ("mae", "rmse", "r2")
        if classification and classes > 2 and "scores" in predictions.columns:
            metrics["roc_auc"] = weighted_ovr_auc(predictions, classes)
        for name in wanted:
            if metrics.get(name) is not None:
                values.setdefault(name, []).append(float(metrics[name]))
    result = {}
    for name, found in values.items():
        centre = sum(found) / len(found)
        result[name] = {
            "mean": centre,
            "std": (sum((v - centre) ** 2 for v in found) / len(found)) ** 0.5,
            "folds": found,
        }
    return result


def permutation_importance(
    fitted: Fitted, test: DataFrame, fields: Fields, repeats: int = REPEATS, seed: int = SEED, limit: int = 20
) -> DataFrame:
    """(feature, importance, std): mean loss of score when one original column is shuffled.

    Every row is preprocessed once, up to the parts of its feature vector: one number or one-hot block for each original column.  Rows get a random
    order; repeat r takes the shuffled column's part from the row a random distance further on.  That is one equi-join on unique
    positions; vectors are assembled from parts, and all variants are scored in one pass.
    """
    spark = test.sparkSession
    stages = fitted.model.stages
    last = max(i for i, stage in enumerate(stages) if isinstance(stage, VectorAssembler))
    parts = stages[last].getInputCols()
    columns = {f"_n{i}": c for i, c in enumerate(fields.numeric)} | {f"_o{j}": c for j, c in enumerate(fields.categorical)}
    scorer = Fitted(PipelineModel(stages[last:]), fitted.classification, fitted.classes)
    made = PipelineModel(stages[:last]).transform(test)
    about = {p: made.schema[p].metadata for p in parts}
    numbered = checkpointed(made.select(*parts, "label", F.monotonically_increasing_id().alias("_id")))
    m = numbered.count()
    if m == 0:
        return local_table(spark, [], "feature string, importance double, std double")
    ordered = numbered.withColumn("_order", F.struct(F.xxhash64("_id", F.lit(seed)), "_id")).withColumn(
        "_one", F.lit(1).cast("long"))
    placed = running_totals(ordered, [], "_order", ["_one"]).withColumnRenamed("before__one", "_place")
    own = placed.select(*parts, "label", "_place")
    donors = own.select(F.col("_place").alias("_from"), F.struct(*parts).alias("_donor"))
    # Fixed, well spread distances; the row order itself is what is random.
    shifts = [1 + (seed * 7919 + r * 104_729) % max(m - 1, 1) for r in range(repeats)]
    choices = F.array(*[
        F.struct(F.lit(r).alias("r"), F.pmod(F.col("_place") + F.lit(s), F.lit(m)).alias("from"))
        for r, s in enumerate(shifts)
    ])
    paired = own.withColumn("_choice", F.explode(choices)).join(donors, F.col("_choice.from") == F.col("_from"))
    variants = paired.withColumn("_f", F.explode(F.array(*[F.lit(i) for i in range(len(parts))])))
    replaced = variants.select(
        *[
            F.when(F.col("_f") == i, F.col("_donor")[p]).otherwise(F.col(p)).alias(p, metadata=about[p])
            for i, p in enumerate(parts)
        ],
        "label", "_f", F.col("_choice.r").alias("_r"),
    )
    base = _importance_scores(scorer, numbered.withColumn("_f", F.lit(-1)).withColumn("_r", F.lit(0)))[(-1, 0)]
    shuffled = _importance_scores(scorer, replaced)
    # A column without a part teaches nothing, shuffled or not.
    rows = [(c, 0.0, 0.0) for c in fields.all if c not in {columns[p] for p in parts}]
    for i, p in enumerate(parts):
        losses = [base - shuffled[(i, r)] for r in range(repeats)]
        centre = sum(losses) / repeats
        rows.append((columns[p], centre, (sum((v - centre) ** 2 for v in losses) / repeats) ** 0.5))
    rows.sort(key=lambda x: (-x[1], x[0]))
    return local_table(spark, rows[:limit], "feature string, importance double, std double")


def _importance_scores(fitted: Fitted, rows: DataFrame) -> dict[tuple[int, int], float]:
    """Weighted F1, or minus RMSE, per (feature, repeat)."""
    scored = fitted.score(rows, ["_f", "_r"])
    if not fitted.classification:
        table = scored.groupBy("_f", "_r").agg(F.sqrt(F.avg((F.col("prediction") - F.col("label")) ** 2)).alias("e"))
        return {(r["_f"], r["_r"]): -r["e"] for r in table.collect()}
    cells: dict[tuple[int, int], dict] = {}
    for r in scored.groupBy("_f", "_r", "label", "prediction").agg(F.count(F.lit(1)).alias("n")).collect():
        cells.setdefault((r["_f"], r["_r"]), {})[(r["label"], r["prediction"])] = r["n"]
    return {k: confusion_scores(v, binary=False)["f1"] for k, v in cells.items()}


def train_recommended(
    df: DataFrame, target: str, task_type: str, time_column: str | None = None,
    descriptions: dict[str, str] | None = None, folds: int = FOLDS, repeats: int = REPEATS,
) -> list[Trained]:
    """Train every recommended candidate, all from one prepared table."""
    picks = recommend_models(df, target, task_type).orderBy("position").collect()
    prepared = prepare_splits(df, target, task_type, time_column, descriptions, folds)
    return [train_prepared(prepared, p["algorithm"], repeats) for p in picks]


# -- experiments ----------------------------------------------------------------------------------
EXPERIMENT_SCHEMA = T.StructType([
    T.StructField("experiment_id", T.StringType()),
    T.StructField("dataset", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("task_type", T.StringType()),
    T.StructField("algorithm", T.StringType()),
    T.StructField("parameters", T.StringType()),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("cross_validation", T.StringType()),
    T.StructField("split", T.StringType()),
    T.StructField("importance", T.ArrayType(T.StructType([
        T.StructField("feature", T.StringType()),
        T.StructField("importance", T.DoubleType()),
        T.StructField("std", T.DoubleType()),
    ]))),
    T.StructField("confusion", T.ArrayType(T.StructType([
        T.StructField("label", T.DoubleType()),
        T.StructField("prediction", T.DoubleType()),
        T.StructField("n", T.LongType()),
    ]))),
    T.StructField("model_path", T.StringType()),
    T.StructField("duration_ms", T.DoubleType()),
])


def _cells(confusion: DataFrame | None) -> list[tuple]:
    return [] if confusion is None else [tuple(r) for r in confusion.select("label", "prediction", "n").orderBy("label", "prediction").collect()]


def experiment_rows(spark, trained: Sequence[Trained], dataset: str = "", model_paths: Sequence[str] = ()) -> DataFrame:
    """Experiments as a table."""
    rows = []
    for i, t in enumerate(trained):
        importance = [tuple(r) for r in t.importance.collect()] if t.importance is not None else []
        rows.append((
            t.experiment_id, dataset, t.target, t.task_type, t.algorithm, json.dumps(t.parameters),
            t.metrics, json.dumps(t.cross_validation), json.dumps(t.split), importance, _cells(t.confusion),
            model_paths[i] if i < len(model_paths) else None, t.duration_ms,
        ))
    return spark.createDataFrame(rows, EXPERIMENT_SCHEMA)


def save_experiment(trained: Trained, folder: str, dataset: str = "") -> str:
    """Write the pipeline under ``folder/models`` and append a row to ``folder/experiments``.

    The corners of the ROC curve, which may be as many as the scores, go to ``folder/roc``.
    """
    spark = trained.predictions.sparkSession
    path = f"{folder.rstrip('/')}/models/{trained.experiment_id}"
    trained.fitted.model.write().save(path)
    row = experiment_rows(spark, [trained], dataset, [path])
    row.write.mode("append").parquet(f"{folder.rstrip('/')}/experiments")
    if trained.roc is not None:
        scored = trained.predictions.select((F.col("label") == 1).cast("int").alias("positive"), "score")
        corners = roc_corners(scored).select(F.lit(trained.experiment_id).alias("experiment_id"), "*")
        corners.write.mode("append").partitionBy("experiment_id").parquet(f"{folder.rstrip('/')}/roc")
    return path


def load_roc(spark, folder: str, experiment_id: str) -> DataFrame:
    """(threshold, fpr, tpr) of a saved experiment: the corners of its ROC curve, between which it is straight."""
    load_experiment(spark, folder, experiment_id)
    found = spark.read.parquet(f"{folder.rstrip('/')}/roc").where(F.col("experiment_id") == experiment_id)
    return found.select("threshold", "fpr", "tpr").orderBy(F.desc("threshold"))


def load_experiment(spark, folder: str, experiment_id: str) -> DataFrame:
    found = spark.read.parquet(f"{folder.rstrip('/')}/experiments").where(F.col("experiment_id") == experiment_id)
    if found.isEmpty():
        raise ValueError("no such experiment")
    return found


def comparison_table(experiments: DataFrame) -> DataFrame:
    """(experiment_id, algorithm, primary_metric, metrics) of every experiment, the best first; all of one kind of task."""
    classification = F.col("task_type").contains("classification")
    kinds = [r[0] for r in experiments.select(classification).distinct().limit(2).collect()]
    if len(kinds) > 1:
        raise ValueError("classification and regression have no common metric")
    name = "f1" if kinds == [True] else "rmse"
    value = F.col("metrics")[name]
    order = value.desc_nulls_last() if name == "f1" else value.asc_nulls_last()
    return experiments.orderBy(order, "algorithm", "experiment_id").select(
        "experiment_id", "algorithm", F.lit(name).alias("primary_metric"), "metrics"
    )


def compare_saved(spark, folder: str, experiment_ids: Sequence[str]) -> DataFrame:
    """``comparison_table`` of the saved experiments among the ids; ids without one are passed over."""
    saved = spark.read.parquet(f"{folder.rstrip('/')}/experiments").where(F.col("experiment_id").isin(*experiment_ids))
    if saved.isEmpty():
        raise ValueError("none of these experiments is saved")
    return comparison_table(saved)


def compare_models(experiments: DataFrame) -> DataFrame:
    """One row: the best experiment by F1 (highest) or RMSE (lowest); see ``comparison_table`` for all of them."""
    classification = F.col("task_type").contains("classification")
    value = F.when(classification, F.col("metrics")["f1"]).otherwise(F.col("metrics")["rmse"])
    badness = F.when(classification, -value).otherwise(value)
    order = F.struct(F.coalesce(badness, F.lit(float("inf"))), F.col("algorithm"))
    best = experiments.agg(
        F.count(F.lit(1)).alias("models"),
        F.min_by(F.when(classification, "f1").otherwise("rmse"), order).alias("primary_metric"),
        F.min_by("experiment_id", order).alias("best_experiment_id"),
        F.min_by("algorithm", order).alias("best_algorithm"),
        F.min_by(value, order).alias("best_value"),
    )
    if best.first()["models"] == 0:
        raise ValueError("No model results")
    return best
