"""Fit a model on the training rows, score it on the test rows."""

import math
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.operators.boosting import BINS, BoostedTrees
from assay.operators.metrics import clf_metrics, reg_metrics
from assay.operators.prepare import Prepared
from assay.operators.terms import BIGRAM_FEATURES, UNIGRAM_FEATURES, fit_tfidf
from assay.schemas import CLASS_TASKS, METRICS, TEXT_TASKS

# Trees, iterations and solver tolerance.
TREES = 300
LINEAR_ITERATIONS = 1000
TEXT_ITERATIONS = {1: 1000, 2: 500}
TOLERANCE = 1e-4
# Above 4096 features Spark solves least squares by iteration: as good as exact at this tolerance.
LINEAR_TOLERANCE = 1e-10
SEED = 42
# Public defaults of the two boosting libraries (depth, learning rate).
BOOSTING = {"xgboost": (6, 0.3), "lightgbm": (5, 0.1)}
# The deepest and finest trees that Spark's forest grows; the public default has no limit.
FOREST_DEPTH, FOREST_BINS = 30, 256

# Fewest rows worth a task of their own while a fit iterates.
FIT_ROWS = 100_000


@dataclass(frozen=True)
class Trained:
    """Model, scored test rows (label, prediction) and the metrics row."""

    model: PipelineModel
    predictions: DataFrame
    metrics: DataFrame

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)


def build_estimator(
    model_type: str,
    task: str,
    n_estimators: int = TREES,
    classes: int = 2,
    rows: int = 1,
    max_depth: int | None = None,
    max_bins: int | None = None,
) -> Estimator:
    """The estimator of a model type; unknown types and `auto` are boosted trees.

    `max_depth` and `max_bins` are those of trees; each model has its own defaults.
    """
    is_class = task in CLASS_TASKS
    if model_type == "random_forest":
        kind = RandomForestClassifier if is_class else RandomForestRegressor
        return kind(
            numTrees=n_estimators,
            maxDepth=FOREST_DEPTH if max_depth is None else max_depth,
            maxBins=max_bins or FOREST_BINS,
            featureSubsetStrategy="sqrt" if is_class else "all",
            seed=SEED,
        )
    if model_type in ("logistic_regression", "linear_regression"):
        if is_class:
            return logistic(rows, LINEAR_ITERATIONS)
        return LinearRegression(
            solver="auto", regParam=0.0, maxIter=LINEAR_ITERATIONS, tol=LINEAR_TOLERANCE
        )
    depth, rate = BOOSTING.get(model_type, BOOSTING["xgboost"])
    objective = ("logistic" if classes <= 2 else "softmax") if is_class else "squared"
    return BoostedTrees(
        objective, n_estimators, depth if max_depth is None else max_depth, rate, classes, bins=max_bins or BINS
    )


def logistic(rows: int, iterations: int) -> LogisticRegression:
    """Ridge strength 1 on the summed loss is 1/rows on Spark's mean loss."""
    return LogisticRegression(
        maxIter=iterations,
        tol=TOLERANCE,
        regParam=1.0 / max(rows, 1),
        elasticNetParam=0.0,
        standardization=False,
    )


def importances(model: Model, features: list[str]) -> dict[str, float] | None:
    """Weight per feature of a tree model, shares of 1; None for other models."""
    if hasattr(model, "featureImportances"):
        return dict(zip(features, model.featureImportances.toArray().tolist()))
    return None


def metrics_row(
    predictions: DataFrame, task: str, classes: int | None, importance: dict[str, float] | None
) -> DataFrame:
    """One row in the shape of METRICS; what a task does not measure is null."""
    if task in CLASS_TASKS or task == "nlp_classification":
        found = clf_metrics(predictions).drop("n_classes")
        if classes is not None:
            found = found.withColumn("n_classes", F.lit(classes))
    else:
        found = reg_metrics(predictions)
    weights = F.lit(None)
    if importance:
        weights = F.create_map(
            *(F.lit(x) for pair in importance.items() for x in pair)
        )
    found = found.withColumn("feature_importance", weights)
    return found.select(
        *(
            (F.col(f.name) if f.name in found.columns else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in METRICS
        )
    )


def _balance(train: DataFrame, rows: int) -> DataFrame:
    """Cached training rows in as many parts as the fit can use.

    Every iteration starts a task per part: a small table is merged, one that
    was read in too few parts is spread over the cores, a large one is kept.
    """
    have = train.rdd.getNumPartitions()
    want = max(1, math.ceil(rows / FIT_ROWS))
    if want < have:
        return train.coalesce(want)
    cores = min(want, train.sparkSession.sparkContext.defaultParallelism)
    return train.repartition(cores) if have < cores else train


def _index_labels(frame: DataFrame, target: str) -> StringIndexerModel:
    """Classes as 0..k-1 in text order, over the labels of all rows."""
    rows = frame.select(target).filter(F.col(target).isNotNull())
    indexer = StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc")
    return indexer.fit(rows)


def train_tabular(
    prepared: Prepared,
    task: str,
    model_type: str = "xgboost",
    n_estimators: int = TREES,
    max_depth: int | None = None,
    max_bins: int | None = None,
) -> Trained:
    """Fit on numeric features; rows are kept assembled while the fit iterates."""
    if not prepared.features:
        raise ValueError("no feature columns to train on")
    is_class = task in CLASS_TASKS
    assembler = VectorAssembler(inputCols=prepared.features, outputCol="features")
    stages = [assembler]
    classes = None
    if is_class:
        indexer = _index_labels(prepared.frame, prepared.target)
        classes = len(indexer.labels)
        stages.insert(0, indexer)
    before = PipelineModel(stages)

    def assembled(rows: DataFrame) -> DataFrame:
        rows = before.transform(rows)
        label = F.col("label") if is_class else F.col(prepared.target).cast("double")
        return rows.select("features", label.alias("label"))

    train = assembled(prepared.train).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = train.count()
        estimator = build_estimator(
            model_type, task, n_estimators, classes or 2, rows, max_depth, max_bins
        )
        model = estimator.fit(_balance(train, rows))
    finally:
        train.unpersist()
    scored = model.transform(assembled(prepared.test)).select("label", "prediction")
    weights = importances(model, prepared.features)
    return Trained(
        PipelineModel([*stages, model]), scored, metrics_row(scored, task, classes, weights)
    )


def train_text(
    frame: DataFrame,
    text: str,
    target: str,
    task: str = "nlp_classification",
    max_features: int | None = None,
    n_max: int = 1,
) -> Trained:
    """TF-IDF fitted on the training rows, then a linear model.

    `frame` holds the text, the target and `split`. A text regression is a real
    regression.
    """
    limit = max_features or (UNIGRAM_FEATURES if n_max == 1 else BIGRAM_FEATURES)
    is_class = task == "nlp_classification"
    classes = None
    labelled = frame.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    stages = []
    if is_class:
        indexer = _index_labels(labelled, target)
        classes = len(indexer.labels)
        stages.append(indexer)
        labelled = indexer.transform(labelled)
    else:
        labelled = labelled.withColumn("label", F.col(target).cast("double"))
    docs = labelled.select(text, "label", "split")
    train_docs = docs.filter(F.col("split") == "train")
    rows = train_docs.count()
    tfidf = fit_tfidf(train_docs, text, limit, n_max, rows)
    train = tfidf.transform(train_docs, text).select("features", "label")
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        train.count()
        if is_class:
            estimator = logistic(rows, TEXT_ITERATIONS[n_max])
        else:
            estimator = LinearRegression(
                solver="l-bfgs",
                maxIter=TEXT_ITERATIONS[n_max],
                tol=TOLERANCE,
                regParam=1.0 / max(rows, 1),
                standardization=False,
            )
        model = estimator.fit(_balance(train, rows))
    finally:
        train.unpersist()
    test = tfidf.transform(docs.filter(F.col("split") == "test"), text)
    scored = model.transform(test).select("label", "prediction")
    fitted = PipelineModel([*stages, *tfidf.pipeline(text).stages, model])
    return Trained(fitted, scored, metrics_row(scored, task, classes, None))


def train(
    prepared: Prepared,
    task: str,
    model_type: str = "auto",
    n_estimators: int = TREES,
    text: str | None = None,
) -> Trained:
    """Route by task: text tasks to the text model, `auto` to boosted trees."""
    if task == "clustering":
        raise ValueError("task 'clustering' has no verdict and cannot be trained")
    if task in TEXT_TASKS:
        names = [text] if text else [
            f.name
            for f in prepared.frame.schema
            if isinstance(f.dataType, T.StringType) and f.name in prepared.features
        ]
        if not names:
            raise ValueError("No text column found")
        return train_text(prepared.frame, names[0], prepared.target, task)
    return train_tabular(
        prepared, task, "xgboost" if model_type == "auto" else model_type, n_estimators
    )
