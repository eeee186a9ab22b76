"""One experiment from plan to answer."""

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.operators.answers import evaluate, with_report
from assay.operators.columns import select_features, text_column
from assay.operators.prepare import Prepared, prepare
from assay.operators.train import TREES, Trained, train
from assay.schemas import METRICS, RUN_EVENT, TEXT_TASKS
from assay.sources.records import append_events, read_events

# Fixed value: metric columns that a run record merges.
NUMBERS = ["r2", "rmse", "accuracy", "f1", "n_classes"]


@dataclass(frozen=True)
class Plan:
    """What an experiment needs from its plan row."""

    id: str
    question: str
    hypothesis: str
    target_variable: str
    task_type: str
    feature_variables: list[str]
    model_type: str = "auto"
    #: Text tasks: the text to learn from; else the first string column among the features.
    text_column: str | None = None


@dataclass(frozen=True)
class Outcome:
    """Result of a run; `error` is set and the rest is None when it failed."""

    prepared: Prepared | None
    trained: Trained | None
    metrics: DataFrame
    error: str | None


def run_experiment(
    df: DataFrame,
    plan: Plan,
    key: str | list[str] | None = None,
    n_estimators: int = TREES,
    test_size: float = 0.2,
    event_log: str | None = None,
) -> Outcome:
    """Prepare, train and score. A failure is a `failed` event and an error, not an exception.

    Events are numbered on from the last one of the run in the log, so a repeated run comes later.
    """
    spark = df.sparkSession
    before = last_event(spark, event_log, plan.id) if event_log is not None else 0

    def log(seq: int, status: str, error: str | None = None, metrics: dict | None = None):
        if event_log is not None:
            event = (plan.id, before + seq, status, metrics or {}, error)
            append_events(spark.createDataFrame([event], RUN_EVENT), event_log)

    try:
        log(1, "preparing")
        text = None
        if plan.task_type in TEXT_TASKS:
            known = select_features(df, plan.feature_variables or None, plan.target_variable)
            text = [text_column(known, plan.target_variable, plan.text_column)]
        prepared = prepare(
            df,
            plan.target_variable,
            plan.task_type,
            plan.feature_variables or None,
            key,
            test_size,
            text_columns=text,
        )
        log(2, "training")
        trained = train(
            prepared, plan.task_type, plan.model_type, n_estimators, text[0] if text else None
        )
        row = trained.metrics.first()
        metrics = spark.createDataFrame([tuple(row)], METRICS)
        numbers = {n: float(row[n]) for n in NUMBERS if row[n] is not None}
        log(3, "complete", metrics=numbers)
        return Outcome(prepared, trained, metrics, None)
    except Exception as exc:  # noqa: BLE001 - any failure belongs to the run, not the caller
        error = str(exc)
        log(3, "failed", error=error)
        return Outcome(None, None, spark.createDataFrame([], METRICS), error)


def last_event(spark: SparkSession, event_log: str, run_id: str) -> int:
    """Number of the last event of a run; 0 without one."""
    try:
        events = read_events(spark, event_log)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0
    return events.filter(F.col("run_id") == run_id).agg(F.max("seq")).first()[0] or 0


def answer_plan(plan: Plan, metrics: DataFrame, tracker_url: str | None = None) -> DataFrame:
    """The answer row of one experiment."""
    row = metrics.select(
        "*",
        F.lit(plan.id).alias("run_id"),
        F.lit(plan.question).alias("question"),
        F.lit(plan.hypothesis).alias("hypothesis"),
        F.lit(plan.task_type).alias("task_type"),
        F.array(*(F.lit(f) for f in plan.feature_variables))
        .cast("array<string>")
        .alias("feature_variables"),
        F.lit(tracker_url).cast("string").alias("tracker_url"),
    )
    return with_report(evaluate(row))
