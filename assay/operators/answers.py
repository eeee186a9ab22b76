"""Answers: runs, their metrics and the verdict columns."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions import report, verdict
from assay.operators.runs import answerable


def evaluate(
    df: DataFrame, task_type: Column | None = None, primary_feature: Column | None = None
) -> DataFrame:
    """Add verdict, confidence, evidence_summary, key_metrics, limitations and sorted importance.

    `df` holds one row per experiment with the metrics columns, `task_type` and
    `feature_variables`; everything is a column expression.
    """
    m = verdict.Metrics.of()
    task = F.col("task_type") if task_type is None else task_type
    if primary_feature is None:
        primary_feature = F.coalesce(F.get("feature_variables", F.lit(0)), F.lit(""))
    judged = df.withColumns(
        {"verdict": verdict.verdict(task, m), "confidence": verdict.confidence(task, m)}
    )
    return judged.withColumns(
        {
            "evidence_summary": verdict.evidence(
                task, m, F.col("verdict"), F.col("confidence"), primary_feature
            ),
            "key_metrics": verdict.key_metrics(task, m),
            "limitations": verdict.limitations(task, m),
            "importance": verdict.sorted_importance(F.col("feature_importance")),
        }
    )


def with_report(answers: DataFrame) -> DataFrame:
    """Add the markdown `full_report`."""
    return answers.withColumn(
        "full_report",
        report.markdown(
            F.col("question"),
            F.col("verdict"),
            F.col("confidence"),
            F.col("evidence_summary"),
            F.col("key_metrics"),
            F.col("importance"),
            F.col("limitations"),
            F.col("tracker_url"),
        ),
    )


def answer(
    runs: DataFrame, metrics: DataFrame, requests: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(answers with reports, errors) of finished runs that have metrics.

    `runs` has run_id, status, question, hypothesis, task_type,
    feature_variables and tracker_url; `requests` may override the texts with
    `ask_question` and `ask_hypothesis`.
    """
    gated = answerable(runs, metrics, requests)
    for name in ("question", "hypothesis"):
        if f"ask_{name}" in gated.columns:
            own = F.col(f"ask_{name}")
            gated = gated.withColumn(
                name, F.when(F.length(own) > 0, own).otherwise(F.col(name))
            ).drop(f"ask_{name}")
    ready = gated.filter(F.col("error").isNull()).drop("error")
    errors = gated.filter(F.col("error").isNotNull()).select("run_id", "error")
    return with_report(evaluate(ready)), errors


def top_features(answers: DataFrame, by: list[str], limit: int = report.TOP_FEATURES) -> DataFrame:
    """(by, position, feature, importance): the heaviest features of each experiment."""
    return answers.select(
        *by, F.posexplode(F.slice("importance", 1, limit)).alias("i", "f")
    ).select(*by, (F.col("i") + 1).alias("position"), "f.feature", "f.importance")


def run_results(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Runs with their metrics and plan columns; runs without metrics have none yet."""
    return runs.join(metrics, "run_id", "left")


def summarize(runs: DataFrame, answers: DataFrame) -> DataFrame:
    """List of runs with the verdict, `-` where there is none."""
    return (
        runs.join(answers.select("run_id", "verdict"), "run_id", "left")
        .select(
            "run_id",
            F.substring("question", 1, 50).alias("question"),
            "status",
            "model_type",
            F.coalesce("verdict", F.lit("-")).alias("verdict"),
        )
        .orderBy("run_id")
    )
